import pytest
from pyspark.sql import functions as F

from emberline.functions import indices, spread, sql
from emberline.operators import alerts
from emberline.spec import AlertSpec, SpreadSpec

COLUMNS = "wx_temperature_c DOUBLE, wx_humidity_pct DOUBLE, wx_wind_speed_ms DOUBLE, wx_precipitation_mm DOUBLE, month INT"


@pytest.fixture
def days(spark):
    sql.register(spark)
    rows = [(t, h, w, r, m) for t in (-3.0, 12.0, 41.0) for h in (5.0, 60.0, 100.0) for w, r in ((0.0, 0.0), (9.5, 2.0), (3.0, 30.0)) for m in (1, 7)]
    rows += [(None, 20.0, 1.0, 0.0, 5), (20.0, None, 1.0, 0.0, 5), (20.0, 30.0, None, 0.0, 5), (20.0, 30.0, 2.0, None, 5), (20.0, 30.0, 2.0, 0.0, 13)]
    return spark.createDataFrame(rows, COLUMNS)


def test_sql_indices_equal_the_columns(spark, days):
    want = indices.with_indices(days, month="month").select("ffmc", "dmc", "dc", "bui", "fwi")
    got = spark.sql(
        """with c as (select wx_wind_speed_ms as w, ffmc(wx_temperature_c, wx_humidity_pct, wx_wind_speed_ms, wx_precipitation_mm) as ffmc,
            dmc(wx_temperature_c, wx_humidity_pct, wx_precipitation_mm, duff_day_length(month)) as dmc,
            dc(wx_temperature_c, wx_precipitation_mm, drought_day_length(month)) as dc from {days})
        select ffmc, dmc, dc, bui(dmc, dc) as bui, fwi(ffmc, bui(dmc, dc), w) as fwi from c""",
        days=days,
    )
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "udf" not in plan.lower()


def test_sql_start_values_can_be_given(spark, days):
    want = indices.with_ffmc(days, prev=60.0).select("ffmc").collect()
    got = spark.sql("select ffmc(wx_temperature_c, wx_humidity_pct, wx_wind_speed_ms, wx_precipitation_mm, 60D) as ffmc from {days}", days=days)
    assert got.collect() == want


def test_sql_alert_rules_equal_the_columns(spark):
    sql.register(spark)
    rows = [(a, f, w) for a in (True, False) for f in (None, 10.0, 61.25, 95.0, 140.0) for w in (None, 2.0, 8.04)]
    zones = spark.createDataFrame(rows, "active_fire_nearby BOOLEAN, fwi DOUBLE, wx_wind_speed_ms DOUBLE")
    zones = zones.withColumn("risk", alerts.fallback_risk("fwi"))
    want = zones.select("risk", alerts.severity("risk", AlertSpec()).alias("s"), alerts.reason(AlertSpec()).alias("r"), (F.col("risk") >= 0.7).alias("a"))
    got = spark.sql("select fallback_risk(fwi), severity(risk), alert_reason(active_fire_nearby, fwi, wx_wind_speed_ms), is_alert(risk) from {zones}", zones=zones)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert spark.sql("select is_alert(double('nan'))").head()[0] is None


def test_sql_spread_equals_the_columns(spark):
    sql.register(spark)
    rows = [(float(b), w, d, 0.6, s) for b in (0, 45, 270) for w in (0.0, 200.0, 359.0, None) for d in (0.0, 0.9) for s in (0.0, 4.0, 25.0)]
    cells = spark.createDataFrame(rows, "bearing DOUBLE, wind_from DOUBLE, dry DOUBLE, fuel DOUBLE, wind DOUBLE")
    spec = SpreadSpec()
    aligned = spread.wind_alignment("bearing", "wind_from", spec)
    want = cells.select(aligned.alias("a"), spread.spread_probability("dry", "fuel", "wind", aligned, spec).alias("p"))
    got = spark.sql("select wind_alignment(bearing, wind_from), spread_probability(dry, fuel, wind, wind_alignment(bearing, wind_from)) from {cells}", cells=cells)
    for x, y in zip(got.collect(), want.collect()):
        assert tuple(x) == pytest.approx(tuple(y), nan_ok=True) if None not in y else tuple(x) == tuple(y)
