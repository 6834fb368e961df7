import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import indices as I
from emberline.functions import scalar
from emberline.functions import spread as S
from emberline.functions.vegetation import ndvi, ndvi_proxy
from emberline.spec import RegionSpec, SeasonSpec, SpreadSpec

WX = "wx_temperature_c DOUBLE, wx_humidity_pct DOUBLE, wx_wind_speed_ms DOUBLE, wx_precipitation_mm DOUBLE"


def test_ffmc_known_value_and_bounds(spark):
    rows = [(25.0, 40.0, 2.0, 0.0), (35.0, 10.0, 8.0, 0.0), (15.0, 90.0, 0.5, 5.0), (None, 40.0, 2.0, 0.0)]
    out = [r.ffmc for r in I.with_ffmc(spark.createDataFrame(rows, WX)).collect()]
    assert all(0 <= v <= 101 for v in out[:3])
    assert out[3] is None
    # First row by hand: drying from the start code of 85.
    t, h, w = 25.0, 40.0, 7.2
    mo = 147.2 * 16 / 144.5
    heat = 0.18 * (21.1 - t) * (1 - math.exp(-0.115 * h))
    ed = 0.942 * h**0.679 + 11 * math.exp((h - 100) / 10) + heat
    kd = 0.424 * (1 - 0.4**1.7) + 0.0694 * math.sqrt(w) * (1 - 0.4**8)
    m = ed + (mo - ed) * 10 ** (-kd)
    assert mo > ed
    assert out[0] == pytest.approx(59.5 * (250 - m) / (147.2 + m))


def test_previous_codes_as_numbers_or_columns(spark):
    df = spark.createDataFrame([(30.0, 20.0, 1.0, 0.0), (32.0, 15.0, 1.0, 3.0)], WX).withColumn("p", F.lit(6.0))
    a = I.with_dc(I.with_dmc(df, month=5, prev=6.0), month=5, prev=15.0)
    b = I.with_dc(I.with_dmc(df, month=F.lit(5), prev="p"), month=5, prev=F.col("p") + 9.0)
    left, right = (sorted((r.dmc, r.dc) for r in x.collect()) for x in (a, b))
    assert left == right
    assert all(d >= 0 and c >= 0 for d, c in left)
    assert left[0][1] == pytest.approx(15 + 0.5 * (0.36 * 32.8 + 3.8)) or left[1][1] == pytest.approx(
        15 + 0.5 * (0.36 * 32.8 + 3.8)
    )


def test_unknown_month_has_a_default(spark):
    df = spark.createDataFrame([(30.0, 20.0, 1.0, 0.0)], WX)
    row = I.with_dmc(df, month=13).first()
    assert row.dmc == pytest.approx(6 + 1.894 * 31.1 * 80 * 9.0 * 1e-4)


def test_indices_survive_a_filter_without_growing(spark):
    df = spark.createDataFrame([(40.0, 8.0, 11.0, 0.0), (25.0, 80.0, 1.0, 6.0)], WX)
    hot = I.with_indices(df, month=3).where("fwi > 60 or bui > 1e6")
    assert hot.count() == 1
    # The filter must not have been copied through the staged projections.
    assert len(hot._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (3.0,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(scalar.clip("x", 0, 1)).collect()] == [0.0, 0.5, 1.0, None]


def test_acquisition_time(spark):
    df = spark.createDataFrame([("2024-01-02", 5), ("2024-01-02", 2359), ("2024-01-02", 1275), (None, 5)], "d STRING, t INT")
    out = [r[0] for r in df.select(scalar.acquisition_time(F.to_date("d"), "t").cast("string")).collect()]
    assert out == ["2024-01-02 00:05:00", "2024-01-02 23:59:00", None, None]


def test_error_payload_positions(spark):
    texts = ["Invalid key", "ERROR: x", "latitude\n" + "x" * 60 + "error", "y" * 250 + "Invalid", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r[0] for r in df.select(scalar.is_error_payload("t")).collect()] == [True, True, False, False, False]


def test_one_decimal_half_up(spark):
    df = spark.createDataFrame([(0.25,), (60.05,), (8.04,)], "x DOUBLE")
    assert [r[0] for r in df.select(scalar.one_decimal("x")).collect()] == ["0.3", "60.1", "8.0"]


def test_season_and_box(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2023-05-31",), ("2023-06-01",), ("2022-03-01",)], "d STRING")
    inside = df.where(scalar.in_season(F.to_date("d"), SeasonSpec(years=(2023,)))).count()
    assert inside == 2


def test_wind_alignment_and_probability(spark):
    spec = SpreadSpec()
    df = spark.createDataFrame([(0, 180.0), (180, 180.0), (90, 350.0)], "b INT, w DOUBLE")
    out = [r[0] for r in df.select(S.wind_alignment("b", "w", spec)).collect()]
    assert out[0] == pytest.approx(1.8)
    assert out[1] == pytest.approx(0.4)
    assert out[2] == pytest.approx(1 + 0.8 * math.cos(math.radians(80)))
    p = df.select(S.spread_probability(F.lit(1.0), F.lit(1.0), F.lit(50.0), F.lit(1.8), spec)).first()[0]
    assert p == pytest.approx(0.97)


def test_ndvi_prefers_observation_and_is_repeatable(spark):
    df = spark.createDataFrame([(3, "2024-01-05", 0.0, None), (3, "2024-01-05", 2.0, 0.1)], "z INT, d STRING, r DOUBLE, o DOUBLE")
    q = df.select(ndvi("o", ndvi_proxy("z", F.to_date("d"), F.lit(False), "r")))
    a, b = [r[0] for r in q.collect()], [r[0] for r in q.repartition(3).collect()]
    assert 0.1 in a and sorted(a) == sorted(b)


def test_region_shape():
    spec = RegionSpec()
    assert (spec.n_rows, spec.n_cols, spec.n_zones) == (40, 35, 1400)
    assert spec.shape(spec.weather_cell_deg) == (8, 7)
    with pytest.raises(ValueError):
        RegionSpec(min_lat=2, max_lat=1)
