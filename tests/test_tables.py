import datetime as dt
import glob
import json
import os
import random
import statistics

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import dedup, features, learn, metrics, sequences
from emberline.operators.stations import in_ranges
from emberline.plans import serving, training
from emberline.session import scratch_dir, single_machine
from emberline.sources import readers, writers
from emberline.spec import RegionSpec, SeasonSpec

HEADER = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,version,bright_t31,frp,daynight\n"
GOOD = "12.5,75.1,330.5,0.4,0.4,2024-01-02,5,N,h,2.0NRT,290.1,11.5,D\n"


def test_hotspot_files(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + GOOD + GOOD.replace("12.5", "50.0"))
    (folder / "b.csv").write_text("Invalid MAP_KEY.\nsecond line,1,2\n")
    (folder / "c.csv").write_text(HEADER + "not,a,number,x,x,x,x,N,h,2,x,x,D\n")
    (folder / "d.csv").write_text(HEADER)
    rows = readers.read_hotspots(spark, str(folder), RegionSpec()).collect()
    assert [(r.latitude, r.acq_date, r.confidence) for r in rows] == [(12.5, dt.date(2024, 1, 2), "h")]
    assert rows[0].acq_datetime == dt.datetime(2024, 1, 2, 0, 5)
    bad = readers.quarantined(spark, str(folder)).collect()
    assert [os.path.basename(r.file_path) for r in bad] == ["b.csv"]


def test_missing_sources(spark, tmp_path):
    none = readers.read_hotspots(spark, str(tmp_path / "nowhere"))
    assert none.count() == 0 and none.columns[:13] == schemas.HOTSPOT.names
    assert readers.read_weather_json(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "nowhere"), schemas.TRAINING_SET)


def test_weather_answers(spark, tmp_path):
    full = {"main": {"temp": 30.5, "humidity": 20, "pressure": 1009}, "wind": {"speed": 3, "deg": 90},
            "rain": {"1h": 0.4}, "clouds": {"all": 10}, "weather": [{"main": "Rain"}]}
    bare = {"main": {"temp": 31, "humidity": 21, "pressure": 1010}, "weather": []}
    broken = {"main": {"temp": 31}}
    folder = tmp_path / "wx"
    folder.mkdir()
    lines = [json.dumps({"latitude": 1.0, "longitude": 2.0, "payload": json.dumps(p)}) for p in (full, bare, broken)]
    lines.append(json.dumps({"latitude": 1.0, "longitude": 2.0, "payload": "oops"}))
    (folder / "x.json").write_text("\n".join(lines))
    out = readers.read_weather_json(spark, str(folder)).orderBy("temperature_c").drop("fetched_at").collect()
    assert [tuple(r)[2:] for r in out] == [
        (30.5, 20.0, 1009.0, 3.0, 90.0, 0.4, 10.0, "Rain"),
        (31.0, 21.0, 1010.0, 0.0, 0.0, 0.0, 0.0, "Unknown"),
    ]


def test_season_scan_reads_only_wanted_partitions(spark, tmp_path):
    rows = [(12.0, 75.0, dt.date(y, m, 3), y) for y in (2022, 2023, 2024) for m in (1, 5, 7)]
    df = spark.createDataFrame(rows, "latitude DOUBLE, longitude DOUBLE, acq_date DATE, fire_season_year INT")
    path = str(tmp_path / "hist")
    writers.write_table(df, path, ["fire_season_year"])
    scan = readers.season_scan(spark.read.parquet(path), SeasonSpec(years=(2023, 2024)), RegionSpec())
    assert scan.count() == 4
    plan = scan._jdf.queryExecution().executedPlan().toString()
    partition = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "fire_season_year" in partition and "acq_date" in plan.split("PushedFilters: [")[1]


def test_first_detection(spark):
    rows = [(1.0, 2.0, "d", 5, 9, "late"), (1.0, 2.0, "d", 5, 1, "early"), (1.0, 2.0, "d", 6, 3, "other")]
    df = spark.createDataFrame(rows, "latitude DOUBLE, longitude DOUBLE, acq_date STRING, acq_time INT, id INT, v STRING")
    assert {r.v for r in dedup.first_detection(df, ["id"]).collect()} == {"early", "other"}


def test_impute_median_per_group(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 8.0), ("a", None), ("b", None), ("b", 4.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    out = sorted((r.g, r.x) for r in features.impute_median(df, ["x"], by=["g"]).collect())
    assert out == [("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 8.0), ("b", 4.0), ("b", 4.0)]


def test_median_of_many_values_is_exact(spark):
    """Values that a sketch of this accuracy only brackets, crowded ones among them."""
    rng = random.Random(5)
    values = {"even": [rng.uniform(-50, 50) for _ in range(4001)], "crowded": [1e-9 * rng.random() for _ in range(3000)] + [1e9] * 2000}
    values["ties"] = [7.0] * 3000 + [rng.gauss(7, 1) for _ in range(3000)]
    values["one"], values["two"], values["none"] = [3.5], [1.0, 2.0], [None]
    rows = [(g, x, None if x is None else -x) for g, xs in values.items() for x in xs]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE").repartition(6)
    for accuracy in (16, 200):
        got = {r.g: (r._med_x, r._med_y) for r in features.medians(df, ["x", "y"], ["g"], accuracy).collect()}
        assert got == {g: (statistics.median(xs), -statistics.median(xs)) for g, xs in values.items() if xs != [None]}


def test_score_ranges_follow_the_scores(spark):
    rng = random.Random(6)
    scores = sorted({1e-6 * rng.random() for _ in range(6000)} | {0.5, 0.9, 1.0})
    df = spark.createDataFrame([(s,) for s in scores], "_s DOUBLE")
    found = metrics.score_ranges(df, ranges=32).groupBy("_range").agg(F.count("*").alias("n"), F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    rows = sorted((r["_range"], r["n"], r["lo"], r["hi"]) for r in found.collect())
    sizes = sorted(n for _, n, _, _ in rows)
    assert len(rows) == 32 and sizes[-1] <= 3 * sizes[16]
    assert all(a[3] < b[2] for a, b in zip(rows, rows[1:]))


def test_clustered_files_cover_small_patches(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.uniform(11.5, 15.5), rng.uniform(74.0, 77.5)) for i in range(4000)] + [(-1, None, None), (-2, 40.0, -10.0)]
    df = spark.createDataFrame(rows, "id LONG, latitude DOUBLE, longitude DOUBLE").repartition(16)
    plain, ordered = str(tmp_path / "plain"), str(tmp_path / "ordered")
    df.write.parquet(plain)
    writers.write_clustered(df, ordered, RegionSpec(), files=16)
    box = RegionSpec(min_lat=12.0, max_lat=12.4, min_lon=75.0, max_lon=75.4)

    def opened(path):
        """Rows of the row groups whose extents meet the box."""
        n = 0
        for f in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                lat, lon = (meta.row_group(g).column(i).statistics for i in (1, 2))
                if lat.has_min_max and lat.min <= box.max_lat and lat.max >= box.min_lat and lon.min <= box.max_lon and lon.max >= box.min_lon:
                    n += meta.row_group(g).num_rows
        return n

    assert opened(plain) >= 3900 and opened(ordered) <= 1500
    back = spark.read.parquet(ordered)
    assert sorted(r["id"] for r in back.collect()) == sorted(i for i, _, _ in rows)
    key = spark.createDataFrame([(11.5 + 4 / 65536 * 2.5, 74.0 + 3.5 / 65536 * 1.5)], "latitude DOUBLE, longitude DOUBLE")
    assert key.select(writers.place_order("latitude", "longitude", RegionSpec())).head()[0] == 0b1001


def auc_by_pairs(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("spread", [1.0, 1e-7, 0.0])
def test_auc_equals_pair_counting(spark, spread):
    """Also when all scores share one fine bucket, or one value."""
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.3), 0.3 + spread * round(rng.uniform(0, 0.7), 2)) for _ in range(300)]
    rows += [(0, 0.0), (1, 1.0)]
    df = spark.createDataFrame(rows, "label INT, score DOUBLE")
    assert metrics.roc_auc(df).first().auc_roc == pytest.approx(auc_by_pairs(rows))
    assert metrics.roc_auc(df.where("label = 0")).first().auc_roc is None


def test_rates_and_zero_division(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.6)]
    df = spark.createDataFrame(rows, "label INT, prediction INT, score DOUBLE")
    r = metrics.evaluate(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1_score, r.false_negative_rate, r.auc_roc) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.75)
    z = metrics.evaluate(df.where("label = 0").withColumn("prediction", F.lit(0))).first()
    assert (z.precision, z.recall, z.f1_score, z.false_negative_rate, z.auc_roc) == (0, 0, 0, 0, None)


def test_weights_scale_and_best(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label INT")
    w = {r.label: r.weight for r in metrics.with_class_weight(df).collect()}
    assert w == {0: pytest.approx(8 / 12), 1: 2.0}
    s = {r.label: r.weight for r in metrics.with_class_weight(df, scheme="scale_pos").collect()}
    assert s == {0: 1.0, 1: 3.0}
    x = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    scaled = metrics.standardise(x, metrics.column_scale(x, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]
    table = spark.createDataFrame(
        [("m2", 0.5, 0.1, 0.3, 0.2, None, 0.0), ("m1", 0.5, 0.2, 0.1, 0.2, 0.7, 0.4)],
        "model STRING, " + ", ".join(f"{m} DOUBLE" for m in metrics.METRICS),
    )
    best = {r.metric: r.best_model for r in metrics.best_per_metric(table).collect()}
    assert best["accuracy"] == "m1" and best["recall"] == "m2" and best["auc_roc"] == "m1"
    assert serving.model_radar(table).count() == 10


def days(spark, present):
    rows = [(0, dt.date(2024, 1, d), float(d), d % 2) for d in present]
    return spark.createDataFrame(rows, "zone_idx INT, date DATE, x DOUBLE, fire_risk_label INT")


def test_sequences_with_and_without_gaps(spark):
    df = days(spark, [1, 2, 3, 5, 6, 7])
    loose = sequences.sequences(df, 3, ["x"], gap_free=False).orderBy("date").collect()
    tight = sequences.sequences(df, 3, ["x"]).orderBy("date").collect()
    assert [[v[0] for v in r.sequence] for r in loose] == [[1, 2, 3], [2, 3, 5], [3, 5, 6], [5, 6, 7]]
    assert [r.date.day for r in tight] == [3, 7] and [r.label for r in tight] == [1, 1]
    flat = sequences.flattened(sequences.sequences(df, 3, ["x"])).first()
    assert len(flat.features) == 3
    split = training.with_split(df, "2024-01-03")
    assert sequences.sequences(split, 3, ["x"], within=["split"]).count() == 1


def test_hash_split_is_stable_and_exact_on_demand(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    one = learn.split_rows(df, ["id"]).where("split = 'train'").select("id")
    two = learn.split_rows(df.repartition(7), ["id"]).where("split = 'train'").select("id")
    assert one.exceptAll(two).count() == 0 and 740 < one.count() < 860
    exact = learn.split_rows(df, ["id"], label="y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in exact} == {
        (0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20,
    }


def test_models_train_save_and_score(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "zone_idx INT, a DOUBLE, fwi DOUBLE").withColumn(
        "fire_risk_label", (F.col("a") > 0.6).cast("int")
    ).withColumn("flag", F.col("a") > 0.5)
    spec = learn.ForestSpec(trees=5, depth=3)
    model = learn.fit(df.withColumn("flag", F.col("flag").cast("int")), spec, ["a", "fwi", "flag"])
    path = str(tmp_path / "forest")
    assert learn.load_or_none(spark, path) is None
    learn.save(model, path)
    again = learn.load_or_none(spark, path)
    scored = learn.risk_scores(df, again)
    assert dict(scored.dtypes)["flag"] == "boolean" and scored.where("risk_score not between 0 and 1").count() == 0
    assert learn.risk_scores(df).where("risk_score <> fwi / 100").count() == 0
    top = learn.feature_importance(again, ["a", "fwi", "flag"], spark).first()
    assert top.feature in ("a", "flag")
    table = learn.fit_and_compare(df, df, [spec, learn.BoostedSpec(rounds=3, depth=2)], ["a", "fwi"])
    assert {r.model for r in table.collect()} == {"Random Forest", "Boosted Trees"}


def test_sinks_round_trip(spark, tmp_path):
    train, test = days(spark, [1, 2]), days(spark, [3])
    row = writers.training_metadata(train, test, ["x"], "temporal")
    writers.write_metadata(row, str(tmp_path / "meta"))
    files = [f for f in os.listdir(tmp_path / "meta") if f.endswith(".json")]
    data = json.loads((tmp_path / "meta" / files[0]).read_text())
    assert data["train_rows"] == 2 and data["test_date_range"] == ["2024-01-03", "2024-01-03"]
    assert data["feature_columns"] == ["x"]


def test_scratch_on_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")
    assert single_machine("local[4]") and not single_machine("local-cluster[2,1,1024]")


def test_range_dates_reach_the_scan(spark, tmp_path):
    days = spark.sql("select 1L as station_id, explode(sequence(date'2024-01-01', date'2024-01-30')) as date, 2.0D as temp")
    days.write.parquet(str(tmp_path / "days"))
    rows = in_ranges(spark.read.parquet(str(tmp_path / "days")), [("a", "2024-01-02", "2024-01-04"), ("b", "2024-01-04", "2024-01-05")])
    assert rows.groupBy("season").count().collect() and rows.count() == 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_rows_without_a_place_are_quarantined(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    names = ",".join(schemas.HOTSPOT.names)
    good = "12.0,75.0,310.5,0.4,0.4,2024-01-05,630,N,n,2.0NRT,290.1,7.5,D"
    (folder / "a.csv").write_text(f"{names}\n{good}\nbroken,line\n")
    (folder / "b.csv").write_text("Invalid MAP_KEY.\n")
    path = str(folder)
    assert readers.read_hotspots(spark, path).count() == 1
    bad = readers.quarantined_rows(spark, path).collect()
    assert [r.line for r in bad] == ["broken,line"] and bad[0].file_path.endswith("a.csv")
