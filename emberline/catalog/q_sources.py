"""Sources, grid builders, stitching and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import schemas
from emberline.catalog import frames as X
from emberline.catalog import views as V
from emberline.catalog.registry import query, r4
from emberline.functions import scalar
from emberline.operators import dedup, grid
from emberline.plans import training
from emberline.session import scratch_dir
from emberline.sources import readers as R
from emberline.sources import writers as W
from emberline.spec import RegionSpec, SeasonSpec

FEED = schemas.HOTSPOT.names


@query(
    "src1_hotspot_scan",
    f"""select {", ".join(FEED)}, cast(date as timestamp) + to_hours(acq_time//100) + to_minutes(acq_time%100) as acq_datetime
    from hotspots""",
)
def src1(spark, sf):
    """Detections landed as CSV, scanned with the fixed schema."""
    path = scratch_dir(spark, "hotspots_csv")
    W.write_table(V.hotspots(spark, sf).select(*FEED), path, fmt="csv")
    rows = R.read_hotspots(spark, path, X.REGION)
    return rows.select(*FEED, F.col("acq_datetime").cast("timestamp_ntz").alias("acq_datetime"))


@query(
    "src2_error_payloads",
    """select event_id, instr(substr(body,1,200),'Invalid')>0 or instr(lower(substr(body,1,50)),'error')>0 as rejected
    from feed_answers""",
)
def src2(spark, sf):
    """Feed answers that are error messages."""
    return V.feed_answers(spark, sf).select("event_id", scalar.is_error_payload("body").alias("rejected"))


@query(
    "src2_document_payloads",
    """select doc_id, instr(substr(text,1,200),'Invalid')>0 or instr(lower(substr(text,1,50)),'error')>0 as rejected
    from documents""",
)
def src2_documents(spark, sf):
    """The same test over free text."""
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", scalar.is_error_payload("text").alias("rejected"))


@query(
    "src3_bounding_box",
    """select event_id, latitude, longitude, frp from hotspots
    where latitude between 12.25 and 14.0 and longitude between 74.5 and 76.75""",
)
def src3(spark, sf):
    box = RegionSpec(min_lat=12.25, max_lat=14.0, min_lon=74.5, max_lon=76.75)
    hot = V.hotspots(spark, sf)
    return hot.where(scalar.in_box("latitude", "longitude", box)).select(
        "event_id", "latitude", "longitude", "frp"
    )


@query(
    "src3_clustered_box",
    """select event_id, latitude, longitude, round(frp, 4) as frp, fire_season_year from hotspots_hist
    where latitude between 12.25 and 14.0 and longitude between 74.5 and 76.75""",
)
def src3_clustered(spark, sf):
    """A box read from the history written in the order of place."""
    path = scratch_dir(spark, "clustered")
    W.write_clustered(V.hotspots_hist(spark, sf), path, X.REGION)
    box = RegionSpec(min_lat=12.25, max_lat=14.0, min_lon=74.5, max_lon=76.75)
    rows = spark.read.parquet(path).where(scalar.in_box("latitude", "longitude", box))
    return rows.select("event_id", "latitude", "longitude", F.round("frp", 4).alias("frp"), "fire_season_year")


SEASONS = SeasonSpec(years=(1996, 1997, 1999))


@query(
    "src4_season_scan",
    """select event_id, latitude, longitude, frp, acq_date, fire_season_year from hotspots_hist
    where fire_season_year in (1996, 1997, 1999) and month(acq_date) between 1 and 5""",
)
def src4(spark, sf):
    return R.season_scan(V.hotspots_hist(spark, sf), SEASONS, X.REGION)


FLAT = """select {keep} latitude, longitude, cast(json_extract(payload, '$.main.temp') as double) as temperature_c,
    cast(json_extract(payload, '$.main.humidity') as double) as humidity_pct,
    cast(json_extract(payload, '$.main.pressure') as double) as pressure_hpa,
    coalesce(cast(json_extract(payload, '$.wind.speed') as double), 0e0) as wind_speed_ms,
    coalesce(cast(json_extract(payload, '$.wind.deg') as double), 0e0) as wind_deg,
    coalesce(cast(json_extract(payload, '$.rain.1h') as double), 0e0) as precipitation_mm,
    coalesce(cast(json_extract(payload, '$.clouds.all') as double), 0e0) as clouds_pct,
    coalesce(json_extract_string(payload, '$.weather[0].main'), 'Unknown') as weather_main
    from weather_json where json_extract(payload, '$.main') is not null"""


@query("src5_weather_json", FLAT.format(keep="event_id,"))
def src5(spark, sf):
    """Nested weather answers to typed rows with defaults."""
    return R.flatten_weather(V.weather_json(spark, sf), keep=["event_id"])


@query(
    "src6_weather_collection",
    f"""select cast(floor((latitude-11.5e0)/0.5e0) as int) as row, cast(floor((longitude-74.0e0)/0.5e0) as int) as col,
    count(*) as n_points, max(temperature_c) as max_temp, min(humidity_pct) as min_humidity
    from ({FLAT.format(keep="")}) f group by 1, 2""",
)
def src6(spark, sf):
    """Landed answers of all points, collected per coarse weather cell."""
    path = scratch_dir(spark, "weather_json")
    V.weather_json(spark, sf).select("latitude", "longitude", "payload").write.json(path)
    points = R.read_weather_json(spark, path)
    return grid.locate(points, X.REGION, X.REGION.weather_cell_deg).groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max("temperature_c").alias("max_temp"),
        F.min("humidity_pct").alias("min_humidity"),
    )


@query(
    "src7_history_scan",
    """select date, temp, rhum, prcp, wspd, wdir, pres, latitude, longitude, cast(station_id as varchar) as station_id
    from weather_daily where date between DATE '2024-01-05' and DATE '2024-01-25'""",
)
def src7(spark, sf):
    """A date range of a stored daily weather table."""
    path = scratch_dir(spark, "weather_daily")
    daily = V.weather_daily(spark, sf).withColumn("station_id", F.col("station_id").cast("string"))
    W.write_table(daily.select(*schemas.WEATHER_DAILY.names), path)
    return R.read_weather_daily(spark, path, "2024-01-05", "2024-01-25")


@query(
    "src8_typed_reread",
    "select latitude, longitude, frp, acq_date, fire_season_year from hotspots_hist",
)
def src8(spark, sf):
    """A stage handed over as CSV, read back with its types."""
    path = scratch_dir(spark, "hotspots_hist")
    hist = V.hotspots_hist(spark, sf)
    columns = ["latitude", "longitude", "frp", "acq_date", "fire_season_year"]
    schema = T.StructType([hist.schema[c] for c in columns])
    W.write_table(hist.select(*columns), path, fmt="csv")
    return R.read_table(spark, path, schema, "csv")


def _counted(cells, points, keys):
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "g1_zone_grid",
    """select z.*, count(h.event_id) as n from zone_grid z left join hotspots h
    on cast(floor((h.latitude-11.5e0)/0.1e0) as int)=z.row and cast(floor((h.longitude-74.0e0)/0.1e0) as int)=z.col
    group by all""",
)
def g1(spark, sf):
    """Every zone with the number of detections inside it."""
    return _counted(grid.zone_grid(spark, X.REGION), grid.locate(V.hotspots(spark, sf), X.REGION), ["row", "col"])


@query(
    "g2_weather_grid",
    """select g.row, g.col, 11.5e0+g.row*0.5e0+0.25e0 as latitude, 74.0e0+g.col*0.5e0+0.25e0 as longitude,
    count(w.date) as n from (select cast(r//7 as int) as row, cast(r%7 as int) as col from range(56) t(r)) g
    left join weather_daily w on cast(floor((w.latitude-11.5e0)/0.5e0) as int)=g.row
      and cast(floor((w.longitude-74.0e0)/0.5e0) as int)=g.col group by all""",
)
def g2(spark, sf):
    """Coarse weather cells with the station-days inside them."""
    points = grid.locate(V.weather_daily(spark, sf), X.REGION, X.REGION.weather_cell_deg)
    return _counted(grid.weather_grid(spark, X.REGION), points, ["row", "col"])


@query(
    "g3_query_lattice",
    """select p.*, count(s.station_id) as n from (select cast(r as int) as point_idx,
      11.5e0+(r//4)*(4.0e0/3) as latitude, 74.0e0+(r%4)*(3.5e0/3) as longitude from range(16) t(r)) p
    left join stations s on cast(floor((s.latitude-11.5e0)/(4.0e0/3)+0.5e0)*4+floor((s.longitude-74.0e0)/(3.5e0/3)+0.5e0) as int)=p.point_idx
    group by all""",
)
def g3(spark, sf):
    """Lattice points, ends included, with the stations closest to each by index."""
    i = F.floor((F.col("latitude") - 11.5) / (4.0 / 3) + 0.5)
    j = F.floor((F.col("longitude") - 74.0) / (3.5 / 3) + 0.5)
    near = V.stations(spark, sf).withColumn("point_idx", (i * 4 + j).cast("int"))
    return _counted(grid.query_lattice(spark, X.REGION), near, ["point_idx"])


@query(
    "g4_zone_date_spine",
    """select d.date, z.zone_idx, count(p.event_id) as n_fires from (select distinct date from weather_daily) d
    cross join zone_grid z left join fire_pairs p on p.date=d.date and p.zone_idx=z.zone_idx group by 1, 2""",
)
def g4(spark, sf):
    """Every zone on every weather date, with its nearby detections."""
    from emberline.operators.nearest import zones_within

    dates = V.weather_daily(spark, sf).select("date").distinct()
    fires = zones_within(V.hotspots(spark, sf), X.REGION).groupBy("date", "zone_idx").agg(
        F.count(F.lit(1)).alias("n")
    )
    return grid.spine(dates, X.REGION).join(fires, ["date", "zone_idx"], "left").select(
        "date", "zone_idx", F.coalesce("n", F.lit(0)).alias("n_fires")
    )


@query(
    "g5_grid_shape",
    """select max(row)+1 as n_rows, max(col)+1 as n_cols from (select cast(floor((latitude-11.5e0)/0.1e0) as int) as row,
    cast(floor((longitude-74.0e0)/0.1e0) as int) as col from hotspots) h""",
)
def g5(spark, sf):
    return grid.grid_shape(grid.locate(V.hotspots(spark, sf), X.REGION))


@query(
    "p1_acquisition_time",
    """select event_id, acq_date, case when event_id%2400%100<60 then cast(acq_date as timestamp)
      + to_hours(event_id%2400//100) + to_minutes(event_id%2400%100) end as acq_datetime from hotspots""",
)
def p1(spark, sf):
    """HHMM numbers of which some have impossible minutes."""
    hot = V.hotspots(spark, sf).withColumn("hhmm", F.expr("event_id % 2400"))
    return hot.select(
        "event_id", "acq_date", scalar.acquisition_time("acq_date", "hhmm").cast("timestamp_ntz").alias("acq_datetime")
    )


@query(
    "p2_brightness",
    """select latitude, longitude, acq_date, acq_time, bright_ti4 as fire_brightness from hotspots
    union all select latitude, longitude, acq_date, acq_time, bright_ti4-7e0 as fire_brightness from hotspots where event_id%2=0""",
)
def p2(spark, sf):
    """Files of two sensors whose brightness columns differ, read with the schema of each."""
    hot = V.hotspots(spark, sf)
    newer, older = scratch_dir(spark, "newer_csv"), scratch_dir(spark, "older_csv")
    W.write_table(hot.select(*FEED), newer, fmt="csv")
    renamed = hot.where("event_id % 2 = 0").withColumn("brightness", F.col("bright_ti4") - 7)
    W.write_table(renamed.select(*schemas.HOTSPOT_MODIS.names), older, fmt="csv")
    both = dedup.stitch([R.read_hotspots(spark, newer), R.read_hotspots(spark, older, schema=schemas.HOTSPOT_MODIS)])
    return both.select("latitude", "longitude", "acq_date", "acq_time", scalar.brightness(both.columns).alias("fire_brightness"))


@query("p3_ingest_stamp", "select latitude, longitude, acq_date, acq_time, TIMESTAMP '2024-02-01 06:00:00' as fetched_at from hotspots")
def p3(spark, sf):
    """Detections stamped with an explicit fetch time by the reader."""
    path = scratch_dir(spark, "hotspots_csv")
    W.write_table(V.hotspots(spark, sf).select(*FEED), path, fmt="csv")
    rows = R.read_hotspots(spark, path, fetched_at=F.lit("2024-02-01 06:00:00").cast("timestamp_ntz"))
    return rows.select("latitude", "longitude", "acq_date", "acq_time", "fetched_at")


# Lines of a landed file of the fixture.
_LINES = 20_000


def mixed_files(spark, sf):
    """A folder of data files, of which some have broken lines, and of error
    answers. A day has as many files as its lines need, each of which one task
    writes: its header first, then its lines. Days without data are one line."""
    path = scratch_dir(spark, "mixed_csv")
    hot = V.hotspots(spark, sf).select("event_id", *FEED)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FEED])
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("broken,,"), F.col("event_id").cast("string"))).otherwise(line)
    files = hot.groupBy("acq_date").agg(F.ceil(F.count(F.lit(1)) / _LINES).alias("files"))
    failed = F.dayofmonth("acq_date") % 5 == 0
    lines = hot.join(F.broadcast(files), "acq_date").where(~failed)  # a row a calendar day
    lines = lines.select("acq_date", F.pmod(F.xxhash64("event_id"), "files").alias("file"), F.lit(1).alias("at"), broken.alias("value"))
    each = files.where(~failed).select("acq_date", F.explode(F.sequence(F.lit(0).cast("long"), F.col("files") - 1)).alias("file"))
    headers = each.select("acq_date", "file", F.lit(0).alias("at"), F.lit(",".join(FEED)).alias("value"))
    answer = F.concat(F.lit("Invalid MAP_KEY for "), F.col("acq_date").cast("string"))
    errors = files.where(failed).select("acq_date", F.lit(0).cast("long").alias("file"), F.lit(0).alias("at"), answer.alias("value"))
    rows = lines.unionByName(headers).unionByName(errors).withColumn("day", F.dayofmonth("acq_date"))
    rows = rows.repartition("day", "file").sortWithinPartitions("day", "file", "at")
    rows.select("day", "file", "value").write.partitionBy("day", "file").text(path)
    return path


@query(
    "src2_mixed_files",
    """select latitude, longitude, acq_date, acq_time, frp from hotspots where event_id%7<>0 and day(acq_date)%5<>0""",
)
def src2_mixed(spark, sf):
    """What is read from good files, files with broken lines and error answers."""
    return R.read_hotspots(spark, mixed_files(spark, sf) + "/*/*").select("latitude", "longitude", "acq_date", "acq_time", "frp")


@query("src2_quarantined_files", "select day(acq_date) as day from hotspots where day(acq_date)%5=0 group by 1")
def src2_files(spark, sf):
    """Files that are error answers."""
    bad = R.quarantined(spark, mixed_files(spark, sf) + "/*/*")
    return bad.select(F.regexp_extract("file_path", "day=([0-9]+)", 1).cast("long").alias("day"))


@query(
    "src2_quarantined_rows",
    """select day(acq_date) as day, concat('broken,,', event_id) as line from hotspots where event_id%7=0 and day(acq_date)%5<>0""",
)
def src2_rows(spark, sf):
    """Lines of data files that can't be read."""
    bad = R.quarantined_rows(spark, mixed_files(spark, sf) + "/*/*")
    return bad.select(F.regexp_extract("file_path", "day=([0-9]+)", 1).cast("long").alias("day"), "line")


@query("p5_wind_units", "select station_id, date, round(coalesce(wspd, 0e0)/3.6e0, 4) as wind_speed_ms from weather_daily")
def p5(spark, sf):
    wind = scalar.kmh_to_ms(F.coalesce("wspd", F.lit(0.0)))
    return V.weather_daily(spark, sf).select("station_id", "date", F.round(wind, 4).alias("wind_speed_ms"))


@query(
    "p26_temporal_split",
    """select zone_idx, date, case when date<DATE '2024-01-21' then 'train' else 'test' end as split, fire_risk_label
    from training""",
)
def p26(spark, sf):
    train, test = training.temporal_split(X.training_rows(spark, sf), X.TEST_START)
    sides = [side.withColumn("split", F.lit(name)) for name, side in (("train", train), ("test", test))]
    return dedup.stitch(sides).select("zone_idx", "date", "split", "fire_risk_label")


@query(
    "k4_first_detection",
    "select event_id, latitude, longitude, acq_date, acq_time, frp, poll from hotspots_repolled qualify "
    "row_number() over (partition by latitude, longitude, acq_date, acq_time order by poll, event_id)=1",
)
def k4(spark, sf):
    """Detections repeated across polls, each once, the earliest kept."""
    hot = V.hotspots_repolled(spark, sf).select(
        "event_id", "latitude", "longitude", "acq_date", "acq_time", "frp", "poll"
    )
    return dedup.first_detection(hot, order=["poll", "event_id"])


@query(
    "k5_sorted_dates",
    "select distinct date from weather_daily order by date",
)
def k5(spark, sf):
    return V.weather_daily(spark, sf).select("date").distinct().orderBy("date")


@query(
    "u1_stitched_fetches",
    """select latitude, longitude, frp, acq_date, cast(null as integer) as fire_season_year from hotspots
    union all select latitude, longitude, frp, acq_date, fire_season_year from hotspots_hist""",
)
def u1(spark, sf):
    """Current and historical fetches under one set of columns."""
    now = V.hotspots(spark, sf).select("latitude", "longitude", "frp", "acq_date")
    hist = V.hotspots_hist(spark, sf).select("latitude", "longitude", "frp", "acq_date", "fire_season_year")
    return dedup.stitch([now, hist])


@query(
    "a4_detections_per_season",
    "select fire_season_year, count(*) as n_detections from hotspots_hist group by 1",
)
def a4(spark, sf):
    return V.hotspots_hist(spark, sf).groupBy("fire_season_year").agg(F.count(F.lit(1)).alias("n_detections"))


@query(
    "kw1_training_sink",
    f"""select cast(year(date) as int) as season_year, count(*) as n_rows, sum(fire_risk_label) as n_positive,
    {r4("max_fwi")} from (select *, max(fwi) over () as max_fwi from training) t group by season_year, max_fwi""",
)
def kw1(spark, sf):
    """The training set written by season year and read back."""
    path = scratch_dir(spark, "training_set")
    W.write_training_set(X.training_rows(spark, sf).select(*schemas.TRAINING_SET.names), path)
    schema = T.StructType([*schemas.TRAINING_SET.fields, T.StructField("season_year", T.IntegerType())])
    stored = R.read_table(spark, path, schema)
    return stored.groupBy("season_year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("fire_risk_label").alias("n_positive"),
        F.round(F.max("fwi"), 4).alias("max_fwi"),
    )


@query(
    "kw2_run_metadata",
    """select count(*) filter (where date<DATE '2024-01-21') as train_rows, count(*) filter (where date>=DATE '2024-01-21') as test_rows,
    min(date) as train_first, max(date) as test_last,
    round(avg(fire_risk_label) filter (where date<DATE '2024-01-21'), 4) as train_positive_rate,
    round(avg(fire_risk_label) filter (where date>=DATE '2024-01-21'), 4) as test_positive_rate, 10 as n_features from training""",
)
def kw2(spark, sf):
    """The description of a training run written as JSON and read back."""
    path = scratch_dir(spark, "metadata")
    train, test = training.temporal_split(X.training_rows(spark, sf), X.TEST_START)
    row = W.training_metadata(train, test, schemas.TRAINING_FEATURES, f"temporal: test from {X.TEST_START}")
    W.write_metadata(row, path)
    return spark.read.schema(row.schema).json(path).select(
        "train_rows",
        "test_rows",
        F.col("train_date_range")[0].alias("train_first"),
        F.col("test_date_range")[1].alias("test_last"),
        F.round("train_positive_rate", 4).alias("train_positive_rate"),
        F.round("test_positive_rate", 4).alias("test_positive_rate"),
        F.size("feature_columns").alias("n_features"),
    )
