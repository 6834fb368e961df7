"""Labels, sequences, metrics, scaling and models."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from emberline.catalog import frames as X
from emberline.catalog import views as V
from emberline.catalog.kept import once
from emberline.catalog.registry import query, r4
from emberline.operators import learn as L
from emberline.operators import metrics as M
from emberline.operators import sequences as Q
from emberline.plans import serving, state, training
from emberline.session import scratch_dir
from emberline.schemas import LIVE_FEATURES, TRAINING_FEATURES
from emberline.sources.writers import stored


@query(
    "training_set",
    f"select zone_id, date, {r4('latitude', 'longitude', *TRAINING_FEATURES)}, fire_risk_label from training",
)
def training_table(spark, sf):
    """The complete observed-label training set."""
    weather, fires = V.weather_daily(spark, sf), V.hotspots(spark, sf)
    return X.rounded(training.training_set(weather, fires, X.REGION, V.ndvi_obs(spark, sf)))


@query(
    "a3_positive_rate",
    "select count(*) as n_rows, sum(fire_risk_label) as n_positive, round(avg(fire_risk_label), 4) as positive_rate from processed",
)
def a3(spark, sf):
    return X.rounded(M.label_rate(X.processed(spark, sf)))


@query("a8_confusion_matrix", "select model, tn, fp, fn, tp from confusions")
def a8(spark, sf):
    return M.confusion(X.rule_scores(spark, sf), by=["model"])


@query(
    "a9_rates",
    f"select model, {r4('accuracy', 'precision', 'recall', 'f1_score')} from metric_rows",
)
def a9(spark, sf):
    rows = M.rates(M.confusion(X.rule_scores(spark, sf), by=["model"]))
    return X.rounded(rows.select("model", "accuracy", "precision", "recall", "f1_score"))


@query("a10_false_negative_rate", f"select model, {r4('false_negative_rate')} from metric_rows")
def a10(spark, sf):
    rows = M.rates(M.confusion(X.rule_scores(spark, sf), by=["model"]))
    return X.rounded(rows.select("model", "false_negative_rate"))


@query("a11_roc_auc", f"select model, {r4('auc_roc')} from aucs")
def a11(spark, sf):
    return X.rounded(M.roc_auc(X.rule_scores(spark, sf), by=["model"]))


@query(
    "a12_class_weights",
    """select n0 as n_negative, n1 as n_positive, round((n0+n1)/(2e0*n0), 4) as weight_negative, round((n0+n1)/(2e0*n1), 4) as weight_positive,
    round(n0/cast(greatest(n1, 1) as double), 4) as scale_pos_weight from (select count(*) filter (where fire_risk_label=0) as n0,
      count(*) filter (where fire_risk_label=1) as n1 from training) c""",
)
def a12(spark, sf):
    return X.rounded(M.class_weights(X.training_rows(spark, sf), "fire_risk_label"))


@query(
    "a12_weighted_rows",
    """select date, zone_idx, fire_risk_label, round(case when fire_risk_label=1 then n/(2e0*n1) else n/(2e0*(n-n1)) end, 4) as weight
    from (select *, count(*) over () as n, sum(fire_risk_label) over () as n1 from training) t""",
)
def a12_rows(spark, sf):
    rows = X.training_rows(spark, sf).select("date", "zone_idx", "fire_risk_label")
    return X.rounded(M.with_class_weight(rows, "fire_risk_label"))


@query(
    "a13_split_statistics",
    """select case when date<DATE '2024-01-21' then 'train' else 'test' end as split, count(*) as n_rows, min(date) as first_date,
    max(date) as last_date, round(avg(fire_risk_label), 4) as positive_rate from training group by 1""",
)
def a13(spark, sf):
    return X.rounded(M.split_statistics(training.with_split(X.training_rows(spark, sf), X.TEST_START)))


_TRAIN_SIDE = "(select * from training where date<DATE '2024-01-21') t"


@query(
    "a14_column_scale",
    " union all ".join(
        f"select '{c}' as feature, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std from {_TRAIN_SIDE}"
        for c in TRAINING_FEATURES
    ),
)
def a14(spark, sf):
    """Mean and population deviation of each feature on the training side."""
    train, _ = training.temporal_split(X.training_rows(spark, sf), X.TEST_START)
    return X.rounded(M.column_scale(train, TRAINING_FEATURES))


@query(
    "a14_standardised",
    "select date, zone_idx, "
    + ", ".join(
        f"round(({c}-avg({c}) over ())/(case when stddev_pop({c}) over ()>0 then stddev_pop({c}) over () else 1e0 end), 4) as {c}"
        for c in TRAINING_FEATURES
    )
    + " from training",
)
def a14_rows(spark, sf):
    rows = X.training_rows(spark, sf).select("date", "zone_idx", *TRAINING_FEATURES)
    scaled = M.standardise(rows, M.column_scale(rows, TRAINING_FEATURES), TRAINING_FEATURES)
    return scaled.withColumns({c: F.round(c, 4) for c in TRAINING_FEATURES})


@query("a15_model_comparison", "select * from comparison")
def a15(spark, sf):
    return M.comparison(M.evaluate(X.rule_scores(spark, sf), by=["model"]))


@query(
    "a16_best_per_metric",
    """select metric, arg_min(model, {'v': -value, 'm': model}) as best_model, max(value) as best_value from metric_long
    where value is not null group by metric""",
)
def a16(spark, sf):
    return M.best_per_metric(M.comparison(M.evaluate(X.rule_scores(spark, sf), by=["model"])))


@query("v5_model_radar", "select model, metric, value from metric_long where metric<>'false_negative_rate'")
def v5_radar(spark, sf):
    return serving.model_radar(M.comparison(M.evaluate(X.rule_scores(spark, sf), by=["model"])))


@query(
    "v5_model_table",
    "select model, metric, value, value=max(value) over (partition by metric) as is_best from metric_long",
)
def v5_table(spark, sf):
    return serving.model_table(M.comparison(M.evaluate(X.rule_scores(spark, sf), by=["model"])))


@query(
    "a18_distinct_counts",
    "select count(distinct date) as n_dates, count(distinct zone_id) as n_zones from training",
)
def a18(spark, sf):
    return X.training_rows(spark, sf).agg(
        F.count_distinct("date").alias("n_dates"), F.count_distinct("zone_id").alias("n_zones")
    )


# -- sequences: each day's FWI and the feature sum of the window, as plain columns --

_N = 7


def _seq_sql(source: str, partition: str = "zone_idx", extra: str = "") -> str:
    total = "+".join(TRAINING_FEATURES)
    lags = ", ".join(f"lag(fwi, {_N - 1 - i}) over w as f{i}" for i in range(_N))
    return f"""(select *, {lags}, sum({total}) over (w rows between {_N - 1} preceding and current row) as s,
      count(*) over (w rows between {_N - 1} preceding and current row) as n,
      first_value(date) over (w rows between {_N - 1} preceding and current row) as d0 {extra}
    from {source} window w as (partition by {partition} order by date)) q where n={_N}"""


_FWI = TRAINING_FEATURES.index("fwi")
_DAYS = ", ".join(f"round(f{i}, 4) as fwi_{i}" for i in range(_N))


def _plain(seq):
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)
    days = [F.round(F.col("sequence")[i][_FWI], 4).alias(f"fwi_{i}") for i in range(_N)]
    keys = [c for c in seq.columns if c not in ("sequence", "first_day", "label")]
    return seq.select(*keys, "label", *days, F.round(total, 3).alias("total"))


_TRAIN_SPLIT = "(select *, case when date<DATE '2024-01-21' then 'train' else 'test' end as split from training) t"
# Zone-days without some days, so that row windows bridge gaps and gap-free ones don't.
_GAPS = "(zone_idx + day(date)) % 11 <> 0"
_GAPPED = f"(select * from training where {_GAPS}) t"


def _gapped(spark, sf):
    return X.training_rows(spark, sf).where(_GAPS)


@query("w1_row_sequences", f"select zone_idx, date, fire_risk_label as label, {_DAYS}, round(s, 3) as total from {_seq_sql(_GAPPED)}")
def w1(spark, sf):
    """Windows of seven rows, which may bridge missing days."""
    return _plain(Q.sequences(_gapped(spark, sf), _N, gap_free=False))


@query(
    "w2_gap_free_sequences",
    f"select zone_idx, date, fire_risk_label as label, {_DAYS}, round(s, 3) as total from {_seq_sql(_GAPPED)} and date_diff('day', d0, date)=6",
)
def w2(spark, sf):
    """Windows of seven consecutive days."""
    return _plain(Q.sequences(_gapped(spark, sf), _N))


@query(
    "w3_split_sequences",
    f"select split, zone_idx, date, fire_risk_label as label, {_DAYS}, round(s, 3) as total from {_seq_sql(_TRAIN_SPLIT, 'split, zone_idx')}",
)
def w3(spark, sf):
    """Windows that stay on their side of the split."""
    rows = training.with_split(X.training_rows(spark, sf), X.TEST_START)
    return _plain(Q.sequences(rows, _N, within=["split"]))


@query(
    "w4_snapshot_sequences",
    f"select zone_idx, date as refreshed_at, {_DAYS}, round(s, 3) as total from {_seq_sql('scored')}",
)
def w4(spark, sf):
    """Windows over the snapshots that are stored, all features."""
    history = X.snapshot(spark, sf).withColumnRenamed("date", "refreshed_at")
    seq = state.snapshot_sequences(history, TRAINING_FEATURES, _N)
    return _plain(seq.withColumn("label", F.lit(None).cast("int"))).drop("label")


@query(
    "w5_flat_windows",
    f"""select zone_idx, date, 70 as n_values, round({TRAINING_FEATURES[0]}_0, 4) as first_value, ndvi as last_value
    from (select *, lag({TRAINING_FEATURES[0]}, 6) over w as {TRAINING_FEATURES[0]}_0, row_number() over w as n
      from training window w as (partition by zone_idx order by date)) q where n>=7""",
)
def w5(spark, sf):
    """Windows flattened day by day."""
    flat = Q.flattened(Q.sequences(X.training_rows(spark, sf), _N))
    return flat.select(
        "zone_idx",
        "date",
        F.size("features").alias("n_values"),
        F.round(F.element_at("features", 1), 4).alias("first_value"),
        F.element_at("features", -1).alias("last_value"),
    )


# -- models at their full sizes. Tree and network fits differ by library, so what is
# checked exactly is which rows are scored and that every measure is in its range. --

FOREST, BOOSTED, NETWORK = L.ForestSpec(), L.BoostedSpec(), L.SequenceSpec()
def _model(spark, sf, kind, spec, fit):
    """The saved model, fitted first if there is none yet."""

    def made():
        path = scratch_dir(spark, "model")
        L.save(fit(), path)
        return path

    return L.load_or_none(spark, once(spark, sf, (kind, spec), made))


def _sides(spark, sf):
    return training.temporal_split(once(spark, sf, "training", lambda: X.stored_training(spark, sf)), X.TEST_START)


def _windows(spark, sf):
    """Standardised flat windows of both sides, scaled by the training side's
    days; a day counts once however many windows it is in."""

    def made():
        train, test = _sides(spark, sf)
        scale = M.column_scale(train, TRAINING_FEATURES)
        keep = ["zone_idx", "date", *TRAINING_FEATURES, "fire_risk_label"]
        sides = [M.standardise(side.select(*keep), scale, TRAINING_FEATURES) for side in (train, test)]
        return [stored(Q.flattened(Q.sequences(side, _N), vector=True), "windows") for side in sides]

    return once(spark, sf, "windows", made)


def _tabular(spark, sf, spec):
    train, test = _sides(spark, sf)
    model = _model(spark, sf, "observed", spec, lambda: L.fit(train, spec, TRAINING_FEATURES))
    return L.score(test, model), spec.name, "fire_risk_label"


def _network(spark, sf):
    train, test = _windows(spark, sf)
    model = _model(spark, sf, "observed", NETWORK, lambda: L.fit_sequences(train, NETWORK, _N * len(TRAINING_FEATURES)))
    return L.score(test, model), NETWORK.name, "label"


def _rule_sides(spark, sf):
    def made():
        rows = L.split_rows(X.processed(spark, sf), ["date", "zone_idx"])
        return stored(rows.withColumn("active_fire_nearby", F.col("active_fire_nearby").cast("int")), "features")

    matrix = once(spark, sf, "rule", made)
    return [matrix.where(F.col("split") == side) for side in ("train", "test")]


def _rule_model(spark, sf, spec):
    train, test = _rule_sides(spark, sf)
    model = _model(spark, sf, "rule", spec, lambda: L.fit(train, spec, LIVE_FEATURES))
    return L.score(test, model), spec.name, "fire_risk_label"


def _measured(*results):
    """Per model: rows and positives of the test side, and whether every
    measure is in its range and ranks better than chance."""
    out = []
    for scored, name, label in results:
        kept = stored(scored.select(label, "prediction", "risk_score"), "predictions")
        rows = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(label).cast("long").alias("n_positive"))
        row = M.evaluate(kept, label, "prediction", "risk_score")
        fits = reduce(and_, [F.col(m).between(0, 1) for m in M.METRICS])
        row = row.select(F.lit(name).alias("model"), fits.alias("in_range"), (F.col("auc_roc") > 0.5).alias("better_than_chance"))
        out.append(row.crossJoin(rows))  # one row each
    return reduce(lambda a, b: a.unionByName(b), out)


_TEST = "(select count(*) as n_rows, sum(fire_risk_label) as n_positive from training where date>=DATE '2024-01-21') t"
_TEST_WINDOWS = f"""(select count(*) as n_rows, sum(fire_risk_label) as n_positive from {_seq_sql(_TRAIN_SPLIT, 'split, zone_idx')} and split='test') t"""
_HASHED = """(select *, case when cast(concat('0x', substr(md5(concat(date, '|', zone_idx, '|42')), 1, 8)) as bigint)%10000<8000
    then 'train' else 'test' end as split from processed) h"""
_RULE_TEST = f"(select count(*) as n_rows, sum(fire_risk_label) as n_positive from {_HASHED} where split='test') t"


def _expected(name: str, source: str) -> str:
    return f"select '{name}' as model, true as in_range, true as better_than_chance, n_rows, cast(n_positive as bigint) as n_positive from {source}"


@query("m1_random_forest", _expected(FOREST.name, _TEST))
def m1(spark, sf):
    return _measured(_tabular(spark, sf, FOREST))


@query("m2_boosted_trees", _expected(BOOSTED.name, _TEST))
def m2(spark, sf):
    return _measured(_tabular(spark, sf, BOOSTED))


@query("m3_sequence_network", _expected(NETWORK.name, _TEST_WINDOWS))
def m3(spark, sf):
    return _measured(_network(spark, sf))


@query("m4_hash_split", f"select split, count(*) as n_rows, round(avg(fire_risk_label), 4) as positive_rate from {_HASHED} group by 1")
def m4(spark, sf):
    """Rows and positives per side of the hash split."""
    rows = L.split_rows(X.processed(spark, sf), ["date", "zone_idx"])
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("fire_risk_label"), 4).alias("positive_rate")
    )


@query(
    "m4_stratified_split",
    """select split, fire_risk_label, case split when 'train' then k else n-k end as n_rows from
    (select fire_risk_label, count(*) as n, cast(round(count(*)*0.8e0) as bigint) as k from processed group by 1) c
    cross join (values ('train'), ('test')) s(split)""",
)
def m4_exact(spark, sf):
    """Exact class shares on both sides."""
    rows = stored(X.processed(spark, sf).select("date", "zone_idx", "fire_risk_label"), "labels")
    rows = L.split_rows(rows, ["date", "zone_idx"], label="fire_risk_label")
    return rows.groupBy("split", "fire_risk_label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("m5_batch_scores", "select date, zone_idx, true as is_probability, true as cut_at_half from training where date>=DATE '2024-01-21'")
def m5(spark, sf):
    """Probabilities of the forest for every zone-day of the held-out side."""
    scored, _, _ = _tabular(spark, sf, FOREST)
    half = (F.col("risk_score") >= 0.5).cast("int")
    return scored.select(
        "date", "zone_idx", F.col("risk_score").between(0, 1).alias("is_probability"), (F.col("prediction") == half).alias("cut_at_half")
    )


@query("m6_compare_rule_labels", " union all ".join(_expected(s.name, _RULE_TEST) for s in (FOREST, BOOSTED)))
def m6(spark, sf):
    """All tabular models on the rule label over a hash split."""
    return _measured(*[_rule_model(spark, sf, spec) for spec in (FOREST, BOOSTED)])


@query(
    "m7_compare_observed_labels",
    " union all ".join([*(_expected(s.name, _TEST) for s in (FOREST, BOOSTED)), _expected(NETWORK.name, _TEST_WINDOWS)]),
)
def m7(spark, sf):
    """All models on the observed label over the temporal split."""
    return _measured(*[_tabular(spark, sf, spec) for spec in (FOREST, BOOSTED)], _network(spark, sf))


@query(
    "k6_feature_importance",
    "select unnest([" + ", ".join(f"'{c}'" for c in TRAINING_FEATURES) + "]) as feature, true as is_share, 1e0 as total",
)
def k6(spark, sf):
    """Each feature's share in the forest; the shares add up to one."""
    train, _ = _sides(spark, sf)
    model = _model(spark, sf, "observed", FOREST, lambda: L.fit(train, FOREST, TRAINING_FEATURES))
    shares = L.feature_importance(model, TRAINING_FEATURES, spark)
    total = shares.agg(F.round(F.sum("importance"), 6).alias("s")).select("s").scalar()
    return shares.select("feature", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"))
