"""Training, scoring and comparing risk classifiers with Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from emberline.operators import metrics
from emberline.operators.alerts import fallback_risk
from emberline.sources.writers import stored


@dataclass(frozen=True)
class ForestSpec:
    # Forest size, depth and seed.
    trees: int = 300
    depth: int = 12
    seed: int = 42
    name: str = "Random Forest"
    weighting: str = "balanced"

    def stages(self, features: Sequence[str]):
        return [
            VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
            RandomForestClassifier(
                numTrees=self.trees, maxDepth=self.depth, weightCol="weight", labelCol="label", seed=self.seed
            ),
        ]


@dataclass(frozen=True)
class BoostedSpec:
    """Boosted trees. Columns are sampled per tree node (the MLlib rule)."""

    # Rounds, depth, step, row and column shares, seed.
    rounds: int = 300
    depth: int = 6
    step: float = 0.05
    share: float = 0.8
    seed: int = 42
    name: str = "Boosted Trees"
    weighting: str = "scale_pos"

    def stages(self, features: Sequence[str]):
        return [
            VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
            GBTClassifier(
                maxIter=self.rounds,
                maxDepth=self.depth,
                stepSize=self.step,
                subsamplingRate=self.share,
                featureSubsetStrategy=str(self.share),
                weightCol="weight",
                labelCol="label",
                seed=self.seed,
            ),
        ]


@dataclass(frozen=True)
class SequenceSpec:
    """Network over standardised flat windows; the input width follows the data."""

    hidden: tuple[int, ...] = (32, 16)
    iterations: int = 100
    seed: int = 42
    name: str = "Sequence Network"
    min_train: int = 50
    min_test: int = 20

    def stages(self, n_inputs: int):
        return [
            MultilayerPerceptronClassifier(
                layers=[n_inputs, *self.hidden, 2], maxIter=self.iterations, labelCol="label", seed=self.seed
            )
        ]


def fit(train: DataFrame, spec, features: Sequence[str], label: str = "fire_risk_label") -> PipelineModel:
    """Fits a tabular model on weighted rows."""
    rows = train.select(*features, F.col(label).cast("double").alias("label"))
    weighted = metrics.with_class_weight(rows, "label", "weight", spec.weighting)
    return Pipeline(stages=spec.stages(features)).fit(weighted)


def fit_sequences(train: DataFrame, spec: SequenceSpec, n_inputs: int) -> PipelineModel:
    """Fits the network on (features vector, label) windows."""
    rows = train.select("features", F.col("label").cast("double").alias("label"))
    return Pipeline(stages=spec.stages(n_inputs)).fit(rows)


def score(df: DataFrame, model, out: str = "risk_score", cutoff: float = 0.5) -> DataFrame:
    """Probability of class one and the label at the cutoff."""
    scored = model.transform(df)
    keep = [c for c in df.columns if c != "features"]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out)).withColumn(
        "prediction", (F.col(out) >= cutoff).cast("int")
    )


def risk_scores(df: DataFrame, model=None) -> DataFrame:
    """Adds risk_score from the model, or from the danger index without one."""
    if model is None:
        return df.withColumn("risk_score", fallback_risk("fwi"))
    flags = [name for name, kind in df.dtypes if kind == "boolean"]
    numeric = df.withColumns({f"_{f}": F.col(f) for f in flags}).withColumns(
        {f: F.col(f).cast("int") for f in flags}
    )
    scored = score(numeric, model).drop("prediction", *flags)
    return scored.withColumnsRenamed({f"_{f}": f for f in flags})


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance), highest first; as long as the feature list."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(features, [float(v) for v in values]))
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(
        F.desc("importance"), "feature"
    )


def split_rows(
    df: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 42, label: str | None = None
) -> DataFrame:
    """Adds ``split`` (train or test), stable for a key whatever the partitioning.

    By default a threshold on the first eight hex digits of an md5: no
    exchange, class shares equal in expectation. With ``label`` the shares are
    exact per class. The bucket in which the wanted count falls follows from
    counts alone, first over the high and then over the low hash bits; rows of
    other buckets are decided by comparison, and only those of that last
    bucket, 1 in 2^24 rows, are ranked. Rows are read several times then: pass
    a stored table.
    """
    if label is None:
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
        number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        part = F.pmod(number, F.lit(10_000)) < int(share * 10_000)
        return df.withColumn("split", F.when(part, "train").otherwise("test"))
    h = F.xxhash64(*keys, F.lit(seed))
    hashed = df.withColumns({"_h": h, "_high": F.shiftrightunsigned(h, 52), "_low": F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(0xFFF))})
    totals = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).select(label, F.round(F.col("_n") * share).cast("long").alias("_want"))

    def boundary(rows: DataFrame, bucket: str, wants: DataFrame) -> DataFrame:
        """Per class the bucket that holds the last wanted row, and how many
        rows of it are wanted; at most 4096 buckets a class are ordered."""
        sizes = rows.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("_n")).join(wants, label)
        before = F.sum("_n").over(Window.partitionBy(label).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
        sizes = sizes.withColumn("_before", before)
        held = sizes.where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want")))
        return held.select(label, F.col(bucket).alias(f"{bucket}_at"), (F.col("_want") - F.col("_before")).alias("_want"))

    high = boundary(hashed, "_high", totals)
    inside = hashed.join(high.drop("_want"), label).where("_high = _high_at").drop("_high_at")
    low = boundary(inside, "_low", high.select(label, "_want"))
    marks = high.drop("_want").join(low.withColumnRenamed("_want", "_left"), label)
    placed = hashed.join(marks, label, "left")
    order = F.struct("_high", "_low")
    at = F.struct(F.col("_high_at").alias("_high"), F.col("_low_at").alias("_low"))
    sure = placed.withColumn("split", F.when(order < at, "train").when((order > at) | at["_high"].isNull(), "test"))
    ranked = Window.partitionBy(label).orderBy("_h", *keys)
    edge = sure.where("split is null").withColumn("_i", F.row_number().over(ranked))
    edge = edge.withColumn("split", F.when(F.col("_i") <= F.col("_left"), "train").otherwise("test"))
    return sure.where("split is not null").select(*df.columns, "split").union(edge.select(*df.columns, "split"))


def evaluated(scored: DataFrame, name: str, label: str) -> DataFrame:
    """Named metric row. The metrics read the predictions several times, so
    these are stored first and the model runs once."""
    kept = stored(scored.select(label, "prediction", "risk_score"), "predictions")
    row = metrics.evaluate(kept, label, "prediction", "risk_score")
    return row.select(F.lit(name).alias("model"), *metrics.METRICS)


def fit_and_compare(
    train: DataFrame,
    test: DataFrame,
    specs: Sequence,
    features: Sequence[str],
    label: str = "fire_risk_label",
    train_windows: DataFrame | None = None,
    test_windows: DataFrame | None = None,
    sequence: SequenceSpec | None = None,
    n_inputs: int = 0,
    keep: Callable[[str, PipelineModel], None] | None = None,
) -> DataFrame:
    """Fits every model, scores the test side and returns the rounded table.

    Too few windows for the network are an error, not a shorter table. ``keep``
    receives each fitted model, to save it. All inputs are read many times:
    pass stored tables.
    """
    rows = []
    for spec in specs:
        model = fit(train, spec, features, label)
        if keep:
            keep(spec.name, model)
        rows.append(evaluated(score(test, model), spec.name, label))
    if sequence is not None and train_windows is not None and test_windows is not None:
        if not (enough(train_windows, sequence.min_train) and enough(test_windows, sequence.min_test)):
            raise ValueError(f"{sequence.name} needs {sequence.min_train} windows to train and {sequence.min_test} to test")
        model = fit_sequences(train_windows, sequence, n_inputs)
        if keep:
            keep(sequence.name, model)
        rows.append(evaluated(score(test_windows, model), sequence.name, "label"))
    return metrics.comparison(reduce(DataFrame.unionByName, rows))


def enough(df: DataFrame, n: int) -> bool:
    """At least n rows, looking at no more than n."""
    return df.limit(n).count() >= n


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_none(spark: SparkSession, path: str) -> PipelineModel | None:
    """The stored model, or None (then the fallback risk applies) if absent."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return PipelineModel.load(path) if fs.exists(hadoop_path) else None
