"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next one's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import decontaminate, line_templates, near_dups, quality_rules, sentencepieces
from emberline.sources.writers import stored


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no column of an
    operator meets one of the same name."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality_rules.fit(docs, _read(spark, sf_dir, "labels"))
    return _unpacked(quality_rules.quality_rules(_packed(docs), model).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so do documents that consisted of nothing else.

    Documents that had no words before stay as they are.
    """
    left = line_templates.line_dedup(_packed(docs))
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" not in docs.columns:
        return _unpacked(left, docs)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.col("n_dropped") > 0, chars).otherwise(F.col("_rest").getField("n_chars"))
    return _unpacked(left.withColumn("_rest", F.col("_rest").withField("n_chars", changed)), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return _unpacked(near_dups.near_duplicates(_packed(docs)).where("kept"), docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.contamination(_packed(docs), _read(spark, sf_dir, "benchmark"))
    return _unpacked(found.where("n_hit = 0"), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; decoding them gives the text back, which
    is checked on the way."""
    coded = sentencepieces.coded(docs.select("doc_id", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to their text")))
    return coded.select("doc_id", ids.alias("ids"), "n_ids", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", leaks),
    ("sentencepiece", pieces),
]

# The quality model and the tokenizer can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
