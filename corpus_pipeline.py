"""A training corpus from raw documents: five stages, each on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of the
documents. Stages are written below ``spark.checkpoint.dir`` and read again, so that a lost
executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opsframe.llm.decontaminate import find_contamination, is_contaminated
from opsframe.llm.mixing import in_training_order, mix_sources
from opsframe.llm.ngram_join import ngram_components
from opsframe.llm.quality import quality_scores
from opsframe.llm.sharding import assign_shards
from opsframe.session import staged, use_local_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects: rows with a score below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, keep=tuple(docs.columns))
    return scored.where("predicted = 1").select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, by text hash among equal
    ids, and one row of those that repeat both.

    Texts without words belong to no group and all stay, as do rows of groups without any id.
    """
    found = staged(ngram_components(docs), "groups")
    named = found.where("n_shingles > 0 AND component_id IS NOT NULL AND doc_id IS NOT NULL")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "part")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("id"), F.col("first.part").alias("hash"))
    others = found.where("n_shingles = 0 OR component_id IS NULL")
    stay = first.withColumn("one", F.lit(True)).unionByName(
        others.select(F.col("doc_id").alias("id"), F.col("part").alias("hash"))
        .distinct()
        .withColumn("one", F.lit(False))
    )
    rows = docs.withColumn("_hash", F.xxhash64("text")).join(
        stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash"))
    )
    repeat = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0)))
    return rows.withColumn("_repeat", repeat).where("NOT one OR _repeat = 1").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of which a twentieth or more lies in passages of the benchmark."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("part").alias("_part")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_part"))
    return docs.join(bad, same, "left_anti")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row per copy of a document that it takes."""
    return in_training_order(mix_sources(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, shard and slot to the documents."""
    return assign_shards(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_to_weights),
    ("sharding", shard),
]

#: The classifier and best fit have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    use_local_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
