"""One query per operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from opsframe.llm import oracle
from opsframe.llm.decontaminate import find_contamination, is_contaminated
from opsframe.llm.hard_negatives import hard_negatives
from opsframe.llm.knn_join import quantized, top_k
from opsframe.llm.language_id import identify_languages
from opsframe.llm.mixing import in_training_order, mix_sources
from opsframe.llm.ngram_join import ngram_components
from opsframe.llm.quality import quality_scores
from opsframe.llm.secret_scan import BASE_KINDS, scan_secrets
from opsframe.llm.sharding import assign_shards
from opsframe.llm.substring_dedup import remove_repeated_passages
from opsframe.llm.suffix_dedup import remove_repeated_bytes
from opsframe.llm.warc import page_of, read_warc, sound_records, write_warc
from opsframe.llm.whitening import whitened_rows
from opsframe.session import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", quantized(F.col("embedding")).alias("vector")
    )
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(_documents(spark, sf_dir))
    size = F.octet_length("text").cast("long")
    return found.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_documents(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(
        _documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_span_text(base), 256).alias("base_sha256"),
        _span_text(F.col("spans")).alias("spans"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_passages(_documents(spark, sf_dir))
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["begin"]
    )
    return found.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    # The mix itself, every copy in training order; a document's row is read off its first copy.
    copies = staged(in_training_order(mixed.drop("text", "source"), every=True), "mix")
    # Training positions in millionths of the whole training.
    at = {name: F.floor(F.col(name) * 1_000_000) for name in ("first_at", "again_at")}
    return copies.where("copy = 1").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        *[time.cast("long").alias(name) for name, time in at.items()],
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_documents(spark, sf_dir)).drop("part", "component")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        quantized(F.col("embedding")).alias("vector"),
    )
    return hard_negatives(vectors, vec_id % 50 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    found = sound_records(read_warc(spark, path))
    headers = F.col("headers")
    return found.select(
        page_of(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        F.split_part(headers["warc-payload-digest"], F.lit(":"), F.lit(2)).alias("payload_digest"),
        "record_type",
        page_of(headers["warc-refers-to"]).cast("long").alias("refers_to"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(_table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, Query]:
    found = [
        op1_exact_top_k,
        op2_suffix_array_dedup,
        op3_language_id,
        op4_benchmark_decontamination,
        op5_secret_scan,
        op6_substring_dedup,
        op7_quality_classifier,
        op8_sharding,
        op9_source_mixing,
        op10_ngram_jaccard_join,
        op11_hard_negatives,
        op12_warc,
        op13_whitening,
    ]
    return {query.__name__: query for query in found} | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    return oracle.SQL
