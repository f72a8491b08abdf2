"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsframe.llm.decontaminate import find_contamination
from opsframe.llm.knn_join import quantized, top_k
from opsframe.llm.language_id import identify_languages
from opsframe.llm.mixing import in_training_order, mix_sources
from opsframe.llm.ngram_join import ngram_components
from opsframe.llm.quality import quality_scores
from opsframe.llm.secret_scan import scan_secrets
from opsframe.llm.sharding import assign_shards, best_fit_decreasing
from opsframe.llm.substring_dedup import remove_repeated_passages
from opsframe.llm.suffix_dedup import remove_repeated_bytes
from opsframe.llm.suffixes import common_prefixes, suffix_array

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, part string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0, "x", "x"),
    (2, "", None, None, 0, None, None),
    (3, "plain words of a text that is no copy of any other one here", "en", "a", 1, "x", "x"),
    (3, "plain words of a text that is no copy of any other one here", "en", "a", 1, "x", "x"),
    (4, LONG, "en", "b", 2, "x", "x"),
    (5, LONG + " end", "de", None, 2, "x", "x"),
    (None, LONG, "en", "b", 2, "x", "x"),
    (6, "1234 !!", "fr", "c", 3, "x", "x"),
    (7, "token = abcdefgh12 é token=x", "en", "c", 3, "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(3, 1, 0), (4, 1, 0), (6, 0, None), (None, 1, 0), (7, None, 0)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "a TEXT that is no copy of any other one here plain words"), (2, "no copy"), (3, None), (None, "!")],
        "item_id long, text string",
    )


def test_suffix_arrays_of_random_texts():
    rng = random.Random(3)
    for _ in range(100):
        values = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 50))])
        order = suffix_array(values)
        assert list(order) == sorted(range(len(values)), key=lambda i: tuple(values[i:]))
        shared = common_prefixes(values, order, len(values) - np.arange(len(values)))
        for before, here, found in zip(order, order[1:], shared[1:]):
            pairs = itertools.takewhile(lambda p: p[0] == p[1], zip(values[before:], values[here:]))
            assert found == len(list(pairs))


def test_best_fit_decreasing():
    assert best_fit_decreasing([5, 4, 3, 2, 2], 8) == [0, 1, 0, 1, 1]
    assert best_fit_decreasing([9, 1], 8) == [0, 1]
    assert best_fit_decreasing([], 8) == []


def test_byte_dedup(docs, none):
    rows = remove_repeated_bytes(docs).collect()
    assert len(rows) == len(ROWS) and remove_repeated_bytes(none).count() == 0
    size = {r["doc_id"]: len(r["kept"]) for r in rows}
    # The null id comes first, so its long text is the one that stays.
    assert size[None] == len(LONG) and size[4] == 0 and size[5] == 4 and size[1] == size[2] == 0
    assert size[3] == len(ROWS[2][1])


def test_passage_dedup_and_blocks(docs, none):
    rows = remove_repeated_passages(docs).collect()
    assert len(rows) == len(ROWS) and remove_repeated_passages(none).count() == 0
    kept = {r["doc_id"]: r["kept"].decode() for r in rows}
    assert kept[None] == LONG and kept[4] == "" and kept[5] == "end" and kept[1] == ""


def test_blocks_of_one_anchor_are_merged(spark):
    rng = random.Random(5)
    core = "the quick brown fox jumps over the lazy dog and then it runs away"
    texts = []
    for i in range(60):
        word = [f"u{rng.randrange(6)}" for _ in range(12)]
        texts.append((i, " ".join(word[:6]) + " " + core + " " + " ".join(word[6:])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for dedup, column in ((remove_repeated_bytes, "kept"), (remove_repeated_passages, "kept")):
        whole = {r["doc_id"]: r[column] for r in dedup(df).collect()}
        cut = {r["doc_id"]: r[column] for r in dedup(df, block=3).collect()}
        assert whole == cut


def test_languages(docs, none):
    rows = {(r["doc_id"], r["lang_pred"]) for r in identify_languages(docs).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= rows
    assert identify_languages(none).count() == 0
    assert {r["lang_pred"] for r in identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_contamination(docs, none, items):
    rows = {r["doc_id"]: r for r in find_contamination(docs, items).collect()}
    assert rows[3]["item_ids"] == ["2"] and rows[3]["n_hit"] == 2
    assert rows[1]["n_words"] == 0 and rows[4]["n_hit"] == 0
    assert find_contamination(none, items).count() == 0
    assert all(r["n_hit"] == 0 for r in find_contamination(docs, items.limit(0)).collect())


def test_secrets(docs, none):
    rows = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in scan_secrets(docs).collect()}
    assert rows[7] == [("assign", 0, 18)] and rows[1] == [] and rows[2] == []
    assert scan_secrets(none).count() == 0


def test_quality(docs, none, labels):
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_shards(docs, none):
    rows = assign_shards(docs).collect()
    assert len(rows) == len(ROWS) and assign_shards(none).count() == 0
    homes = {}
    for r in rows:
        homes.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_mixing(docs, none):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and mix_sources(none).count() == 0
    taken, target = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(taken[s] == int(target[s]) for s in taken)
    assert in_training_order(mix_sources(docs)).count() > 0


def test_ngram_join(docs, none):
    rows = ngram_components(docs).collect()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(ROWS) and ngram_components(none).count() == 0
    assert {(1, 0, 1), (2, 0, 2), (6, 1, 6)} <= found
    assert {c for d, _, c in found if d in (None, 4, 5)} == {4}


def test_top_k(spark):
    nan = float("nan")
    rows = [(i, [0.5, 0.25]) for i in range(20)]
    rows += [(20, None), (21, [nan, 1.0]), (22, [None, 1.0]), (23, [1.0]), (24, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.select("vec_id", quantized(F.col("embedding")).alias("vector"))
    found = top_k(df.where("vec_id % 10 = 0"), df).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [
        (0, 1, 23, 128 * 256), *((0, i + 1, i, 128 * 128 + 64 * 64) for i in range(1, 5)),
        (10, 1, 23, 128 * 256), *((10, i + 2, i, 128 * 128 + 64 * 64) for i in range(4)),
    ]
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_stages_keep_columns(spark, docs, none, labels, items, folder):
    labels.write.parquet(folder("labels.parquet"))
    items.write.parquet(folder("benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, none):
            assert stage(spark, df, folder(".")).columns == df.columns, name
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in one) == [1, 2, 3, 4, 6, 7]
