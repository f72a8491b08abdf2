"""Inputs on which operators once did less than the whole job, against plain Python."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from opsframe.llm.knn_join import top_k
from opsframe.llm.mixing import in_training_order, mix_sources
from opsframe.llm.ngram_join import ngram_components
from opsframe.llm.quality import features
from opsframe.llm.secret_scan import scan_secrets
from opsframe.llm.sharding import assign_shards, fewest_bytes
from opsframe.llm.substring_dedup import remove_repeated_passages
from opsframe.llm.suffix_dedup import remove_repeated_bytes


def test_a_third_of_all_bytes_in_one_group_leaves_no_shard_empty(spark):
    rng = random.Random(1)
    texts = [f"{i} " + "x" * rng.randrange(100, 300) for i in range(2000)]
    hot = "y" * 99
    texts += [hot] * (sum(len(t) + 1 for t in texts) // 200)
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    rows = assign_shards(df).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(rows) == len(texts) and set(sizes) == set(range(8))
    (home,) = {r["shard"] for r in rows if r["text"] == hot}
    assert {r["text"] for r in rows if r["shard"] == home} == {hot}
    others = [size for shard, size in sizes.items() if shard != home]
    assert max(others) - min(others) <= 300


def test_bins_of_large_and_of_few_items():
    def loads(sizes, shards):
        total = [0] * shards
        for size, shard in zip(sizes, fewest_bytes(sizes, shards)):
            total[shard] += size
        return sorted(total)

    assert loads([100, 60, *[1] * 30], 4) == [15, 15, 60, 100]
    assert loads([2] * 10, 8) == [2, 2, 2, 2, 2, 2, 4, 4] and loads([5, 3], 4) == [0, 0, 3, 5]
    assert fewest_bytes([], 8) == [] and loads([7], 1) == [7]


def test_texts_of_one_id_with_like_hashes_keep_apart(spark):
    # ``again`` repeats its own words, ``once`` repeats nothing; their hashes agree in 24 bits.
    word = F.concat(F.lit("w"), F.col("id").cast("string"))
    again = F.array_join(F.array_repeat(word, 60), " ")
    once = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat_ws("x", word, i)), " ")
    ids = spark.range(30_000)
    low = F.pmod(F.xxhash64("text"), F.lit(1 << 24))
    left = ids.select(again.alias("text")).select(F.col("text").alias("again"), low.alias("low"))
    right = ids.select(once.alias("text")).select(F.col("text").alias("once"), low.alias("low"))
    pair = left.join(right, "low").orderBy("again").first()
    rows = [(None, pair["again"]), (None, pair["once"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (remove_repeated_bytes, remove_repeated_passages):
        kept = {r["kept"].decode() for r in dedup(df).collect()}
        assert pair["once"] in kept and pair["again"] not in kept and len(kept) == 2


def _removed(units, window, seen):
    """Which units lie in a window that was seen earlier."""
    gone = [False] * len(units)
    for at in range(len(units) - window + 1):
        held = tuple(units[at : at + window])
        if held in seen:
            gone[at : at + window] = [True] * window
        seen.add(held)
    return gone


@pytest.mark.parametrize("window", [152, 400])
def test_windows_longer_than_a_span_had_room_for(spark, window):
    rng = random.Random(window)
    core = [f"{rng.randrange(1000)}" for _ in range(1200)]
    texts = []
    for i in range(6):
        at = rng.randrange(300)
        texts.append(" ".join([f"a{i}"] * (i * 7) + core[at : at + 700] + [f"b{i}"]))
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in remove_repeated_bytes(df, length=window).collect()}
    seen = set()
    for i, text in enumerate(texts):
        gone = _removed(text.encode(), window, seen)
        assert found[i] == bytes(b for b, g in zip(text.encode(), gone) if not g)
    found = {r["doc_id"]: r["kept"].decode() for r in remove_repeated_passages(df, window=window).collect()}
    seen = set()
    for i, text in enumerate(texts):
        gone = _removed(text.split(), window, seen)
        assert found[i].split() == [w for w, g in zip(text.split(), gone) if not g]


@pytest.mark.parametrize("pivots", [4, 64])
def test_top_k_with_repeated_ids(spark, pivots):
    rng = random.Random(pivots)
    rows = [(i, [rng.randrange(-9, 9) for _ in range(4)]) for i in range(300)]
    # Own rows rank first: many copies of one vector, many vectors of one id, few of a third.
    rows += [(7, [40, 40, 40, 40])] * 30 + [(8, [40, 40, 40, 40]), (9, [40, 40, 40, 40])]
    rows += [(50, [30 + i % 9, 30, 30 + i, 30]) for i in range(40)] + [(60, [20, 20, 20, 20])] * 3
    rows += [(i, [1, 1, 1, 1]) for i in (70, 70, 71, 71, 72)] * 2
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    asked = [r for r in rows if r[0] in (0, 7, 8, 50, 60, 70, 299)]
    asked = spark.createDataFrame(asked, df.schema).distinct()
    expected = []
    for q, vec in asked.collect():
        scores = [(-sum(a * b for a, b in zip(vec, x)), i) for i, x in rows if i != q]
        expected += [(q, n, i, -score) for n, (score, i) in enumerate(sorted(scores)[:5], 1)]
    found = [tuple(r) for r in top_k(asked, df, pivots=pivots).collect()]
    assert sorted(found) == sorted(expected)


def test_pipeline_keeps_unrelated_texts_of_one_id(spark):
    def text(seed, last="end"):
        rng = random.Random(seed)
        return " ".join([f"w{rng.randrange(10_000)}" for _ in range(60)] + [last])

    # Two texts of id 1, each with a near copy of its own; a lone text of id 1; id 5 repeats a row.
    rows = [(1, text("a")), (2, text("a", "x")), (1, text("b")), (3, text("b", "x")), (1, text("c"))]
    rows += [(5, text("d"))] * 2 + [(None, text("e")), (6, text("e", "x"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()
    expected = [(1, text("a")), (1, text("b")), (1, text("c")), (5, text("d")), (6, text("e", "x"))]
    assert sorted(tuple(r) for r in kept) == sorted(expected)


def _morse(n: int) -> str:
    """Words of 2**n letters that polynomials modulo 2**64 can't tell from their opposites."""
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))


def test_words_and_spans_that_weak_hashes_confuse(spark):
    a = _morse(10)
    b = a.translate(str.maketrans("ab", "ba"))
    filler = [[f"{c}{i}" for i in range(9)] for c in "xyz"]
    texts = [" ".join([*filler[0], word, *filler[1], "end"]) for word in (a, b)]
    # Nothing that the two share is as long as a window or makes four fifths of their shingles.
    texts += [" ".join([word] * 20) for word in (a, b)]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"].decode() for r in remove_repeated_passages(df).collect()}
    assert kept == dict(enumerate(texts))
    found = {r["doc_id"]: r["component_id"] for r in ngram_components(df).collect()}
    assert found == {i: i for i in range(4)}
    joined = spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"].decode() for r in remove_repeated_bytes(joined, length=1024).collect()}
    assert kept == {0: a, 1: b}


def test_secrets_on_every_line_of_a_long_text(spark):
    rng = random.Random(11)
    text = "\n".join(f"{rng.getrandbits(256):064x}" for _ in range(1 << 14))
    rows = spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")
    begin = time.monotonic()
    found = {r["doc_id"]: r["spans"] for r in scan_secrets(rows).collect()}
    # A pass over all matches for each line would take minutes.
    assert time.monotonic() - begin < 60
    for i, lead in ((1, 0), (2, 1)):
        assert [(s["kind"], s["start"], s["end"]) for s in found[i]] == [
            ("hex", 65 * n + lead, 65 * n + 64 + lead) for n in range(1 << 14)
        ]


def test_features_do_not_depend_on_the_text_before():
    texts = ["Short one.", "", "zz", "Short one.", "a", None, "Short one."]
    together = np.concatenate(list(features(pa.array(texts))))
    alone = np.concatenate([np.concatenate(list(features(pa.array([t], pa.string())))) for t in texts])
    assert np.array_equal(together, alone)


def test_mixing_query_reads_its_rows_from_the_mix_in_training_order(spark):
    found = contract.queries()["op9_source_mixing"](spark, "/root/testdata/sf0.01")
    rows = {r["doc_id"]: r for r in found.collect()}
    copies = [r for file in sorted(found.inputFiles()) for r in spark.read.parquet(file).collect()]
    at = [r["position"] for r in copies if r["position"] is not None]
    assert at == sorted(at) and all(r["position"] is None for r in copies[len(at) :])
    assert any(r["copy"] == 2 for r in copies) and {r["doc_id"] for r in copies} == set(rows)
    taken, places = dict.fromkeys(rows, 0), {}
    for r in copies:
        taken[r["doc_id"]] += r["words"]
        places[r["doc_id"], r["copy"]] = r["position"]
    for i, r in rows.items():
        assert r["taken"] == taken[i]
        for copy, name in ((1, "first_at"), (2, "again_at")):
            place = places.get((i, copy))
            assert r[name] == (None if place is None else int(place * 1_000_000))


def _sources(rng):
    """A source without any words, one too small for its share, and one far larger than its own."""
    rows = [(None, None, "w"), (1, " ", "w"), (2, "a b c", "x"), (2, "a b c", "x"), (None, "d e", "x")]
    words = lambda: " ".join(["v"] * rng.randrange(5))
    rows += [(i, words(), "y") for i in range(100, 1100)]
    return rows + [(i, words(), rng.choice(["z", None])) for i in range(2000, 6000)]


def test_training_order_holds_every_copy_once_and_is_the_same_each_time(spark):
    rows = _sources(random.Random(9))
    shape = "doc_id long, text string, source string"
    df = spark.createDataFrame(rows, shape)
    mixed = mix_sources(df)
    expected, target = [], {}
    for r in mixed.collect():
        target[r["source"]] = int(r["target"])
        first, again = min(r["taken"], r["size"]), max(r["taken"] - r["size"], 0)
        expected.append((r["doc_id"], r["text"], r["source"], 1, first, r["first_at"]))
        if again:
            expected.append((r["doc_id"], r["text"], r["source"], 2, again, r["again_at"]))
    names = ("doc_id", "text", "source", "copy", "words", "position")
    order = [tuple(r[n] for n in names) for r in in_training_order(mixed, every=True).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in (r[5], r[3], r[0], r[4])) + (str(r[1:3]),)
    assert sorted(order, key=key) == sorted(expected, key=key)
    taken = dict.fromkeys(target, 0)
    for r in order:
        taken[r[2]] += r[4]
        assert (r[4] == 0) == (r[5] is None)
    assert taken == target
    at = [r[5] for r in order if r[4]]
    assert at == sorted(at) and len(at) < len(order) and all(r[4] == 0 for r in order[len(at) :])
    again = spark.createDataFrame(rows[::-1], shape).repartition(7)
    again = in_training_order(mix_sources(again), every=True).collect()
    assert order == [tuple(r[n] for n in names) for r in again]
    # As whole texts: copies of which at least half is taken, at the same places.
    half = [r for r in order if r[4] and 2 * r[4] >= len(r[1].split())]
    assert [tuple(r[n] for n in names) for r in in_training_order(mixed).collect()] == half


def test_documents_that_the_mix_leaves_out_do_not_meet_in_one_task(spark):
    rows = spark.range(8000).selectExpr(
        "id AS doc_id", "'a b' AS text", "if(id < 400, 'x', if(id < 800, 'y', 'z')) AS source"
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        order = in_training_order(mix_sources(rows, weights=(5, 2, 0.5), percent=20), every=True)
        counts = order.groupBy(F.spark_partition_id()).agg(F.count("*"), F.count("position")).collect()
    finally:
        spark.conf.unset(coalesce)
    assert sum(n for _, n, _ in counts) >= 8000 and sum(k for *_, k in counts) < 4000
    assert max(n for _, n, _ in counts) < 4000
