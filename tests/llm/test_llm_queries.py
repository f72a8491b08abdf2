"""Queries against their SQL on the smallest tables; the others against plain Python."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import canonical
from opsframe.llm.oracle import SQL

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours = canonical(QUERIES[name](spark, SF_DIR).toPandas().astype(object))
    assert ours == canonical(duck.sql(SQL[name]).df().astype(object))


def test_byte_dedup_equals_brute_force(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op2_suffix_array_dedup"](spark, SF_DIR).collect()}
    seen = set()
    for doc in sorted(documents):
        data = documents[doc].encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(data[at : at + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        row = rows[doc]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(data), sum(gone), spans)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_secrets_equal_plain_expressions(spark, documents):
    assign = (
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    rules = [("assign", assign, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    for row in QUERIES["op5_secret_scan"](spark, SF_DIR).collect():
        found = sorted(
            (m.start(), n, kind, m.end())
            for n, (kind, rule, group, least) in enumerate(rules)
            for m in re.finditer(rule, documents[row["doc_id"]], re.ASCII)
            if len(m.group(group)) >= least
        )
        text = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [
            sum(f[2] == kind for f in found) for kind, *_ in rules
        ]


def test_languages_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op3_language_id"](spark, sf_dir).collect()
    langs = {
        r["doc_id"]: r["lang"]
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    }
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in langs if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_quality_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {
        r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    }
    held = [
        r
        for r in QUERIES["op7_quality_classifier"](spark, sf_dir).collect()
        if r["held_out"] and r["doc_id"] in labels
    ]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.93 * len(held)


def test_shards(spark, documents):
    rows = QUERIES["op8_sharding"](spark, SF_DIR).collect()
    sizes, slots, homes = {}, {}, {}
    for r in rows:
        text = documents[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1
        assert r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(text, set()).add(r["shard"])
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_pipeline(spark, documents):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    rows = QUERIES["pipeline"](spark, SF_DIR).collect()
    assert {r["shard"] for r in rows} <= set(range(8))
    kept = {r["doc_id"] for r in rows}
    assert 0 < len(kept) <= len(documents)
    # One document of each group of equal texts.
    texts = [documents[d] for d in kept]
    assert len(texts) == len(set(texts))
