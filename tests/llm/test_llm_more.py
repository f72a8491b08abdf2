"""Hard negatives, archives and whitening against plain Python, and their odd inputs."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import warc
from opsframe.llm.hard_negatives import _Tree, hard_negatives
from opsframe.llm.whitening import whitened_rows

VECTORS = "vec_id long, label int, vector array<long>, score int, tag string"


def _mined(rows, anchors, positives=5, negatives=3):
    """All results, by comparing every pair; rows are (id, label, vector)."""
    rows = [r for r in rows if None not in r[:3]]
    out = []
    for a, label, vec in (r for r in rows if r[0] in anchors):
        scored = []
        for i, other, x in rows:
            if i != a:
                scored.append((-sum(p * q for p, q in zip(vec, x)), i, other))
        scored.sort()
        for score, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and -50 * score <= -100 * s[0] <= -95 * score]
            out += [(a, i, n, j, -score, -other) for n, (other, j, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def _found(spark, rows, anchors, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    found = hard_negatives(df, F.col("vec_id").isin(*anchors), **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("tile_rows", [16, 64, 4096])
def test_hard_negatives_with_ties_copies_and_odd_rows(spark, tile_rows):
    rng = random.Random(tile_rows)
    rows = [(i, rng.randrange(4), [rng.randrange(-6, 7) for _ in range(5)]) for i in range(200)]
    # A third of all rows are copies of one vector, of several labels; ids and whole rows repeat.
    rows += [(200 + i, i % 3, [5, 5, 4, 0, 1]) for i in range(100)]
    rows += [(7, 2, [5, 5, 4, 0, 1]), (7, 2, [5, 5, 4, 0, 1]), (8, 1, [4, 4, 4, 0, 0])]
    rows += [(400, None, [1] * 5), (401, 1, None), (None, 1, [9] * 5), (402, 1, []), (403, 0, [9, 9])]
    anchors = [0, 7, 8, 50, 199, 200, 299, 402, 403]
    assert _found(spark, rows, anchors, tile_rows=tile_rows) == _mined(rows, anchors)


def test_hard_negatives_of_few_rows_and_large_numbers(spark):
    assert _found(spark, [], [1]) == []
    assert _found(spark, [(1, 1, [1])], [1]) == []
    rows = [(1, 1, [1 << 20, 1]), (2, 1, [1 << 41, 0]), (3, 2, [(1 << 40) + 1, -7]), (4, 2, [1 << 41, 0])]
    rows += [(5, 3, [-(1 << 50), 1 << 30]), (6, 1, [-3, 0])]
    assert _found(spark, rows, [1, 2, 6]) == _mined(rows, [1, 2, 6])


def test_boxes_of_clustered_vectors_leave_most_tiles_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (24, 32))
    x = np.floor(centres[np.arange(6000) % 24] + rng.normal(0, 12, (6000, 32))).astype(int)
    rows = [(i, int(i % 24 // 3), v.tolist(), i % 50 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label long, vec array<long>, anchor boolean")
    tree = _Tree(df.withColumn("tag", F.col("id")), len(rows), 32, 5, 128)
    low = F.col("floor")
    asks = tree.anchors().select(
        "tag", "id", "label", "vec", F.array(low).alias("los"),
        F.array(F.lit((1 << 63) - 1)).alias("his"), F.array(low).alias("floors"),
    )
    pairs = asks.count() * tree.tiles
    assert asks.count() == 120
    # Of all (anchor, tile) pairs.
    assert tree.sent(asks, same=True).count() < 0.2 * pairs
    assert tree.sent(asks, same=False).count() < 0.5 * pairs


PAGES = "page_id long, url string, html string, size int, hash string"


def _pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://a/{i}", f"<p>{rng.random()} é</p>" * rng.randrange(200)) for i in range(60)]
    rows += [(100 + i, "http://copy", "same page") for i in range(40)]
    rows += [(7, "http://copy", "same page"), (7, "http://copy", "same page"), (None, "x", "same page")]
    rows += [(200, None, None), (201, "", ""), (None, "a\r\nb", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    rows += [(202, "http://long", "word " * 300_000), (203, "magic", "\x1f\x8b\x08" * 9)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, folder, compress):
    rows, pages = _pages(spark)
    warc.write_warc(pages, folder("warc"), compress=compress)
    found = warc.read_warc(spark, folder("warc"))
    assert warc.quarantined(found).count() == 0
    records = warc.sound_records(found)
    back = warc.with_payloads(records).select(
        warc.page_of(F.col("record_id")).cast("long").alias("page_id"),
        F.col("headers")["warc-target-uri"].alias("url"),
        F.col("payload").cast("string").alias("html"),
    )
    clean = [(i, url and url.replace("\r", "%0D").replace("\n", "%0A"), html or "") for i, url, html in rows]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, clean))
    kinds = {}
    for r in records.collect():
        kinds.setdefault((r["record_type"], r["payload_bytes"]), []).append(r)
    of = {r["headers"]["warc-refers-to"].split(":")[2] for r in kinds["revisit", 9]}
    assert len(kinds["response", 9]) == 1 and len(kinds["revisit", 9]) == 42 and of == {"139"}
    assert len({r["record_id"] for rs in kinds.values() for r in rs}) == len(rows)


def test_small_payloads_are_all_responses(spark, folder):
    _, pages = _pages(spark)
    warc.write_warc(pages, folder("warc"), least_bytes=10)
    found = warc.read_warc(spark, folder("warc"))
    assert {r["record_type"] for r in found.collect()} == {"response"}
    warc.write_warc(pages.limit(0), folder("none"))
    assert warc.read_warc(spark, folder("none")).count() == 0


def _archive(compress):
    records = [
        warc._record(
            {"page": str(i), "name": i, "url": "u", "size": 30, "payload": b"%030d" % i}
            | {"sha1": hashlib.sha1(b"%030d" % i).digest()},
            "2024-01-01T00:00:00Z",
        )
        + b"\r\n\r\n"
        for i in range(20)
    ]
    return [warc.zlib_member(r) for r in records] if compress else records


def _read_back(data):
    rows = list(warc.salvaged(data))
    ids = [int(r["record_id"].split(":")[2]) for r in rows if "record_id" in r]
    gaps = [(r["begin"], r["end"]) for r in rows if "problem" in r]
    # Records and gaps explain every byte, in order.
    place = 0
    for row in rows:
        assert row["begin"] == place or row["begin"] == rows[rows.index(row) - 1]["begin"]
        place = row["end"]
    assert place == len(data)
    return ids, gaps


@pytest.mark.parametrize("compress", [True, False])
def test_every_damage_leaves_the_other_records(compress):
    parts = _archive(compress)
    starts = np.cumsum([0] + [len(p) for p in parts])
    whole = b"".join(parts)
    assert _read_back(whole) == (list(range(20)), [])
    rng = random.Random(8)
    for _ in range(200):
        hit = rng.randrange(20)
        at = rng.randrange(starts[hit], starts[hit + 1])
        kind = rng.choice(["flip", "cut", "insert", "lose", "zero"])
        if kind == "flip" and not compress:
            # Nothing vouches for the headers of a plain record.
            at = starts[hit + 1] - rng.randrange(1, 100)
        if kind == "flip":
            data = whole[:at] + bytes([whole[at] ^ (1 << rng.randrange(8))]) + whole[at + 1 :]
        elif kind == "cut":
            data = whole[:at]
        elif kind == "insert":
            data = whole[:at] + bytes(rng.randrange(256) for _ in range(40)) + whole[at:]
        elif kind == "lose":
            data = whole[:at] + whole[starts[hit + 1] :]
        else:
            data = whole[:at] + bytes(starts[hit + 1] - at) + whole[starts[hit + 1] :]
        ids, gaps = _read_back(data)
        others = [i for i in range(20) if i != hit and (kind != "cut" or i < hit)]
        assert [i for i in ids if i != hit] == others, (kind, hit, at)
        assert all(b <= at + 40 and e >= at for b, e in gaps) or kind == "insert"


def test_archives_of_other_writers():
    head = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = list(warc.salvaged(gzip.compress(head + head) + head + b"\n\n" + head))
    assert [r.get("payload") for r in rows] == [b"abc", b"abc", b"abc", None, b"abc"]
    assert rows[0]["headers"]["x-long"] == "a b" and rows[3]["problem"] == "no version line"
    assert list(warc.salvaged(b"")) == []
    bad = head.replace(b"Content-Length: 3", b"WARC-Block-Digest: sha1:AAAA\r\nContent-Length: 3")
    rows = list(warc.salvaged(head + bad + head))
    assert [("problem" in r, r["begin"], r["end"]) for r in rows] == [
        (False, 0, len(head)),
        (True, len(head), len(head) + len(bad)),
        (False, len(head) + len(bad), 2 * len(head) + len(bad)),
    ]


EMBEDDINGS = "vec_id long, embedding array<float>, index int, x string"


def _whitened(vectors, components=8, scale=1024, offset=100_000):
    """(deviation, components of each row, share of each component) by numpy."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * scale) + offset
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return ((n * x - total) ** 2).sum(axis=1), centred @ axes / np.sqrt(values), values / centred.var(axis=0).sum()


@pytest.mark.parametrize("width, n", [(3, 50), (24, 700)])
def test_whitening_equals_numpy(spark, width, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, width)) * np.arange(1, width + 1) / 9
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    nan = float("nan")
    odd = [(n, None), (n + 1, [nan] * width), (n + 2, [None] + [0.0] * (width - 1)), (n + 3, [float("inf")])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], EMBEDDINGS).repartition(5)
    found = whitened_rows(df).collect()
    deviation, whitened, share = _whitened([v for _, v in rows])
    held = min(8, width)
    assert len(found) == n * held
    ours = np.zeros((n, held))
    for r in found:
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-12 and r["identity_error"] < 1e-9
        ours[r["vec_id"], r["component"] - 1] = r["whitened"]
    signs = np.sign((ours * whitened).sum(axis=0))
    assert np.abs(ours * signs - whitened).max() < 1e-8


def test_whitening_of_blocks_smaller_than_the_table(spark, monkeypatch):
    from opsframe.llm import whitening

    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 64)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    test_whitening_equals_numpy(spark, 11, 130)


def test_whitening_of_odd_tables(spark):
    def rows(*vectors):
        return whitened_rows(spark.createDataFrame([(1, v, 1, "x") for v in vectors], EMBEDDINGS)).collect()

    assert rows() == [] and rows([1.0, 2.0]) == [] and rows([], []) == [] and rows([1.0], [1.0]) == []
    # Shorter vectors go on in zeros; repeated ids count each; one dimension varies.
    found = rows([2.0, 1.0], [0.0, 1.0], [0.0, 1.0], [2.0, 1.0], [1.0, 1.0], [1.0, 1.0])
    assert {r["component"] for r in found} == {1} and len(found) == 6
    assert sorted(round(r["whitened"], 6) for r in found) == [-1.224745] * 2 + [0.0] * 2 + [1.224745] * 2
    huge = rows([3e38, 0.0], [-3e38, 0.0], [0.0, 1.0])
    # The first two are beyond any long, of the third row one entry is off by 3 * 1024 - 1024.
    assert {r["deviation"] for r in huge} == {None, 2048**2}
    assert len(rows([1.0], [], [2.0, 3.0])) == 6
