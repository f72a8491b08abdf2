"""Jaccard similarity join on word n-grams, by rare-first prefix filtering.

A text's set are the hashes of its distinct word n-grams. Texts with equal sets form a class, and
only classes are joined. One global order puts rare n-grams first, by counts in a table of fixed
size; two sets that are similar enough share an n-gram among their first few, so only these are
shuffled. Pairs that meet at an n-gram pass the length filter and the positional filter there,
then, once per pair, a suffix filter on bucket counts, and the whole sets are compared last.

A group of m classes at one n-gram isn't expanded into all pairs: each class is first paired with
two others, the one that meets most others at its n-grams (the text that the rest were copied from,
where there is one) and the one next to it in that order. What links these make is grouped, and a
second round pairs only classes of different groups, so that no link between groups is lost. That
round, too, emits no pair within a group of copies, and none that the suffix filter rules out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opsframe.llm import tallies
from opsframe.llm.components import components
from opsframe.llm.units import LOWER, blocks, grams, lists, mix, word_hashes, words
from opsframe.session import staged

SKETCH = 1 << 20
_BUCKETS = 64
_PAIRS = "a long, b long, na int, nb int"


def ngram_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(id, part, n_shingles, component_id, component) per row; linked are rows whose sets have a
    Jaccard similarity of ``percent`` or more. ``part`` is a hash of the text.

    ``component_id`` is the smallest id reachable by links. ``component`` names the component: two
    of them may have one smallest id where ids repeat. It is null for texts without n-grams. A-Z count as a-z, words are split at
    ASCII white space, and a text of fewer than ``n`` words is one n-gram. Empty and null texts
    have no n-gram and are linked with nothing. Rows are nodes of their own: rows that repeat an
    id link only by their texts. A null id is never a component's id (it is where no row of the
    component has one). Other columns are ignored. N-grams and sets are told apart by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("part"),
        F.col(text_col).alias("text"),
    )
    first = staged(
        texts.mapInArrow(
            _summaries(n), "kind int, id long, part long, n int, key long, sig binary"
        ),
        "ngram-sets",
    )
    texts = texts.drop("part")
    rows = first.where("kind = 0").select("id", "part", "n", "key", "sig")
    sketch = _summed(spark, first)
    classes = staged(
        rows.where("n > 0")
        .groupBy("key", "n")
        .agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig")),
        "ngram-classes",
    )
    prefix = texts.mapInArrow(
        _prefixes(n, percent, sketch), "token long, key long, n int, pos int, shared int, last long"
    )
    met = staged(
        prefix.repartition("token")
        .sortWithinPartitions("token", F.desc("shared"), "key")
        .mapInArrow(_meetings(percent), "kind int, token long, a long, b long, x int, y int, last long"),
        "ngram-meetings",
    )
    pairs = met.where("kind = 1").selectExpr("a", "b", "x na", "y nb")
    links, missed = _verified(texts, pairs, classes, n, percent, "first")
    groups = components(links)
    # The second round: only pairs of different groups that were not compared yet.
    runs = met.where("kind = 0").selectExpr("token", "a key", "x n", "y pos", "last")
    known = classes.join(groups, classes.key == groups.node, "left").select(
        "key", "sig", F.coalesce("component", "key").alias("label")
    )
    labelled = runs.join(known, "key").select("token", "key", "n", "pos", "last", "label", "sig")
    further = (
        labelled.repartition("token")
        .sortWithinPartitions("token", "n", "key")
        .mapInArrow(_crossings(percent), _PAIRS)
    )
    further = staged(further.distinct().join(missed, ["a", "b"], "left_anti"), "ngram-crossings")
    more, _ = _verified(texts, further, classes, n, percent, "second")
    groups = components(links.unionByName(more))
    ids = (
        classes.join(groups, classes.key == groups.node, "left")
        .withColumn("component", F.coalesce("component", "key"))
        .select("key", "rep", "component")
    )
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = ids.join(least, "component").select("key", "component_id", "component")
    return rows.join(ids, "key", "left").select(
        F.col("id").alias(id_col),
        "part",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "component",
    )


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text."""
    for row, data, offsets in blocks(batch.column("text")):
        low = LOWER[data]
        begins, ends, first = words(low, offsets)
        hashes = word_hashes(low, begins, ends)
        all_grams = grams(hashes, n)
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                found = np.sort(all_grams[a : b - n + 1])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield row + i, found[keep]
            elif b > a:
                yield row + i, grams(hashes[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield row + i, hashes[:0]


def _key(found: np.ndarray) -> np.ndarray:
    """The class of a set: a hash that any order of the same values gives."""
    total = np.array([found.sum(), mix(found ^ np.uint64(0xA5A5)).sum()], np.uint64)
    return mix(mix(total[:1]) + total[1:] + np.uint64(len(found)))[0]


def _summaries(n: int):
    """Per row the set's size, class and bucket counts; per task its n-gram counts."""

    def run(batches):
        counts = np.zeros(SKETCH, np.int32)
        seen: set[int] = set()
        for batch in batches:
            rows = batch.num_rows
            sizes, keys = np.zeros(rows, np.int32), np.zeros(rows, np.uint64)
            buckets = np.zeros((rows, _BUCKETS), np.uint8)
            for row, found in _sets(batch, n):
                if not len(found):
                    continue
                sizes[row], keys[row] = len(found), _key(found)
                held = np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=_BUCKETS)
                buckets[row] = np.minimum(held, 255)
                if int(keys[row]) not in seen:  # copies must not make an n-gram look frequent
                    seen.add(int(keys[row]))
                    np.add.at(counts, (found & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(rows, np.int32)),
                    batch.column("id"),
                    batch.column("part"),
                    pa.array(sizes),
                    pa.array(keys.view(np.int64)),
                    pa.array([x.tobytes() for x in buckets], pa.binary()),
                ],
                names=["kind", "id", "part", "n", "key", "sig"],
            )
        for part in tallies.parts({"": counts}):
            size = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(size, np.int32)),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.int64()),
                    part.column("part"),
                    pa.nulls(size, pa.int64()),
                    part.column("counts"),
                ],
                names=["kind", "id", "part", "n", "key", "sig"],
            )

    return run


def _summed(spark: SparkSession, first: DataFrame):
    """The counts of all tasks, as one broadcast table of fixed size (2 MB)."""
    parts = first.where("kind = 1").selectExpr("'' name", "n part", "sig counts")
    counts = tallies.summed(parts, SKETCH).get("", np.zeros(SKETCH, np.int64))
    return spark.sparkContext.broadcast(np.minimum(counts, 0xFFFF).astype(np.uint16))


def _prefixes(n: int, percent: int, sketch):
    """The first n-grams of each class, rare ones first; a task emits a class once.

    ``shared`` is the sum of their counts: about how many meetings the class has. ``last`` is the
    n-gram before, and the class itself at the first one.
    """

    def run(batches):
        counts = sketch.value
        seen: set[int] = set()
        for batch in batches:
            tokens, lasts, keys, sizes, lengths, shared = [], [], [], [], [], []
            for _, found in _sets(batch, n):
                if not len(found):
                    continue
                key = _key(found)
                if int(key) in seen:
                    continue
                seen.add(int(key))
                held = counts[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = held.astype(np.uint64) << np.uint64(48) | found >> np.uint64(16)
                order.sort()
                length = len(found) - -(-percent * len(found) // 100) + 1
                order = order[:length]
                tokens.append(order)
                lasts.append(np.concatenate([[key], order[:-1]]))
                shared.append(min(int((order >> np.uint64(48)).sum()), 0x7FFFFFFF))
                keys.append(key)
                sizes.append(len(found))
                lengths.append(length)
            if not keys:
                continue
            lengths = np.array(lengths)
            begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(np.repeat(np.array(keys, np.uint64).view(np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    pa.array((np.arange(lengths.sum()) - begin).astype(np.int32)),
                    pa.array(np.repeat(np.array(shared, np.int32), lengths)),
                    pa.array(np.concatenate(lasts).view(np.int64)),
                ],
                names=["token", "key", "n", "pos", "shared", "last"],
            )

    return run


def _possible(nx, ny, px, py, percent: int) -> np.ndarray:
    """Whether sets of nx and ny n-grams may be similar if px and py is where they first meet.

    That is the length filter, and the positional filter for the first n-gram in common: as each
    pair that is similar passes it there, it may fail at the others.
    """
    nx, ny = nx.astype(np.int64), ny.astype(np.int64)
    needed = -(-percent * (nx + ny) // (100 + percent))
    most = np.minimum(nx - px, ny - py)
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (most >= needed)


def _ordered(a, b, na, nb) -> list[np.ndarray]:
    """Pairs with the smaller class first, each once."""
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    na, nb = np.where(swap, nb, na), np.where(swap, na, nb)
    _, once = np.unique(
        mix(a.view(np.uint64)) * np.uint64(31) + b.view(np.uint64), return_index=True
    )
    return [a[once], b[once], na[once].astype(np.int32), nb[once].astype(np.int32)]


def _columns(batch: pa.RecordBatch, names: tuple, held) -> list[np.ndarray]:
    """The batch's columns as arrays, after the rows held from earlier batches."""
    cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
    return cols if held is None else [np.concatenate(x) for x in zip(held, cols)]


def _meetings(percent: int):
    """From rows sorted by n-gram: the rows of n-grams that several classes have (kind 0), and
    each class paired with the first and with the one before it (kind 1).

    Of the n-gram that a batch ends with, only its first and its last row stay in memory.
    """

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = 0 if held is None else len(held[0])
            cols = _columns(batch, ("token", "key", "n", "pos", "last"), held)
            token, key = cols[:2]
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            once[:kept] = True
            token, key, size, pos, before = (x[once] for x in cols)
            here = np.arange(len(token))
            begin = np.ones(len(token), bool)
            begin[1:] = token[1:] != token[:-1]
            end = np.ones(len(token), bool)
            end[:-1] = begin[1:]
            first = np.maximum.accumulate(np.where(begin, here, 0))
            many = ~(begin & end)
            # A single held row has waited for a second one; two were given out before.
            out = many & ((here >= kept) | (kept == 1))
            later = here[~begin & (here >= kept)]
            pairs = []
            for other in (first[later], later - 1):
                fine = _possible(size[other], size[later], pos[other], pos[later], percent)
                x, y = other[fine], later[fine]
                pairs.append((key[x], key[y], size[x], size[y]))
            a, b, x, y = _ordered(*[np.concatenate(c) for c in zip(*pairs)])
            rows, zero = int(out.sum()), np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), [rows, len(a)])),
                    pa.array(np.concatenate([token[out], zero])),
                    pa.array(np.concatenate([key[out], a])),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), b])),
                    pa.array(np.concatenate([size[out], x]).astype(np.int32)),
                    pa.array(np.concatenate([pos[out], y]).astype(np.int32)),
                    pa.array(np.concatenate([before[out], zero])),
                ],
                names=["kind", "token", "a", "b", "x", "y", "last"],
            )
            last = len(token) - 1
            at = sorted({int(first[last]), last})
            held = [c[at] for c in (token, key, size, pos, before)]

    return run


def _crossings(percent: int):
    """From rows sorted by n-gram and size: pairs of classes in different groups that may link.

    Stretches of one group are stepped over as a whole. Rows are held only as far back as the
    length filter reaches.
    """

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = 0 if held is None else len(held[0])
            held_sig = held.pop() if held else None
            cols = _columns(batch, ("token", "key", "n", "pos", "label", "last"), held)
            token, key, size, pos, label, before = cols
            sig = _buckets(batch.column("sig"))
            if held_sig is not None:
                sig = np.concatenate([held_sig, sig])
            here = np.arange(len(token))
            begin = np.ones(len(token), bool)
            begin[1:] = token[1:] != token[:-1]
            run_id = np.cumsum(begin)
            least = -(-percent * size.astype(np.int64) // 100)
            scale = int(size.max()) + 1
            order = run_id * scale + size
            low = np.searchsorted(order, run_id * scale + least, "left")
            stretch = begin.copy()
            stretch[1:] |= label[1:] != label[:-1]
            stretch = np.maximum.accumulate(np.where(stretch, here, 0))
            rows = here[old:]
            other = stretch[rows] - 1
            while True:
                near = other >= low[rows]
                rows, other = rows[near], other[near]
                if not len(rows):
                    break
                fine = _possible(size[other], size[rows], pos[other], pos[rows], percent)
                # Sets that also have the n-gram before in common have met there already.
                fine &= before[other] != before[rows]
                x, y = other[fine], rows[fine]
                close = _close(sig[x], sig[y], size[x], size[y], percent)
                if close.any():
                    x, y = x[close], y[close]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in _ordered(key[x], key[y], size[x], size[y])],
                        names=["a", "b", "na", "nb"],
                    )
                other = other - 1
                same = (other >= 0) & (label[other] == label[rows])
                other = np.where(same, stretch[other] - 1, other)
            back = int(low[-1])
            held = [*(c[back:] for c in cols), sig[back:]]

    return run


def _buckets(column) -> np.ndarray:
    """The bucket counts of each set, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _BUCKETS)


def _close(sx, sy, nx, ny, percent: int) -> np.ndarray:
    """The suffix filter: bucket counts give a least number of n-grams in which sets differ."""
    total = nx.astype(np.int64) + ny
    most = total - 2 * -(-percent * total // (100 + percent))
    return np.abs(sx.astype(np.int16) - sy).sum(axis=1) <= most


def _close_enough(percent: int):
    def run(batches):
        for batch in batches:
            x, y = _buckets(batch.column("sx")), _buckets(batch.column("sy"))
            nx, ny = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = pa.array(_close(x, y, nx, ny, percent))
            yield batch.select(["a", "b", "na", "nb"]).filter(keep)

    return run


def _verified(texts, pairs, classes, n, percent, label) -> tuple[DataFrame, DataFrame]:
    """(links, pairs compared that aren't links): each pair once, by its whole sets."""
    signatures = classes.select("key", "sig")
    left = signatures.select(F.col("key").alias("a"), F.col("sig").alias("sx"))
    right = signatures.select(F.col("key").alias("b"), F.col("sig").alias("sy"))
    pairs = staged(pairs.distinct(), f"ngram-pairs-{label}")
    near = staged(
        pairs.join(left, "a").join(right, "b").mapInArrow(_close_enough(percent), _PAIRS),
        f"ngram-near-{label}",
    )
    wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = wanted.join(classes, "key").select(F.col("rep").alias("wanted")).distinct()
    sets = staged(
        texts.join(wanted, texts.id.eqNullSafe(wanted.wanted), "left_semi").mapInArrow(
            _whole_sets(n), "key long, grams array<long>"
        ),
        f"ngram-whole-{label}",
    ).dropDuplicates(["key"])
    x = sets.select(F.col("key").alias("a"), F.col("grams").alias("gx"))
    y = sets.select(F.col("key").alias("b"), F.col("grams").alias("gy"))
    shared = F.size(F.array_intersect("gx", "gy"))
    links = staged(
        near.join(x, "a")
        .join(y, "b")
        .withColumn("shared", shared)
        .where(F.expr(f"100 * shared >= {percent} * (na + nb - shared)"))
        .select("a", "b"),
        f"ngram-links-{label}",
    )
    return links, pairs.select("a", "b")


def _whole_sets(n: int):
    def run(batches):
        for batch in batches:
            keys, values, lengths, held = [], [], [], 0
            for _, found in _sets(batch, n):
                if len(found):
                    keys.append(_key(found))
                    values.append(found.view(np.int64))
                    lengths.append(len(found))
                    held += len(found)
                if held > 1 << 20:
                    yield _set_rows(keys, values, lengths)
                    keys, values, lengths, held = [], [], [], 0
            if keys:
                yield _set_rows(keys, values, lengths)

    return run


def _set_rows(keys, values, lengths) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.array(keys, np.uint64).view(np.int64)),
            lists(np.concatenate(values), np.array(lengths), pa.int64()),
        ],
        names=["key", "grams"],
    )
