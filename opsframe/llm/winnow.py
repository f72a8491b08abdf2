"""Repeated windows of units (bytes or words): finding the few spans that have to be compared.

A window's anchor is its k-gram with the least hash, the leftmost of equals; successive windows
with one anchor form a span. Equal windows have equal anchors, so a window is only ever compared
with windows of spans at the same anchor hash. Spans of equal content are resolved by their hash
alone: all but the first one repeat it. What is left, the first spans of different content at one
anchor hash, is cut into blocks of bounded size for an index to compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsframe.llm.units import Spans, blocks, mix, prefix_sums, span_hash, word_hashes, words
from opsframe.session import staged

#: Spans that one block holds at one anchor hash.
BLOCK = 4096

_PLACE_BITS = 24
_PIECE = 1 << 23
#: A span's place is its begin and, in the low bits, the number of its windows less one.
_MORE_BITS = 31
_SHAPE = "kind int, hash long, ctx long, id long, part long, place long"
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes themselves, and where each text begins."""
    return data.astype(np.uint64), offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the place of each text's first word."""
    begins, ends, first = words(data, offsets)
    return word_hashes(data, begins, ends), first


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, part, text): the id as given and, for comparisons, without nulls; ``part`` is a
    64-bit hash that tells texts which share an id apart. A null id comes before all others."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text_col).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def spans(
    texts: DataFrame, units: Units, window: int, gram: int, block: int = BLOCK
) -> DataFrame:
    """Two kinds of rows over (id, part, begin, end), the places in units, end exclusive.

    Kind 1: all windows between begin and end occur earlier. Kind 2: the first span of its
    content, one of several contents at ``hash``, in block ``block`` of them; what of it occurs
    earlier is open. Windows that are in neither occur nowhere earlier. Earlier is by id, then for
    texts that share an id by a hash of the text, then by place.
    """
    if not 0 < gram <= window <= _PIECE:
        raise ValueError(f"window: from {gram} to {_PIECE} units")
    found = texts.select("id", "part", "text").mapInArrow(_anchored(units, window, gram), _SHAPE)
    split = (
        found.repartition("hash")
        .sortWithinPartitions("kind", "hash", "ctx", "id", "part", "place")
        .mapInArrow(_resolved(block), "kind int, hash long, block int, id long, part long, place long")
    )
    begin = F.shiftright("place", _MORE_BITS)
    more = F.col("place").bitwiseAND(F.lit((1 << _MORE_BITS) - 1))
    return staged(
        split.select(
            "kind",
            "hash",
            "block",
            "id",
            "part",
            begin.alias("begin"),
            (begin + more + window).alias("end"),
        ),
        "spans",
    )


def per_text(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """(id, part, spans): the rows of each text; there are fewer of them than its units."""
    return rows.groupBy("id", "part").agg(F.collect_list(F.struct(*columns)).alias("spans"))


def with_spans(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    return texts.join(rows, ["id", "part"], how)


def contents(texts: DataFrame, open_spans: DataFrame, units: Units, kind: str) -> DataFrame:
    """(hash, block, id, part, begin, units) of each open span; ``kind`` is binary or array<long>."""
    listed = per_text(open_spans, "hash", "block", "begin", "end")
    return with_spans(texts.select("id", "part", "text"), listed, "inner").mapInArrow(
        _contents(units, kind),
        f"hash long, block int, id long, part long, begin long, units {kind}",
    )


def mask(length: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` units some span covers."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def joined_windows(places: np.ndarray, breaks: np.ndarray, window: int) -> tuple:
    """(index of the first, begin, end) of runs of successive windows; ``breaks`` starts a run."""
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | breaks[1:]
    heads = np.flatnonzero(new)
    last = np.append(heads, len(places))[1:] - 1
    return heads, places[heads], places[last] + window


def pieces(hashes: np.ndarray, contents: np.ndarray, last: np.ndarray, order: np.ndarray) -> tuple:
    """(rows in order, head of each piece, range of each head): windows dealt by a hash of their
    content into ranges, eight for each block that their anchor has, and by ``order`` in these."""
    bits = 3 + np.ceil(np.log2(last + 1.0)).astype(np.uint64)
    ranges = (contents >> (np.uint64(64) - bits)).astype(np.int64)
    rows = np.lexsort((order, ranges, hashes))
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[rows][1:] != hashes[rows][:-1]) | (ranges[rows][1:] != ranges[rows][:-1])
    heads = np.flatnonzero(new)
    return rows, heads, ranges[rows][heads].astype(np.int32)


def last_blocks(open_spans: DataFrame) -> DataFrame:
    """(hash, last): anchors whose spans fill several blocks, and the number of the last one."""
    return open_spans.where("block > 0").groupBy("hash").agg(F.max("block").alias("last"))


def sharded(rows: DataFrame, solve: Callable, shape: str, limit: int) -> DataFrame:
    """``solve`` on successive shards of whole blocks, each of about ``limit`` bytes of units."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column("hash").to_numpy()
            numbers = batch.column("block").to_numpy()
            if held:
                last = held[-1]
                same = (
                    hashes[0] == last.column("hash")[-1].as_py()
                    and numbers[0] == last.column("block")[-1].as_py()
                )
                if size >= limit and not same:
                    yield from solve(pa.Table.from_batches(held))
                    held, size = [], 0
            new = np.flatnonzero((hashes[1:] != hashes[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            lengths = _lengths(batch.column("units"))
            total = np.cumsum(lengths)
            begin = 0
            while begin < batch.num_rows:
                base = total[begin - 1] if begin else 0
                full = int(np.searchsorted(total, base + max(limit - size, 0)))
                cut = new[np.searchsorted(new, max(full, begin + 1)) :][:1]
                cut = int(cut[0]) if len(cut) else batch.num_rows
                held.append(batch.slice(begin, cut - begin))
                size += int(total[cut - 1] - base)
                if cut < batch.num_rows:
                    yield from solve(pa.Table.from_batches(held))
                    held, size = [], 0
                begin = cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    return (
        rows.repartition("hash", "block")
        .sortWithinPartitions("hash", "block")
        .mapInArrow(run, shape)
    )


def _lengths(column) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.value_lengths().to_numpy(zero_copy_only=False) * 8
    return np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :])


def _anchored(units: Units, window: int, gram: int):
    """Per batch: the first span of each content (kind 0), and the others as repeats (kind 1)."""

    def run(batches):
        for batch in batches:
            ids, parts = batch.column("id").to_numpy(), batch.column("part").to_numpy()
            found = []
            for row, data, offsets in blocks(batch.column("text")):
                values, begins = units(data, offsets)
                for text, a, more, hashes, ctx in _anchors(values, begins, window, gram):
                    text = text + row
                    place = ((a - begins[text - row]) << _MORE_BITS) | more
                    found.append((hashes, ctx, ids[text], parts[text], place))
            if not found:
                continue
            hashes, ctx, id_, part, place = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((place, part, id_, ctx))
            hashes, ctx, id_, part, place = (x[order] for x in (hashes, ctx, id_, part, place))
            first = np.ones(len(ctx), bool)
            first[1:] = ctx[1:] != ctx[:-1]
            head = np.maximum.accumulate(np.where(first, np.arange(len(ctx)), 0))
            # Without repeated rows.
            keep = first | (id_ != id_[head]) | (part != part[head]) | (place != place[head])
            first, hashes, ctx, id_, part, place = (
                x[keep] for x in (first, hashes, ctx, id_, part, place)
            )
            # Repeats go anywhere: only what may be first has to meet at its hash.
            anywhere = mix(id_.view(np.uint64)) ^ part.view(np.uint64)
            anywhere = mix(place.view(np.uint64) ^ mix(anywhere))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((~first).astype(np.int32)),
                    pa.array(np.where(first, hashes, anywhere).view(np.int64)),
                    pa.array(ctx.view(np.int64)),
                    pa.array(id_),
                    pa.array(part),
                    pa.array(place),
                ],
                names=["kind", "hash", "ctx", "id", "part", "place"],
            )

    return run


def _anchors(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """(text, begin, windows less one, anchor hash, content hash) of the spans of all windows."""
    for begin in range(0, max(len(values), 1), _PIECE):
        piece = values[begin : begin + _PIECE + window - 1]
        count = len(piece) - window + 1
        if count <= 0:
            return
        count = min(count, _PIECE)
        sums = prefix_sums(piece)
        at = np.arange(len(piece) - gram + 1)
        grams = span_hash(sums, at, at + gram)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = (grams & ~low) | at.astype(np.uint64)
        width, reach = 1, window - gram + 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: width - reach], least[reach - width :])
        anchor = (least[:count] & low).astype(np.int64)
        inside = np.zeros(count + 1, np.int64)
        long_enough = np.diff(offsets) >= window
        np.add.at(inside, np.clip(offsets[:-1][long_enough] - begin, 0, count), 1)
        np.add.at(inside, np.clip(offsets[1:][long_enough] - window + 1 - begin, 0, count), -1)
        inside = np.cumsum(inside[:-1]) > 0
        same = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
        new, last = inside.copy(), inside.copy()
        new[1:] &= ~same
        last[:-1] &= ~same
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        if len(a):
            text = np.searchsorted(offsets, a + begin, "right") - 1
            contents = Spans(piece).hashes(a, b + window)
            yield text, a + begin, b - a, grams[anchor[a]], contents


def _resolved(block: int):
    """From spans sorted by anchor hash and content: repeats (kind 1), and the first spans of
    contents that share an anchor hash (kind 2). Of what is open, one span is kept in memory."""

    def run(batches):
        held, number, given = None, 0, False  # the open content's first span, its number at the hash
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("kind", "hash", "ctx", "id", "part", "place")]
            done = cols[0] == 1
            out = [(np.ones(int(done.sum()), np.int32), *(cols[i][done] for i in (1, 3, 4, 5)))]
            blocks_out = [np.zeros(int(done.sum()), np.int32)]
            hashes, ctx, id_, part, place = (c[~done] for c in cols[1:])
            if len(hashes):
                kept = held is not None
                if kept:
                    hashes, ctx, id_, part, place = (
                        np.concatenate([[h], x])
                        for h, x in zip(held, (hashes, ctx, id_, part, place))
                    )
                here = np.arange(len(hashes))
                new_hash, new_ctx = np.ones(len(hashes), bool), np.ones(len(hashes), bool)
                new_hash[1:] = hashes[1:] != hashes[:-1]
                new_ctx[1:] = new_hash[1:] | (ctx[1:] != ctx[:-1])
                first = np.maximum.accumulate(np.where(new_ctx, here, 0))
                again = ~new_ctx & (
                    (id_ != id_[first]) | (part != part[first]) | (place != place[first])
                )
                ones = np.ones(int(again.sum()), np.int32)
                out.append((ones, hashes[again], id_[again], part[again], place[again]))
                blocks_out.append(np.zeros(int(again.sum()), np.int32))
                # The contents of each hash, counted on from what earlier batches held of it.
                heads = np.flatnonzero(new_ctx)
                group = np.cumsum(new_hash)[heads] - 1
                start = np.flatnonzero(new_hash[heads])
                earlier = np.zeros(len(start), np.int64)
                earlier[0] = number if kept else 0
                order = np.arange(len(heads)) - start[group] + earlier[group]
                total = np.bincount(group) + earlier
                open_ = total[group] > 1
                if kept and given:
                    open_[0] = False
                rows = heads[open_]
                twos = np.full(len(rows), 2, np.int32)
                out.append((twos, hashes[rows], id_[rows], part[rows], place[rows]))
                blocks_out.append((order[open_] // block).astype(np.int32))
                held = tuple(x[heads[-1]] for x in (hashes, ctx, id_, part, place))
                number, given = int(order[-1]), bool(total[-1] > 1)
            kind, hashes, id_, part, place = (np.concatenate(x) for x in zip(*out))
            columns = [kind, hashes, np.concatenate(blocks_out), id_, part, place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns],
                names=["kind", "hash", "block", "id", "part", "place"],
            )

    return run


def _contents(units: Units, kind: str):
    def run(batches):
        for batch in batches:
            ids, parts = batch.column("id").to_pylist(), batch.column("part").to_pylist()
            lists = batch.column("spans")
            bounds = lists.offsets.to_numpy()
            fields = {
                name: column.to_numpy(zero_copy_only=False)
                for name, column in zip(("hash", "block", "begin", "end"), lists.values.flatten())
            }
            for row, data, offsets in blocks(batch.column("text")):
                if kind == "binary":
                    values, first = data, offsets
                else:
                    values, first = units(data, offsets)
                    values = values.view(np.int64)
                texts = np.arange(len(offsets) - 1)
                many = bounds[row + texts + 1] - bounds[row + texts]
                owner = np.repeat(texts, many)
                span = slice(bounds[row], bounds[row + len(texts)])
                begin, end = fields["begin"][span], fields["end"][span]
                cut = [values[a:b] for a, b in zip(begin + first[owner], end + first[owner])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fields["hash"][span]),
                        pa.array(fields["block"][span]),
                        pa.array(np.array(ids, np.int64)[owner + row]),
                        pa.array(np.array(parts, np.int64)[owner + row]),
                        pa.array(begin),
                        pa.array([x.tobytes() for x in cut], pa.binary())
                        if kind == "binary"
                        else pa.array(cut, pa.list_(pa.int64())),
                    ],
                    names=["hash", "block", "id", "part", "begin", "units"],
                )

    return run
