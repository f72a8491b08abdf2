"""Removing repeated byte strings with suffix arrays per shard.

Every place at which a string of ``length`` bytes starts is judged: the string goes if it also
starts earlier. Spans that hold the few strings which need comparing come from ``winnow``; shards
of them get a suffix array each, whose common prefixes group equal strings. Strings of an anchor
whose spans fill several shards are merged across these by binary search.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsframe.llm import winnow
from opsframe.llm.suffixes import common_prefixes, suffix_array
from opsframe.llm.units import Spans, blocks
from opsframe.session import staged

#: Bytes of a shard, and length of the anchors.
SHARD = 1 << 19
GRAM = 24

_OUT = (
    "kind int, hash long, block int, id long, part long, begin long, end long,"
    " ids array<long>, parts array<long>, begins array<long>, strings binary"
)


def remove_repeated_bytes(
    docs: DataFrame,
    length: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = winnow.BLOCK,
) -> DataFrame:
    """(id, text, kept, spans) per row: the UTF-8 bytes, those that stay, and what goes.

    A byte goes if a string of ``length`` bytes over it also starts earlier: at a smaller id (a
    null one comes first), in a text with the same id and a smaller hash, or before it in the same
    text. All strings are judged on the input. ``spans`` are the maximal runs removed (begin, end
    exclusive). Rows that repeat id and text give equal results. Texts shorter than ``length``
    bytes, empty and null ones stay as they are; null counts as empty. Other columns are ignored.
    Anchors and spans are told apart by 64-bit hashes.
    """
    texts = winnow.keyed(docs, id_col, text_col)
    found = winnow.spans(texts, winnow.byte_units, length, min(GRAM, length), block)
    open_spans = found.where("kind = 2")
    content = winnow.contents(texts, open_spans, winnow.byte_units, "binary")
    # Anchors with spans in several blocks: their strings are merged across shards.
    content = content.join(winnow.last_blocks(open_spans), "hash", "left").fillna(0, ["last"])
    solved = staged(winnow.sharded(content, _solve(length), _OUT, SHARD), "suffix-shards")
    merged = (
        solved.where("kind = 2")
        .select("hash", "block", "ids", "parts", "begins", "strings")
        .groupBy("hash", "block")
        .applyInArrow(_merge(length), "id long, part long, begin long, end long")
    )
    columns = ["id", "part", "begin", "end"]
    gone = (
        found.where("kind = 1")
        .select(*columns)
        .unionByName(solved.where("kind = 1").select(*columns))
        .unionByName(merged)
    )
    gone = winnow.per_text(gone, "begin", "end")
    joined = winnow.with_spans(texts, gone, "left").select("doc", "text", "spans")
    return joined.mapInArrow(
        _removed,
        f"`{id_col}` long, text binary, kept binary, spans array<struct<begin long, end long>>",
    )


def _solve(length: int):
    """Of a shard: the strings that occur earlier in it (kind 1), and for anchors with several
    blocks the first of each string (kind 2)."""

    def solve(table: pa.Table):
        table = table.combine_chunks()
        sizes = np.array([len(x) for x in table.column("units").to_pylist()], np.int64)
        data = np.frombuffer(b"".join(table.column("units").to_pylist()), np.uint8)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(data)) - (ends - sizes)[row]
        room = sizes[row] - at
        order = suffix_array(data, length)
        order = order[room[order] >= length]
        shared = common_prefixes(data, order, room)
        col = {c: table.column(c).to_numpy() for c in ("hash", "id", "part", "begin", "last")}
        row, place = row[order], col["begin"][row[order]] + at[order]
        # Equal strings are neighbours; the first by id, part and place stays.
        group = np.cumsum(shared < length)
        ranked = np.lexsort((place, col["part"][row], col["id"][row], group))
        row, place, group, start = row[ranked], place[ranked], group[ranked], order[ranked]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        gone = ~first & ~(
            (col["id"][row] == col["id"][row[head]])
            & (col["part"][row] == col["part"][row[head]])
            & (place == place[head])
        )
        yield _repeats(col, row[gone], place[gone], length)
        kept = np.flatnonzero(first & (col["last"][row] > 0))
        if len(kept):
            yield _pieces(col, data, row[kept], place[kept], start[kept], group[kept], length)

    return solve


def _repeats(col, row, place, length) -> pa.RecordBatch:
    """Rows of kind 1: successive strings of one span make one row."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    breaks = np.ones(len(row), bool)
    breaks[1:] = row[1:] != row[:-1]
    heads, begin, end = winnow.joined_windows(place, breaks, length)
    row = row[heads]
    longs = pa.nulls(len(row), pa.list_(pa.int64()))
    return _batch(1, [col["hash"][row], np.zeros(len(row), np.int32)], [
        col["id"][row], col["part"][row], begin, end,
    ], [longs, longs, longs, pa.nulls(len(row), pa.binary())])


def _pieces(col, data, row, place, start, group, length) -> pa.RecordBatch:
    """Rows of kind 2: the shard's distinct strings of an anchor, sorted, a row for each range."""
    contents = Spans(data).hashes(start, start + length)
    rows, heads, ranges = winnow.pieces(col["hash"][row], contents, col["last"][row], group)
    row, place, start = row[rows], place[rows], start[rows]
    ends = np.append(heads, len(rows)).astype(np.int32)
    strings = data[start[:, None] + np.arange(length)].tobytes()
    strings = [strings[a * length : b * length] for a, b in zip(ends[:-1], ends[1:])]
    listed = [
        pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
        for x in (col["id"][row], col["part"][row], place)
    ]
    none = pa.nulls(len(heads), pa.int64())
    return _batch(2, [col["hash"][row[heads]], ranges], [none] * 4, [*listed, pa.array(strings, pa.binary())])


def _batch(kind: int, keys: list, plain: list, lists: list) -> pa.RecordBatch:
    columns = [np.full(len(keys[0]), kind, np.int32), *keys, *plain]
    return pa.RecordBatch.from_arrays(
        [*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), *lists],
        names=["kind", "hash", "block", "id", "part", "begin", "end", "ids", "parts", "begins", "strings"],
    )


def _merge(length: int):
    """Strings of one range from several shards: each is looked up by binary search among the
    sorted distinct ones, and all but the first of them go."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        strings = np.frombuffer(b"".join(table.column("strings").to_pylist()), f"S{length}")
        id_, part, begin = (
            table.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "parts", "begins")
        )
        group = np.searchsorted(np.unique(strings), strings)
        ranked = np.lexsort((begin, part, id_, group))
        id_, part, begin, group = id_[ranked], part[ranked], begin[ranked], group[ranked]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        gone = ~((id_ == id_[head]) & (part == part[head]) & (begin == begin[head]))
        return pa.table(
            {"id": id_[gone], "part": part[gone], "begin": begin[gone], "end": begin[gone] + length}
        )

    return run


def _removed(batches):
    for batch in batches:
        lists = batch.column("spans").fill_null([])
        bounds = lists.offsets.to_numpy()
        begin, end = (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten())
        for row, data, offsets in blocks(batch.column("text")):
            texts, kept, spans = [], [], []
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]]
                own = slice(bounds[row + i], bounds[row + i + 1])
                texts.append(text.tobytes())
                if own.start == own.stop:
                    kept.append(texts[-1])
                    spans.append([])
                    continue
                gone = winnow.mask(len(text), begin[own], end[own])
                kept.append(text[~gone].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"begin": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(row, len(texts)),
                    pa.array(texts, pa.binary()),
                    pa.array(kept, pa.binary()),
                    pa.array(
                        spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                    ),
                ],
                names=["doc", "text", "kept", "spans"],
            )
