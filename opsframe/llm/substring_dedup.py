"""Removing repeated word sequences with a compressed index per shard.

Spans that hold the few windows which need comparing come from ``winnow``. A shard of them gets an
FM-index; its texts are streamed through backward search, which gives for every place the interval
of rows that share a whole window with it, and so the first place it occurs at. Windows of an
anchor whose spans fill several shards are brought together once more by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsframe.llm import winnow
from opsframe.llm.fm_index import FmIndex
from opsframe.llm.units import Spans, blocks
from opsframe.session import staged

#: Bytes of a shard's words (8 for each), and words of an anchor.
SHARD = 1 << 21
GRAM = 8

_OUT = (
    "kind int, hash long, block int, id long, part long, begin long, end long,"
    " ids array<long>, parts array<long>, begins array<long>, units array<long>"
)


def remove_repeated_passages(
    docs: DataFrame,
    window: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = winnow.BLOCK,
) -> DataFrame:
    """(id, n_words, kept, spans) per row: the words that stay, joined by one space, and what goes.

    A word goes if a window of ``window`` words over it also starts earlier: at a smaller id (a
    null one comes first), in a text with the same id and a smaller hash, or before it in the same
    text. Windows are judged on the input. ``spans`` are the maximal runs of words removed (begin,
    end exclusive). Words are what ASCII white space separates. Rows that repeat id and text give
    equal results; texts of fewer words, empty and null ones lose nothing. Other columns are
    ignored. Words, anchors and spans are told apart by 64-bit hashes.
    """
    texts = winnow.keyed(docs, id_col, text_col)
    found = winnow.spans(texts, winnow.word_units, window, min(GRAM, window), block)
    open_spans = found.where("kind = 2")
    content = winnow.contents(texts, open_spans, winnow.word_units, "array<long>")
    content = content.join(winnow.last_blocks(open_spans), "hash", "left").fillna(0, ["last"])
    solved = staged(winnow.sharded(content, _solve(window), _OUT, SHARD), "index-shards")
    # Across shards: the first of each window, brought together by the window's own hash.
    again = solved.where("kind = 2").select("hash", "block", "ids", "parts", "begins", "units")
    merged = winnow.sharded(again, _solve_pieces(window), _OUT, SHARD)
    columns = ["id", "part", "begin", "end"]
    gone = (
        found.where("kind = 1")
        .select(*columns)
        .unionByName(solved.where("kind = 1").select(*columns))
        .unionByName(merged.where("kind = 1").select(*columns))
    )
    gone = winnow.per_text(gone, "begin", "end")
    joined = winnow.with_spans(texts, gone, "left").select("doc", "text", "spans")
    return joined.mapInArrow(
        _removed,
        f"`{id_col}` long, n_words long, kept binary, spans array<struct<begin long, end long>>",
    )


def _solve(window: int):
    """Of a shard: the windows that occur earlier in it (kind 1), and for anchors with several
    blocks the first of each window (kind 2)."""

    def solve(table: pa.Table):
        table = table.combine_chunks()
        units = table.column("units").combine_chunks()
        sizes = units.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = units.flatten().to_numpy()
        col = {c: table.column(c).to_numpy() for c in ("hash", "id", "part", "begin", "last")}
        begins = np.cumsum(sizes) - sizes
        symbols = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1
        index = FmIndex(symbols, begins, window)
        place, group = index.matches(symbols, begins)
        row = np.searchsorted(begins, place, "right") - 1
        start = col["begin"][row] + place - begins[row]
        # The first place of each class of rows, by id, part and place; the others go.
        ranked = np.lexsort((start, col["part"][row], col["id"][row], group))
        row, place, group, start = (x[ranked] for x in (row, place, group, start))
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        gone = ~first & ~(
            (col["id"][row] == col["id"][row[head]])
            & (col["part"][row] == col["part"][row[head]])
            & (start == start[head])
        )
        order = np.lexsort((start[gone], row[gone]))
        gone_row, gone_start = row[gone][order], start[gone][order]
        breaks = np.ones(len(gone_row), bool)
        breaks[1:] = gone_row[1:] != gone_row[:-1]
        heads, begin, end = winnow.joined_windows(gone_start, breaks, window)
        rows = gone_row[heads]
        longs = pa.nulls(len(rows), pa.list_(pa.int64()))
        plain = [col["id"][rows], col["part"][rows], begin, end]
        yield _batch(1, [col["hash"][rows], np.zeros(len(rows), np.int32)], plain, [longs] * 4)
        kept = np.flatnonzero(first & (col["last"][row] > 0))
        if len(kept):
            yield _pieces(col, flat, row[kept], start[kept], place[kept], window)

    return solve


def _pieces(col, flat, row, start, place, window) -> pa.RecordBatch:
    """Rows of kind 2: the shard's distinct windows of an anchor, a row for each range."""
    contents = Spans(flat.view(np.uint64)).hashes(place, place + window)
    rows, heads, ranges = winnow.pieces(
        col["hash"][row], contents, col["last"][row], contents
    )
    row, start, place = row[rows], start[rows], place[rows]
    ends = np.append(heads, len(rows)).astype(np.int32)
    listed = [
        pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
        for x in (col["id"][row], col["part"][row], start)
    ]
    units = flat[place[:, None] + np.arange(window)].ravel()
    listed.append(pa.ListArray.from_arrays(pa.array(ends * window), pa.array(units)))
    none = pa.nulls(len(heads), pa.int64())
    return _batch(2, [col["hash"][row[heads]], ranges], [none] * 4, listed)


def _batch(kind: int, keys: list, plain: list, lists: list) -> pa.RecordBatch:
    columns = [np.full(len(keys[0]), kind, np.int32), *keys, *plain]
    return pa.RecordBatch.from_arrays(
        [*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), *lists],
        names=["kind", "hash", "block", "id", "part", "begin", "end", "ids", "parts", "begins", "units"],
    )


def _solve_pieces(window: int):
    """``_solve`` on the windows of pieces, each a text of its own."""
    solve = _solve(window)

    def run(table: pa.Table):
        table = table.combine_chunks()
        flat = {c: table.column(c).combine_chunks().flatten() for c in ("ids", "parts", "begins", "units")}
        many = table.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(table.num_rows), many)
        ends = np.arange(len(owner) + 1, dtype=np.int32) * window
        yield from solve(
            pa.table(
                {
                    "hash": table.column("hash").to_numpy()[owner],
                    "id": flat["ids"],
                    "part": flat["parts"],
                    "begin": flat["begins"],
                    "last": np.zeros(len(owner), np.int32),
                    "units": pa.ListArray.from_arrays(pa.array(ends), flat["units"]),
                }
            )
        )

    return run


def _removed(batches):
    for batch in batches:
        lists = batch.column("spans").fill_null([])
        bounds = lists.offsets.to_numpy()
        begin, end = (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten())
        for row, data, offsets in blocks(batch.column("text")):
            number, kept, spans = [], [], []
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]]
                held = text.tobytes().split()
                own = slice(bounds[row + i], bounds[row + i + 1])
                number.append(len(held))
                if own.start == own.stop:
                    kept.append(b" ".join(held))
                    spans.append([])
                    continue
                gone = winnow.mask(len(held), begin[own], end[own])
                kept.append(b" ".join([held[j] for j in np.flatnonzero(~gone)]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"begin": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(row, len(number)),
                    pa.array(number, pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array(
                        spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                    ),
                ],
                names=["doc", "n_words", "kept", "spans"],
            )
