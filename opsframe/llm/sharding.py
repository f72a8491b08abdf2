"""Shards of near-equal size by best-fit decreasing; rows with equal texts stay together.

Packing goes in two levels, so that neither a task nor the driver ever holds all groups. Groups of
equal texts are dealt into a fixed number of buckets by a hash; each bucket streams its groups,
largest first, into parcels of a small fixed capacity. The parcels, whose number is bounded
whatever the input, are packed into the shards on the driver: those above the mean get a shard
each, the others go by best fit with the least capacity that needs no more shards than are left.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opsframe.session import staged

#: Parcels have this part of all bytes as capacity, and groups are dealt into so many buckets.
PARCELS = 4096
BUCKETS = 256
#: No piece that is numbered in one task has more than about this part of all rows.
PIECES = 1024


class Bins:
    """Open bins by remaining capacity in a treap: a search tree that random priorities balance."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = 0
        self._root: list | None = None  # [key, priority, left, right], key = (remaining, bin)
        self._seed = 1

    def put(self, size: int) -> int:
        """The bin that the item goes to: the fullest one with room, or else a new one."""
        node, best = self._root, None
        while node:
            if node[0][0] >= size:
                node, best = node[2], node[0]
            else:
                node = node[3]
        if best is None:
            best = (max(self.capacity, size), self.count)
            self.count += 1
        else:
            self._root = self._removed(self._root, best)
        if best[0] > size:
            self._seed = (self._seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            self._insert((best[0] - size, best[1]), self._seed >> 16)
        return best[1]

    def _insert(self, key: tuple, priority: int) -> None:
        less, more = self._split(self._root, key)
        self._root = self._merged(self._merged(less, [key, priority, None, None]), more)

    def _split(self, node, key):
        if not node:
            return None, None
        if node[0] < key:
            node[3], more = self._split(node[3], key)
            return node, more
        less, node[2] = self._split(node[2], key)
        return less, node

    def _merged(self, left, right):
        if not left or not right:
            return left or right
        if left[1] > right[1]:
            left[3] = self._merged(left[3], right)
            return left
        right[2] = self._merged(left, right[2])
        return right

    def _removed(self, node, key):
        if node[0] == key:
            return self._merged(node[2], node[3])
        side = 2 if key < node[0] else 3
        node[side] = self._removed(node[side], key)
        return node


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin of each item; an item above the capacity gets a bin of its own."""
    sizes = list(sizes)
    bins, placed = Bins(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        placed[i] = bins.put(sizes[i])
    return placed


def fewest_bytes(sizes: list[int], shards: int) -> list[int]:
    """A bin below ``shards`` for each item.

    An item above the mean of what is left gets a bin of its own; the others go by best fit into
    the bins left, with the least capacity that suffices. Bins that best fit left empty then take
    over a part of the fullest one that can be split.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, alone = sum(sizes), 0
    while alone < len(order) and sizes[order[alone]] * (shards - alone) > left:
        left -= sizes[order[alone]]
        alone += 1
    bins = [[i] for i in order[:alone]]
    if alone < len(order):
        bins += _least_capacity(order[alone:], sizes, shards - alone)
    while len(bins) < min(shards, len(sizes)):
        fullest = max((b for b in bins if len(b) > 1), key=lambda b: sum(sizes[i] for i in b))
        bins.remove(fullest)
        bins += _least_capacity(fullest, sizes, 2)
    placed = [0] * len(sizes)
    for number, items in enumerate(bins):
        for i in items:
            placed[i] = number
    return placed


def _least_capacity(items: list[int], sizes: list[int], shards: int) -> list[list[int]]:
    """The items of each bin, by best fit with the least capacity that needs at most ``shards``."""
    held = [sizes[i] for i in items]
    low = max(-(-sum(held) // shards), *held)
    high = max(2 * low, 1)
    placed = best_fit_decreasing(held, high)
    while low < high:
        middle = (low + high) // 2
        trial = best_fit_decreasing(held, middle)
        if max(trial) < shards:
            high, placed = middle, trial
        else:
            low = middle + 1
    bins: list[list[int]] = [[] for _ in range(max(placed) + 1)]
    for i, number in zip(items, placed):
        bins[number].append(i)
    return bins


def assign_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The columns of ``docs`` with size, text_crc32, shard and slot.

    ``size`` is the text's UTF-8 bytes plus one, ``slot`` counts a shard's rows from 0 without a
    gap. Shards differ in bytes as little as best fit on parcels of a 4096th allows; a group of
    equal texts (null and empty count as equal) that is larger than a shard's part has a shard to
    itself, and the others share what is left as evenly. No shard is empty if there are as many
    parcels. Equal rows take any of their slots. No rows give no rows. Columns of ``docs`` with the
    names of the four new ones are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    rows = docs.select(
        *rest,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),
    )
    keys = ["_group", "size", "text_crc32"]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("_bytes", F.col("_n") * F.col("size"))
    groups = staged(groups, "shard-groups")
    total = groups.agg(F.sum("_bytes").alias("b"), F.sum("_n").alias("n")).first()
    capacity, most = max(1, -(-(total["b"] or 0) // PARCELS)), (total["n"] or 0) // PIECES
    packed = (
        groups.withColumn("_bucket", F.pmod("_group", F.lit(BUCKETS)).cast("int"))
        .repartition("_bucket")
        .sortWithinPartitions("_bucket", F.desc("_bytes"), *keys)
        .mapInArrow(
            _parcels(capacity),
            "_group long, size long, text_crc32 long, _n long, _bytes long, _parcel long",
        )
    )
    packed = staged(packed, "shard-parcels")
    # At most 2 * PARCELS + BUCKETS rows: of a bucket's parcels all but one are half full.
    parcels = (
        packed.groupBy("_parcel")
        .agg(F.sum("_bytes").alias("b"), F.sum("_n").alias("n"))
        .orderBy("_parcel")
        .collect()
    )
    placed = fewest_bytes([p["b"] for p in parcels], shards)
    table = []
    for p, shard in zip(parcels, placed):
        table.append((p["_parcel"], shard, 1 + (p["n"] // (most + 1))))
    places = spark.createDataFrame(table, "_parcel long, shard int, _pieces long")
    packed = packed.join(F.broadcast(places), "_parcel").drop("_bytes")
    # Fewer than PIECES groups have more than a PIECES-th of all rows.
    hot, cold = packed.where(F.col("_n") > most), packed.where(F.col("_n") <= most)
    hot, cold = F.broadcast(hot.drop("_n")), cold.drop("_n")
    placed_rows = rows.join(hot, keys).unionByName(
        rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    )
    piece = F.pmod(F.xxhash64(id_col, F.lit(7)), F.col("_pieces")).cast("int")
    placed_rows = placed_rows.withColumn("_piece", piece)
    counts = placed_rows.groupBy("shard", "_parcel", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_parcel", "_piece")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_parcel", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_parcel", "_piece").orderBy(id_col, *keys)
    return (
        placed_rows.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(counts), ["_parcel", "_piece"])
        .select(
            *rest,
            "size",
            "text_crc32",
            "shard",
            (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"),
        )
    )


def _parcels(capacity: int):
    """From groups sorted by bucket and falling size: each group's parcel."""

    def run(batches):
        bins, current = None, None
        for batch in batches:
            parcels = np.empty(batch.num_rows, np.int64)
            buckets = batch.column("_bucket").to_pylist()
            for i, (bucket, size) in enumerate(zip(buckets, batch.column("_bytes").to_pylist())):
                if bucket != current:
                    bins, current = Bins(capacity), bucket
                parcels[i] = (bucket << 40) + bins.put(size)
            columns = ["_group", "size", "text_crc32", "_n", "_bytes"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(parcels)],
                names=[*columns, "_parcel"],
            )

    return run
