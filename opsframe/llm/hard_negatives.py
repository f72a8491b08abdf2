"""Hard negatives of anchors by inner product, found in an R-tree packed by sort-tile-recursion.

The tree has four levels. Spark packs the upper two: rows are cut into slabs by label and by the two
coordinates that vary most, and sorted by the next; a range partition of that order is a tile, and
neighbouring tiles are a branch. Inside a task numpy packs a tile's rows into leaves of one label,
and neighbouring leaves into nodes. Every node knows the least and largest value of each coordinate.
From these follows an interval for its rows' inner products with an anchor, exact for whole numbers.

An anchor is sent to the branches whose interval meets what it looks for; in each of their tiles a
queue takes the nodes in order of their upper bounds, until these fall below the k-th score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsframe.session import staged

#: Rows of a tile and of a leaf, leaves of an inner node, bytes of all branches' boxes, slabs of a
#: coordinate, and anchors that one task takes for one tile.
TILE_ROWS = 4096
LEAF_ROWS = 64
FANOUT = 8
BRANCH_BYTES = 1 << 23
MOST_SLABS = 64
TILE_ASKS = 1 << 15

_LONG = np.iinfo(np.int64)
_LEAF_DDL = (
    "tile int, place int, label long, ids array<long>, tags array<long>, "
    "vecs array<long>, floors array<long>"
)
_BOX_DDL = "branch int, least long, most long, lo array<long>, hi array<long>"
_ANSWER_DDL = "tag long, seek int, id long, score long"
_RESULT_DDL = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "vector",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score is its inner product with the anchor; higher scores come first, ties by smaller
    id. Positives of an anchor are its first rows of the same label. For each of them the first
    rows of other labels are returned whose score lies between ``low_percent`` and ``high_percent``
    of the positive's, both included; there are none if that score is negative. ``rank`` is from 1.

    Ids and labels are whole numbers, vectors arrays of longs. Rows with a null id, label or vector
    take no part. Rows of the anchor's own id are never its answers. Rows that repeat count each,
    as answers and as anchors. Empty vectors score 0; shorter vectors go on in zeros. Fewer answers
    than asked for are all returned, an empty table gives no rows. Scores beyond a long are cut to
    it. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    rows = staged(rows.withColumn("tag", F.monotonically_increasing_id()), "rtree-rows")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not shape["n"]:
        return spark.createDataFrame([], _RESULT_DDL)
    width = max(1, shape["width"])
    tree = _Tree(rows, shape["n"], width, positives, tile_rows)

    anchors = tree.anchors()
    asks = anchors.select(
        "tag", "id", "label", "vec",
        F.array(F.lit(_LONG.min)).alias("los"),
        F.array(F.lit(_LONG.max)).alias("his"),
        F.array("floor").alias("floors"),
    )
    near = staged(_ranked(tree.search(asks, True, positives), positives), "positives")

    score = F.col("score")
    asks = (
        near.groupBy("tag")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))
        .join(anchors, "tag")
        .select(
            "tag", "id", "label", "vec",
            F.transform("found", lambda f: _least(f["score"], low_percent)).alias("los"),
            F.transform("found", lambda f: _most(f["score"], high_percent)).alias("his"),
        )
        .where(F.exists(F.arrays_zip("los", "his"), lambda w: w["los"] <= w["his"]))
    )
    asks = staged(asks.withColumn("floors", F.col("los")), "windows")
    # The branch of the largest bound gives scores that prune the others.
    first = _ranked(tree.search(asks, False, negatives, branches=1), negatives)
    kth = first.where(F.col("rank") == negatives).select("tag", "seek", "score")
    kth = kth.groupBy("tag").agg(
        F.map_from_entries(F.collect_list(F.struct("seek", "score"))).alias("kth")
    )
    floor = F.transform("los", lambda lo, i: F.greatest(lo, F.try_element_at(F.col("kth"), i)))
    asks = staged(
        asks.drop("floors").join(kth, "tag", "left").withColumn("floors", floor).drop("kth"),
        "windows",
    )
    hard = _ranked(tree.search(asks, False, negatives), negatives)
    ours = near.select(
        "tag", (F.col("rank") - 1).alias("seek"), F.col("id").alias("positive_id"),
        score.alias("positive_score"),
    )
    names = anchors.select("tag", F.col("id").alias("anchor_id"))
    return (
        hard.join(ours, ["tag", "seek"])
        .join(names, "tag")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            score.alias("negative_score"),
        )
    )


def _least(score: Column, percent: int) -> Column:
    """The least whole number that is at least ``percent`` of the score."""
    return F.ceil(score.cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")


def _most(score: Column, percent: int) -> Column:
    return F.floor(score.cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    """The first ``k`` answers of each search, with their rank."""
    order = Window.partitionBy("tag", "seek").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Tree:
    """Rows packed into leaves, tiles and branches; the boxes of the branches are in memory."""

    def __init__(self, rows: DataFrame, n: int, width: int, k: int, tile_rows: int) -> None:
        self.spark, self.width = rows.sparkSession, width
        ordered = _tiled(rows, -(-n // tile_rows), width)
        self.leaves = staged(ordered.mapInArrow(_packed(width, k), _LEAF_DDL), "rtree-leaves")
        # As many as there came to be, whatever number was asked for.
        self.tiles = self.leaves.agg(F.max("tile")).first()[0] + 1
        self.branches = min(self.tiles, max(16, BRANCH_BYTES // (16 * width)))
        branch = F.expr(f"cast(cast(tile as bigint) * {self.branches} div {self.tiles} as int)")
        boxes = self.leaves.select(branch.alias("branch"), "label", "vecs")
        boxes = boxes.mapInArrow(_boxed(width), _BOX_DDL)
        merged = boxes.groupBy("branch").applyInArrow(_merged, _BOX_DDL).orderBy("branch").collect()
        self.boxes = self.spark.sparkContext.broadcast(
            (
                np.array([b["branch"] for b in merged]),
                np.array([[b["least"], b["most"]] for b in merged]),
                np.array([b["lo"] for b in merged], np.float64),
                np.array([b["hi"] for b in merged], np.float64),
            )
        )

    def anchors(self) -> DataFrame:
        """``tag, id, label, vec, floor``: the floor is the k-th score in the anchor's own tile."""
        at = F.posexplode(F.arrays_zip("ids", "tags", "floors")).alias("at", "row")
        vec = F.slice("vecs", F.col("at") * self.width + 1, self.width)
        return (
            self.leaves.select("label", "vecs", at)
            .where("row.floors IS NOT NULL")
            .select("row.tags", "row.ids", "label", vec.alias("vec"), "row.floors")
            .toDF("tag", "id", "label", "vec", "floor")
        )

    def sent(self, asks: DataFrame, same: bool, branches: int | None = None) -> DataFrame:
        """Asks with each tile that may answer them; of ``branches`` of them only, if given."""
        return asks.mapInArrow(
            _sent(self.boxes, self.tiles, self.branches, self.width, same, branches),
            "tile int, tag long, id long, label long, vec array<long>, los array<long>, "
            "his array<long>, floors array<long>",
        )

    def search(self, asks: DataFrame, same: bool, k: int, branches: int | None = None) -> DataFrame:
        """The first ``k`` answers in each tile to each window of each ask."""
        sent = staged(self.sent(asks, same, branches), "rtree-asks")
        slots = sent.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE_ASKS).cast("int").alias("slots"))
        none = F.array().cast("array<long>")
        leaves = self.leaves.join(slots, "tile").select(
            "tile", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"),
            F.lit(0).alias("kind"), F.col("place").cast("long").alias("place"), "label", "ids",
            "vecs", none.alias("los"), none.alias("his"), none.alias("floors"),
        )
        asked = sent.join(slots, "tile").select(
            "tile", F.pmod(F.xxhash64("tag"), F.col("slots")).cast("int").alias("slot"),
            F.lit(1).alias("kind"), F.col("tag").alias("place"), "label",
            F.array("id").alias("ids"), F.col("vec").alias("vecs"), "los", "his", "floors",
        )
        return (
            leaves.unionByName(asked)
            .repartition("tile", "slot")
            .sortWithinPartitions("tile", "slot", "kind", "place")
            .mapInArrow(_found(self.width, same, k), _ANSWER_DDL)
        )


def _tiled(rows: DataFrame, tiles: int, width: int) -> DataFrame:
    """Rows in tiles: slabs by label and by the two coordinates of the largest variance, sorted by
    the third. Copies of a vector are told apart by id and tag, so that many of them make many
    tiles."""
    spread = (
        rows.select(F.posexplode("vec").alias("place", "x"))
        .groupBy("place")
        .agg(F.var_pop("x").alias("spread"))
        .orderBy(F.desc("spread"), "place")
        .limit(3)
        .collect()
    )
    places = [r["place"] for r in spread]
    entry = [F.coalesce(F.get("vec", F.lit(p)), F.lit(0)) for p in places]
    entry += [F.lit(0).cast("long")] * (3 - len(entry))
    slabs = min(MOST_SLABS, round(tiles ** (1 / 3)) or 1)
    cut = rows.withColumns({f"_c{i}": c for i, c in enumerate(entry)})
    parts = F.array(*[F.lit(i / slabs) for i in range(1, slabs)]) if slabs > 1 else None
    for level in range(2):
        if parts is None:
            cut = cut.withColumn(f"_b{level}", F.lit(0))
            continue
        keys = [f"_b{i}" for i in range(level)]
        edges = cut.groupBy(*keys).agg(F.percentile_approx(f"_c{level}", parts).alias("edges"))
        slab = F.lit(0)
        for row in edges.collect():
            here = F.size(F.filter(F.array(*[F.lit(e) for e in row["edges"]]), lambda e: e <= F.col(f"_c{level}")))
            slab = here if not keys else F.when(F.col(keys[0]) == row[keys[0]], here).otherwise(slab)
        cut = cut.withColumn(f"_b{level}", slab)
    order = ["label", "_b0", "_b1", "_c2", "id", "tag"]
    return (
        cut.repartitionByRange(tiles, *order)
        .sortWithinPartitions(*order)
        .withColumn("tile", F.spark_partition_id())
        .select("tile", "id", "label", "vec", "anchor", "tag")
    )


def _matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as a matrix; shorter lists go on in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _str_leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of rows by leaf: sorted by a coordinate, cut into slabs, each slab sorted by the
    next one, and so on; coordinates in order of their variance."""
    dims = np.argsort(-x.var(axis=0), kind="stable")[:4]
    parts = [np.arange(len(x))]
    for level, dim in enumerate(dims):
        cut = []
        for part in parts:
            leaves = -(-len(part) // size)
            slabs = max(1, round(leaves ** (1 / (len(dims) - level))))
            if level == len(dims) - 1:
                slabs = leaves
            order = part[np.argsort(x[part, dim], kind="stable")]
            step = -(-len(part) // slabs) if slabs else 1
            # Slabs hold whole leaves, so that only the last one of all is smaller.
            step = -(-step // size) * size
            cut += [order[i : i + step] for i in range(0, len(order), step)]
        parts = cut
    return [p for p in parts if len(p)]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _packed(width: int, k: int):
    """A tile's rows as leaves of one label, one row each; anchors with the k-th score of their
    label in this tile, by which other tiles are pruned."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        tile = table.column("tile")[0].as_py()
        x = _matrix(table.column("vec"), width)
        ids, labels, tags = (table.column(c).to_numpy() for c in ("id", "label", "tag"))
        anchor = table.column("anchor").to_numpy(zero_copy_only=False)
        leaves = []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            # Rows come in order of the slabs; the leaves cut them further.
            own = own[np.argsort(ids[own], kind="stable")]
            leaves += [own[leaf] for leaf in _str_leaves(x[own], LEAF_ROWS)]
        held = _Tile([(labels[at[0]], ids[at], x[at]) for at in leaves])
        floors = np.full(len(x), _LONG.min)
        for at in np.flatnonzero(anchor):
            window = [(int(_LONG.min), int(_LONG.max), int(_LONG.min))]
            found = held.best(x[at], ids[at], labels[at], True, window, k)[0]
            if len(found) == k:
                floors[at] = found[-1][0]
        out = {name: [] for name in ("label", "ids", "tags", "vecs", "floors")}
        for at in leaves:
            out["label"].append(labels[at[0]])
            out["ids"].append(ids[at])
            out["tags"].append(tags[at])
            out["vecs"].append(x[at].ravel())
            out["floors"].append([int(floors[i]) if anchor[i] else None for i in at])
        n = len(leaves)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, tile, np.int32)),
                pa.array(np.arange(n, dtype=np.int32)),
                pa.array(out["label"], pa.int64()),
                *(_lists(out[c], pa.int64()) for c in ("ids", "tags", "vecs", "floors")),
            ],
            names=["tile", "place", "label", "ids", "tags", "vecs", "floors"],
        )

    return run


def _box_rows(boxes: dict) -> pa.RecordBatch:
    names = ["branch", "least", "most", "lo", "hi"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    rows = [(branch, *box) for branch, box in boxes.items()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names
    )


def _add_box(boxes: dict, branch: int, least: int, most: int, lo, hi) -> None:
    if branch in boxes:
        a, b, c, d = boxes[branch]
        least, most, lo, hi = min(a, least), max(b, most), np.minimum(c, lo), np.maximum(d, hi)
    boxes[branch] = (least, most, lo, hi)


def _boxed(width: int):
    """Each task's part of the branches' boxes."""

    def run(batches):
        boxes: dict = {}
        for batch in batches:
            for branch, label, flat in zip(
                batch.column("branch").to_pylist(), batch.column("label").to_pylist(), batch.column("vecs")
            ):
                x = flat.values.to_numpy().reshape(-1, width)
                _add_box(boxes, branch, label, label, x.min(axis=0), x.max(axis=0))
        if boxes:
            yield _box_rows(boxes)

    return run


def _merged(table: pa.Table) -> pa.Table:
    boxes: dict = {}
    for row in table.to_pylist():
        _add_box(boxes, row["branch"], row["least"], row["most"], np.array(row["lo"]), np.array(row["hi"]))
    return pa.Table.from_batches([_box_rows(boxes)])


def _intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with the points of each box; widened
    where floats can't hold all whole numbers that occur."""
    q = q.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most = up @ hi.T + down @ lo.T
    least = up @ lo.T + down @ hi.T
    reach = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(reach < 2.0**52, 0.0, reach * (q.shape[1] + 2) * 2.0**-52)
    return least - slack, most + slack


def _sent(shared, tiles: int, branches: int, width: int, same: bool, first: int | None):
    """Each ask once for every tile of the branches that may answer it; of the ``first`` branches
    with the largest bounds only, if given."""

    def run(batches):
        names, labels, lo, hi = shared.value
        ends = [-(-(b * tiles) // branches) for b in range(branches + 1)]
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                rows = batch.slice(begin, 1024)
                own = rows.column("label").to_numpy()[:, None]
                least, most = _intervals(_matrix(rows.column("vec"), width), lo, hi)
                if same:
                    may = (labels[:, 0] <= own) & (own <= labels[:, 1])
                else:
                    may = (labels[:, 0] != own) | (own != labels[:, 1])
                los, floors = (np.nextafter(_windows(rows.column(c)), -np.inf) for c in ("los", "floors"))
                his = np.nextafter(_windows(rows.column("his")), np.inf)
                meets = np.zeros_like(may)
                for w in range(los.shape[1]):
                    low = np.maximum(los[:, w], floors[:, w])[:, None]
                    high = his[:, w][:, None]
                    meets |= (low <= high) & (most >= low) & (least <= high)
                may &= meets
                if first is not None:
                    order = np.argsort(-np.where(may, most, -np.inf), axis=1, kind="stable")[:, :first]
                    chosen = np.zeros_like(may)
                    np.put_along_axis(chosen, order, True, axis=1)
                    may &= chosen
                at, column = np.nonzero(may)
                branch = names[column]
                count = np.array([ends[b + 1] - ends[b] for b in branch], np.int64)
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                tile = np.repeat([ends[b] for b in branch], count) + offset
                for part in range(0, len(tile), 4096):
                    taken = rows.take(pa.array(np.repeat(at, count)[part : part + 4096]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(tile[part : part + 4096].astype(np.int32)),
                            *(taken.column(c) for c in ("tag", "id", "label", "vec", "los", "his", "floors")),
                        ],
                        names=["tile", "tag", "id", "label", "vec", "los", "his", "floors"],
                    )

    return run


def _windows(column) -> np.ndarray:
    """Lists of window bounds as a matrix of floats; the bounds of windows that an ask lacks are
    NaN, which no bound meets."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class _Tile:
    """The leaves of a tile with the inner nodes above them."""

    def __init__(self, leaves: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.labels = np.array([label for label, _, _ in leaves])
        self.ids = [ids for _, ids, _ in leaves]
        self.whole = [x for _, _, x in leaves]
        self.points = [x.astype(np.float64) for x in self.whole]
        lo = np.array([x.min(axis=0) for x in self.points])
        hi = np.array([x.max(axis=0) for x in self.points])
        least_id = np.array([ids.min() for ids in self.ids])
        self.longest = max(float((x * x).sum(axis=1).max()) for x in self.points)
        # Level by level: boxes, smallest ids, labels; a node's children are FANOUT neighbours.
        self.levels = [(lo, hi, least_id, self.labels, self.labels)]
        while len(lo) > FANOUT:
            at = np.arange(0, len(lo), FANOUT)
            _, _, _, a, b = self.levels[-1]
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            least_id = np.minimum.reduceat(least_id, at)
            self.levels.append((lo, hi, least_id, np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)))

    def best(self, q, own_id, own_label, same: bool, windows: list, k: int) -> list[list]:
        """For each window (least, most, floor) the first ``k`` of its rows as (score, id)."""
        bounds = [_intervals(q[None, :], lo, hi) for lo, hi, *_ in self.levels]
        bounds = [(least[0], most[0]) for least, most in bounds]
        found: list[list] = [[] for _ in windows]
        floors = [max(lo, floor) for lo, _, floor in windows]
        alive = [w for w, (lo, hi, _) in enumerate(windows) if max(lo, floors[w]) <= hi]
        if not alive:
            return found
        exact = float((q.astype(np.float64) ** 2).sum()) * self.longest < 2.0**104

        def wanted(level: int, node: int) -> bool:
            _, _, least_id, a, b = self.levels[level]
            if same and not a[node] <= own_label <= b[node]:
                return False
            if not same and a[node] == b[node] == own_label:
                return False
            least, most = bounds[level][0][node], bounds[level][1][node]
            for w in alive:
                if most < floors[w] or least > windows[w][1]:
                    continue
                if len(found[w]) == k:
                    score, worst_id = found[w][-1]
                    if min(most, windows[w][1]) == score and least_id[node] > worst_id:
                        continue
                return True
            return False

        def entry(level: int, node: int) -> tuple:
            return (-bounds[level][1][node], self.levels[level][2][node], level, node)

        top = len(self.levels) - 1
        queue = [entry(top, n) for n in range(len(self.levels[top][0])) if wanted(top, n)]
        heapq.heapify(queue)
        while queue:
            bound, _, level, node = heapq.heappop(queue)
            # Strictly below every k-th score, as are all nodes left.
            if -bound < min(floors[w] for w in alive):
                break
            if not wanted(level, node):
                continue
            if level:
                end = min((node + 1) * FANOUT, len(self.levels[level - 1][0]))
                for child in range(node * FANOUT, end):
                    if wanted(level - 1, child):
                        heapq.heappush(queue, entry(level - 1, child))
                continue
            if (self.labels[node] == own_label) != same:
                continue
            scores = self._scores(node, q, exact)
            ids = self.ids[node]
            near = np.flatnonzero((scores >= min(floors[w] for w in alive)) & (ids != own_id))
            if not len(near):
                continue
            for w in alive:
                held = [
                    (int(scores[i]), int(ids[i]))
                    for i in near[np.lexsort((ids[near], -scores[near]))]
                    if floors[w] <= scores[i] <= windows[w][1]
                ][:k]
                if held:
                    found[w] = sorted(found[w] + held, key=lambda f: (-f[0], f[1]))[:k]
                    if len(found[w]) == k:
                        floors[w] = max(floors[w], found[w][-1][0])
        return found

    def _scores(self, node: int, q, exact: bool) -> np.ndarray:
        if exact:
            return (self.points[node] @ q.astype(np.float64)).astype(np.int64)
        scores = self.whole[node].astype(object) @ q.astype(object)
        return np.clip(scores, _LONG.min, _LONG.max).astype(np.int64)


def _found(width: int, same: bool, k: int):
    """Answers to the asks of each tile, whose leaves come before them."""

    def run(batches):
        at, leaves, tile = None, [], None
        for batch in batches:
            out = [[], [], [], []]
            x = batch.column("vecs")
            tiles, slots, kinds, labels, places = (
                batch.column(c).to_pylist() for c in ("tile", "slot", "kind", "label", "place")
            )
            for i in range(batch.num_rows):
                if at != (tiles[i], slots[i]):
                    at, leaves, tile = (tiles[i], slots[i]), [], None
                ids = batch.column("ids")[i].values.to_numpy()
                vecs = x[i].values.to_numpy()
                if not kinds[i]:
                    leaves.append((labels[i], ids, vecs.reshape(-1, width)))
                    continue
                if not leaves:  # A tile of a branch may have got no rows.
                    continue
                tile = tile or _Tile(leaves)
                windows = list(zip(*(batch.column(c)[i].as_py() for c in ("los", "his", "floors"))))
                for w, found in enumerate(tile.best(vecs, ids[0], labels[i], same, windows, k)):
                    for score, other in found:
                        for column, value in zip(out, (places[i], w, other, score)):
                            column.append(value)
            if out[0]:
                kinds_of = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(out, kinds_of)],
                    names=["tag", "seek", "id", "score"],
                )

    return run
