"""Exact top-k by inner product: a Voronoi join of queries and data.

With one more coordinate, sqrt(M - |x|^2) for data (M the largest squared length) and 0 for
queries, the largest inner products are the smallest distances. Both sides are grouped by their
nearest pivot. From each cell's radius and its few smallest distances follows, for every cell of
queries, a distance within which all answers lie; a data row is sent only where that reaches.
Equal vectors count once, with the few smallest ids that any answer can hold.

A query's own id is dropped only after rows were cut, as queries with equal vectors share their
answers. So every cut leaves ``k`` rows besides those of any one id, however many it has; an id
needs no more than ``k`` rows itself.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsframe.session import staged

#: Pivots, taken from the data by a hash; queries and data rows that are solved together.
PIVOTS = 64
QUERIES = 512
ROWS = 8192


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null where a component is null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(
        numbers,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.when(fine, F.transform(numbers, lambda x: F.floor(x * scale).cast("long")))


def top_k(
    queries: DataFrame,
    data: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "vector",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, id, score): for each query the ``k`` rows of ``data`` with the largest
    inner products, without rows of the query's own id; ties go to the smaller id.

    Both tables have an id and an array<long>. Rows with a null id or vector take no part; empty
    vectors score 0 with all. Vectors of different lengths score as if the shorter one went on in
    zeros. Fewer than ``k`` rows are all returned, no data or no queries give no rows. Rows that
    repeat an id count each; a query id that occurs with several vectors gets answers for each.
    Sums that leave the range of a long are cut to it. Other columns are ignored.
    """
    spark = data.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
        return df.where(F.col("id").isNotNull() & F.col("vec").isNotNull())

    # k + 1 different ids, as one may be the query's; the limit is kept before the shuffle.
    nearest_ids = Window.partitionBy("vec").orderBy("id")
    groups = staged(
        clean(data)
        .groupBy("vec", "id")
        .agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
        .withColumn("place", F.row_number().over(nearest_ids))
        .where(F.col("place") <= k + 1)
        .groupBy("vec")
        .agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("id", F.col("copies"))))).alias("ids")),
        "knn-data",
    )
    asked = staged(clean(queries), "knn-queries")
    # A number for each vector asked for, as an id may ask for several.
    sought = asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id())
    sought = staged(sought, "knn-sought")
    length = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    shape = groups.agg(F.max(length).alias("top"), F.max(F.size("vec")).alias("width"), F.count("*").alias("n")).first()
    wide = sought.agg(F.max(F.size("vec")).alias("width"), F.count("*").alias("n")).first()
    empty = f"query_id long, rank int, `{id_col}` long, score long"
    if not shape["n"] or not wide["n"]:
        return spark.createDataFrame([], empty)
    width, top = max(shape["width"], wide["width"], 1), float(shape["top"])
    chosen = groups.orderBy(F.xxhash64("vec"), "vec").limit(pivots).select("vec").collect()
    centres = _lifted([row["vec"] for row in chosen], width, top)
    shared = spark.sparkContext.broadcast((centres, width, top))

    placed = staged(
        groups.mapInArrow(
            _placed(shared, True, "ids"), "ids array<long>, vec array<long>, cell int, away double, far array<double>"
        ),
        "knn-cells",
    )
    cells = staged(
        sought.mapInArrow(
            _placed(shared, False, "query"), "query long, vec array<long>, cell int, away double, far array<double>"
        ).drop("far"),
        "knn-query-cells",
    )
    # Summaries: a row per cell, and the smallest distances in each cell of data.
    near = Window.partitionBy("cell").orderBy("away")
    near_of_id = Window.partitionBy("cell", "id").orderBy("away")
    least = (
        placed.select("cell", "away", F.explode("ids").alias("id"))
        .withColumn("place", F.row_number().over(near_of_id))
        .where(F.col("place") <= k)
        .withColumn("place", F.row_number().over(near))
        .where(F.col("place") <= 2 * k)
        .select("cell", "away", "id")
        .collect()
    )
    radii = cells.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
    reach = _reach(centres, least, radii, k)
    # Cells go into groups of about QUERIES; a larger cell is dealt over several groups.
    group_of = _grouped(radii)
    table = spark.createDataFrame(
        [(c, g, p, n) for c, (n, parts) in group_of.items() for p, g in enumerate(parts)],
        "cell int, grp int, part int, parts int",
    )
    cells = cells.join(F.broadcast(table), "cell").where(
        F.col("part") == F.pmod(F.xxhash64("query"), F.col("parts"))
    )
    slices = max(1, -(-shape["n"] // ROWS))
    wanted: dict[int, list] = {}
    for c, (_, parts) in group_of.items():
        for g in parts:
            wanted.setdefault(g, []).append((c, reach[c]))
    wanted = spark.sparkContext.broadcast(
        [(g, np.array([c for c, _ in x]), np.array([r for _, r in x])) for g, x in sorted(wanted.items())]
    )
    sent = placed.select(
        "ids", "vec", "far", F.pmod(F.xxhash64("vec"), F.lit(slices)).cast("int").alias("slice")
    ).mapInArrow(_sent(wanted), "grp int, slice int, ids array<long>, vec array<long>")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    right = sent.groupBy("grp", "slice")
    left = cells.select("grp", every.alias("slice"), "query", "vec").groupBy("grp", "slice")
    answers = left.cogroup(right).applyInArrow(
        _solve(k, width), "query long, id long, score long"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best_of_id = Window.partitionBy("query", "id").orderBy(F.desc("score"))
    answers = (
        answers.repartition("query")
        .withColumn("place", F.row_number().over(best_of_id))
        .where(F.col("place") <= k)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= 2 * k)
        .drop("place")
    )
    # Answers of a vector are those of every query that has it, without its own id.
    names = asked.join(sought, "vec").select(F.col("id").alias("query_id"), "query").distinct()
    own = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return (
        names.join(answers, "query")
        .where(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, vector in enumerate(vectors):
        out[i, : len(vector)] = vector
    return out


def _column(column, width: int) -> np.ndarray:
    """An Arrow column of lists as a matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return column.flatten().to_numpy().reshape(-1, width)
    return _matrix(column.to_pylist(), width)


def _lifted(vectors, width: int, top: float | None) -> np.ndarray:
    x = _matrix(vectors, width) if isinstance(vectors, list) else vectors
    x = x.astype(np.float64)
    more = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
    return np.column_stack([x, more])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _placed(shared, is_data: bool, name: str):
    def run(batches):
        centres, width, top = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _lifted(_column(batch.column("vec"), width), width, top if is_data else None)
            far = _distances(x, centres)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(name),
                    batch.column("vec"),
                    pa.array(cell.astype(np.int32)),
                    pa.array(far[np.arange(len(far)), cell]),
                    pa.array(list(far), pa.list_(pa.float64())),
                ],
                names=[name, "vec", "cell", "away", "far"],
            )

    return run


def _reach(centres: np.ndarray, least: list, radii: list, k: int) -> dict[int, float]:
    """For each cell of queries: how far from its pivot an answer may lie. The least radius +
    pivot distance + distance to the own pivot that ``k`` rows besides those of any one id have
    bounds every query's k-th distance."""
    between = _distances(centres, centres)
    reach = {}
    for row in radii:
        bounds = [row["radius"] + between[row["cell"], x["cell"]] + x["away"] for x in least]
        bound, held = float("inf"), Counter()
        for n, i in enumerate(np.argsort(bounds), 1):
            held[least[i]["id"]] += 1
            if n - max(held.values()) >= k:
                bound = bounds[i]
                break
        # Rounding of distances must not lose a row.
        scale = float(np.abs(centres).max()) * centres.shape[1]
        reach[row["cell"]] = (row["radius"] + bound) * (1 + 1e-6) + 1e-3 * (1 + scale * 1e-3)
    return reach


def _grouped(radii: list) -> dict[int, tuple[int, list[int]]]:
    """Per cell the number of its parts and the group of each."""
    result, group, room = {}, 0, QUERIES
    for row in sorted(radii, key=lambda r: r["cell"]):
        parts = max(1, -(-row["n"] // QUERIES))
        places = []
        for _ in range(parts):
            size = -(-row["n"] // parts)
            if size > room:
                group, room = group + 1, QUERIES
            room -= size
            places.append(group)
        result[row["cell"]] = (parts, places)
    return result


def _sent(wanted):
    """Each data row once for every group that has a cell it may answer."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = np.array(batch.column("far").to_pylist())
            for group, cells, reach in wanted.value:
                keep = (far[:, cells] <= reach).any(axis=1)
                if keep.any():
                    rows = batch.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(rows.num_rows, group, np.int32)),
                            *(rows.column(c) for c in ("slice", "ids", "vec")),
                        ],
                        names=["grp", "slice", "ids", "vec"],
                    )

    return run


def _solve(k: int, width: int):
    shape = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        ids = right.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        order = np.argsort(first, kind="stable")  # so that the first of ties has the least id
        ids, first = ids.take(pa.array(order)), first[order]
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        flat = ids.flatten().to_numpy()
        x = _column(right.column("vec").combine_chunks(), width)[order]
        names = left.column("query").to_numpy()
        q = _column(left.column("vec").combine_chunks(), width)
        out = [[], [], []]
        for begin in range(0, len(q), 128):
            scores = _products(q[begin : begin + 128], x)
            for name, row in zip(names[begin : begin + 128], scores):
                take = k + 1
                while True:
                    best = _best(row, take)
                    many = ends[best + 1] - ends[best]
                    at = np.repeat(ends[best + 1] - np.cumsum(many), many) + np.arange(many.sum())
                    held, score = flat[at], np.repeat(row[best], many)
                    if take >= len(row) or _suffices(row[best], first[best], held, score, k):
                        break
                    take *= 2
                if take > k + 1:
                    held, score = _first_of_each(held, score, k)
                out[0].append(np.full(len(held), name))
                out[1].append(held)
                out[2].append(score)
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in out], schema=shape)

    return run


def _suffices(best, first, held, score, k: int) -> bool:
    """Whether ``k`` rows besides those of any one id come before all vectors left out. Those have
    lower scores than ``best``, or the least of these and no smaller id than the ties among it."""
    edge = best.min()
    sure = held[(score > edge) | (held <= first[best == edge].max())]
    return len(sure) - np.unique(sure, return_counts=True)[1].max(initial=0) >= k


def _first_of_each(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` rows of each id."""
    order = np.lexsort((-scores, ids))
    ids, scores = ids[order], scores[order]
    place = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return ids[place < k], scores[place < k]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: as floats where no sum can leave their whole numbers."""
    a, b = q.astype(np.float64), x.astype(np.float64)
    most = np.sqrt((a * a).sum(axis=1).max() * (b * b).sum(axis=1).max())
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest scores; of equal ones the first."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])
