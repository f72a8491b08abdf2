"""Row positions, batches and first matches that no hot group can overload."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

# A join cuts hot keys into pieces of this part of the rows that a task gets on average.
PIECES_PER_TASK = 4

# Rows that a bucket of a sorted order holds on average, unless that makes more buckets than
# pieces; keys in the sketch of the order for each of its buckets.
BUCKET_ROWS = 1 << 20
_KEYS_PER_BUCKET = 32

# Keys that the sketch of frequent ones counts at once, for each piece, and the most it can count.
_COUNTED_PER_PIECE = 8
_MOST_COUNTED = 1_000_000


def _pieces(df: DataFrame) -> int:
    return PIECES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _holds(kind: DataType, wanted: tuple[type, ...]) -> bool:
    """Whether a type is, or has inside it, one of some kinds."""
    if isinstance(kind, StructType):
        return any(_holds(field.dataType, wanted) for field in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds(kind.elementType, wanted)
    return isinstance(kind, wanted)


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; what holds maps or variants is hashed as its JSON text."""
    parts = [
        F.to_json(F.struct(_name(f.name)))
        if _holds(f.dataType, (MapType, VariantType))
        else _name(f.name)
        for f in df.schema.fields
    ]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


class _Buckets:
    """Bounds that cut rows, sorted by group and order, into buckets of about equal size, and the
    number of rows of its first group that lie before each bucket.

    The bounds come from a uniform sample of the keys, of a bounded size; they and the numbers
    are constants of the plan that uses them.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str], rows: int) -> None:
        self.by, self.order, self.tie = by, order, row_hash(df)
        total = df.count()
        self.n = max(1, min(-(-total // rows), _pieces(df)))
        if self.n == 1:
            return
        # Ties in the order go by the hash of the row only where one key fills a bucket.
        for keys in ([*map(_name, by + order)], [*map(_name, by + order), self.tie]):
            self.key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
            picked = self._sketch(df, total)
            texts = [repr(row) for row in picked.to_pylist()]
            if len(texts) == len(set(texts)):
                break
        picked = picked.take(sorted({text: i for i, text in enumerate(texts)}.values()))
        self.n = picked.num_rows + 1
        found = df.sparkSession.createDataFrame(picked)
        self.bounds = found.agg(F.array_sort(F.collect_list("key")).alias("_bounds"))
        self.before = self._rows_before(df)

    def _sketch(self, df: DataFrame, total: int) -> pa.Table:
        """The keys at equal distances in the sorted sample."""
        wanted = self.n * _KEYS_PER_BUCKET
        sample = df.select(self.key.alias("key")).sample(min(1.0, wanted / total), seed=17)
        keys = sample.agg(F.array_sort(F.collect_list("key")).alias("keys"))
        cuts = F.explode(F.sequence(F.lit(1), F.lit(self.n - 1))).alias("cut")
        place = F.expr(f"cast(cut * size(keys) div {self.n} as int)")
        return keys.where("size(keys) > 0").select("keys", cuts).select(F.get("keys", place).alias("key")).toArrow()

    def _same_group(self, key: Column, other: Column) -> Column:
        """Whether two keys are of one group; all rows are, without groups."""
        same = F.lit(True)
        for i in range(len(self.by)):
            same = same & key[f"k{i}"].eqNullSafe(other[f"k{i}"])
        return same

    def _with(self, df: DataFrame, name: str, use: Callable[..., Column]) -> DataFrame:
        """Adds a column of (key, bucket, bounds); the bucket is the number of bounds that are not
        above the key, found by halving. Key and bucket are computed once for each row."""
        widths = F.array(*[F.lit(1 << i) for i in reversed(range(self.n.bit_length()))])
        bounds = F.col("_bounds")

        def bucket(key: Column) -> Column:
            def step(at: Column, width: Column) -> Column:
                fits = F.get(bounds, at + width - 1) <= key
                return at + F.when(fits, width).otherwise(0)

            return F.aggregate(widths, F.lit(0), step)

        def once(value: Column, then: Callable[[Column], Column]) -> Column:
            return F.get(F.transform(F.array(value), then), F.lit(0))

        found = once(self.key, lambda key: once(bucket(key), lambda at: use(key, at, bounds)))
        return df.withColumn("_bounds", self.bounds.scalar()).withColumn(name, found).drop("_bounds")

    def _rows_before(self, df: DataFrame) -> list[int]:
        """Per bucket the rows of its first group, which is that of its bound, in earlier ones."""

        def goes_on(key: Column, at: Column, bounds: Column) -> Column:
            following = F.get(bounds, at)
            return F.when(following.isNotNull() & self._same_group(key, following), at)

        counts = self._with(df, "_at", goes_on).where("_at IS NOT NULL").groupBy("_at").count()
        ahead = {row["_at"]: row["count"] for row in counts.collect()}
        flags = [True] * self.n
        if self.by:
            pairs = F.arrays_zip(F.slice("_bounds", 2, self.n).alias("a"), F.col("_bounds").alias("b"))
            same = F.transform(pairs, lambda p: self._same_group(p["a"], p["b"]))
            flags = self.bounds.select(same).first()[0]
        before = [0]
        for bucket in range(1, self.n):
            # The bucket before lies within the group if the bound before is of it too.
            within = bucket > 1 and flags[bucket - 2]
            before.append(ahead.get(bucket - 1, 0) + (before[-1] if within else 0))
        return before

    def numbered(self, df: DataFrame) -> DataFrame:
        """Adds ``position``."""

        def place(key: Column, at: Column, bounds: Column) -> Column:
            first = (at > 0) & self._same_group(key, F.get(bounds, at - 1))
            before = F.get(F.lit(self.before).cast("array<bigint>"), at)
            return F.struct(at.alias("bucket"), F.when(first, before).otherwise(0).alias("before"))

        if self.n == 1:
            zero = F.struct(F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("before"))
            cut = df.withColumn("_at", zero)
        else:
            cut = self._with(df, "_at", place)
        inside = Window.partitionBy("_at.bucket", *map(_name, self.by))
        number = F.row_number().over(inside.orderBy(*map(_name, self.order), self.tie))
        position = number.cast("bigint") - 1 + F.col("_at.before")
        return cut.withColumn("position", position).drop("_at")


def with_position(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adds ``position``: the 0-based place of a row by ``order`` inside its ``by`` group.

    Rows go into buckets of neighbours in the order, those of a hot group too, and are numbered
    there; one shuffle moves each row once. Bounds of the buckets and the number of rows before
    each are constants of the plan: when this is called, up to three jobs read the key columns to
    find the number of rows, a sample of the keys, and the rows of each bucket. ``df`` has to give
    the same rows each time. Rows that tie in the order go by a hash of all their columns, so that
    places are the same in each run and a constant order spreads as well; only rows that agree in
    every column stay together. Nulls come first. A bucket holds ``bucket_rows`` rows on average,
    or more once there are as many buckets as pieces of a join.
    """
    return _Buckets(df, list(by), list(order), bucket_rows).numbered(df)


def with_index(
    df: DataFrame,
    order: Sequence[str],
    name_col: str | None = None,
    default_name: str = "unnamed-role-",
) -> DataFrame:
    """Adds the 1-based ``index``; a missing ``name_col`` value becomes ``default_name`` + index."""
    indexed = with_position(df, order).withColumn("index", F.col("position") + 1).drop("position")
    if name_col is None:
        return indexed
    fallback = F.concat(F.lit(default_name), F.col("index").cast("string"))
    return indexed.withColumn(name_col, F.coalesce(name_col, fallback))


def chunk_rows(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``chunk_id``: ordered batches of ``n`` rows, counted from 0 inside each ``by`` group."""
    placed = with_position(df, order, by)
    return placed.withColumn("chunk_id", F.expr(f"position div {int(n)}")).drop("position")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: str | Column, last: bool = False
) -> DataFrame:
    """One row per key, the first by ``order``, a row without order only where all are; of rows
    that tie the same one each time, by a hash of the row. Copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    order = F.col(order) if isinstance(order, str) else order
    order = F.struct(order.isNotNull() if last else order.isNull(), order, row_hash(df))
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def _key_hash(kinds: Sequence[tuple[str, DataType]]) -> Column:
    return F.xxhash64(*[F.col(name).cast(kind) for name, kind in kinds])


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    pieces: int,
    kinds: Sequence[tuple[str, DataType]] | None = None,
) -> dict[int, int]:
    """Hash of each key with more than one part in ``pieces`` of all rows, and its parts.

    One pass over the key columns: a sketch of frequent items, which holds a bounded number of
    them, finds each hot key and counts it with an error below a part. ``kinds`` names the types in which
    the keys are joined, if they are not those of ``df``.
    """
    if pieces < 2:
        return {}
    kinds = kinds or [(k, df.schema[k].dataType) for k in keys]
    some = [F.col(k).isNotNull() for k in keys]
    hashed = F.when(reduce(Column.__and__, some), _key_hash(kinds))
    counted = min(pieces * _COUNTED_PER_PIECE, _MOST_COUNTED)
    frequent = F.call_function("approx_top_k", hashed, F.lit(min(pieces, counted)), F.lit(counted))
    found = df.agg(frequent.alias("found"), F.count(F.lit(1)).alias("n")).first()
    parts = {row["item"]: -(-row["count"] * pieces // found["n"]) for row in found["found"] or []}
    return {item: n for item, n in parts.items() if item is not None and n > 1}


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "inner",
    pieces: int | None = None,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Equi-join that cuts the rows of hot keys of ``big`` into pieces of equal size.

    A key is hot with more than one part in ``pieces`` of all rows, so fewer than ``pieces``
    keys can be; their hashes are literals of the plan, whatever the data. Each goes over as many
    salts as it has such parts; rows of ``small`` are repeated for hot keys alone, fewer than
    ``2 * pieces`` times in all per row of one key. ``pieces`` goes by the shuffle partitions of
    the session unless given. When this is called, ``big`` is read once for its keys; a caller that
    knows them hands in ``hot``, as ``hot_keys`` gives it. ``spread_by`` tells the rows of ``big``
    apart. ``how`` is inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    pieces = pieces or _pieces(big)
    # Equal keys have equal hashes only if they are of one type.
    both = big.select(*keys).unionAll(small.select(*keys)).schema
    kinds = [(field.name, field.dataType) for field in both.fields]
    hot = hot_keys(big, keys, pieces, kinds) if hot is None else hot
    salts = F.lit(1)
    if hot:
        table = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        salts = F.coalesce(F.try_element_at(table, _key_hash(kinds)), F.lit(1))
    # A null key matches nothing, so its rows may go anywhere.
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    spread = F.pmod(F.xxhash64(spread_by), F.when(no_key, F.lit(pieces)).otherwise(salts)).cast("int")
    left = big.withColumn("_salt", spread)
    every = F.explode(F.sequence(F.lit(0), salts - 1)) if hot else F.lit(0)
    right = small.withColumn("_salt", every)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; each task keeps ``k`` rows, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def concat_pages(*pages: DataFrame) -> DataFrame:
    """Bag union by column name; a column that a page lacks is null there."""
    result = pages[0]
    for page in pages[1:]:
        result = result.unionByName(page, allowMissingColumns=True)
    return result


def sample_rows(
    df: DataFrame, fraction: float = 0.01, keys: Sequence[str] | None = None, *, seed: int
) -> DataFrame:
    """About ``fraction`` of the rows by a hash of ``seed`` and ``keys``, or of all columns: the
    same rows however they are partitioned. Rows with equal keys are sampled alike; a null key
    counts as empty."""
    names = df.columns if keys is None else keys
    columns = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in names]
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c, F.lit("")) for c in columns])
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.where(place < F.lit(int(fraction * (1 << 32))))
