"""Mixing sources to target weights along a curriculum.

Targets come from the sources' sizes alone. Each source's rows are then put in a pseudo-random
order, and their running word count is set against the source's cumulative demand: the integral of
its weight schedule, scaled to its target. Inverting it gives each row, and each repeat of it, its
position in training; a range sort by it puts the copies of all sources into training order.
Running counts are taken per source and hash bucket and then over the bucket sums, so that a source
with a third of all rows is spread over thousands of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsframe.operators.ordering import row_hash, with_position
from opsframe.session import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weight schedules over training time 0 to 1, as straight lines between (time, weight), one per
#: place in the list of weights: what weighs most comes early, what weighs least comes late.
CURRICULUM = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)
Schedule = Sequence[tuple[float, float]]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    curriculum: Sequence[Schedule] = CURRICULUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, taken, first_at, again_at.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``percent`` of all
    words; a target stops at ``most`` (1 or 2) times its source's words, and the excess is shared
    again. ``taken`` is what the mix takes of the row, its repeat counted: it takes rows in an
    order given by the id, cuts the one in which the target is reached, and comes to the target's
    whole words exactly. ``first_at`` and ``again_at`` are the row's training positions from 0
    to 1 (null where it isn't taken). Empty and null texts have size 0, are taken nowhere and stay
    in the result; rows with equal ids and sizes may trade places. No rows give no rows. Columns
    of ``docs`` with the names of the new ones are replaced.
    """
    made = ("size", "source_size", "target", "taken", "first_at", "again_at")
    rest = [c for c in docs.columns if c not in made]
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        *rest,
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("_order"),
        F.substring(order, 1, 3).alias("_bucket"),
        # Without nulls, so that the window and the join below share one shuffle.
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_source"),
    )
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    sums = staged(sums, "mix-sums")
    targets = _targets(sums, weights, percent, most)
    # Where each bucket of a source begins: at most 4096 rows per source.
    before = Window.partitionBy("_source").orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("_begin", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    begins = begins.join(targets, "_source").select(
        "_source", "_bucket", "_begin", "source_size", "target", "_class"
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", id_col, "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.join(begins, ["_source", "_bucket"])
    placed = placed.withColumn("_start", F.col("_begin") + F.col("_inside"))
    goal = F.floor("target")
    once = _between(goal - F.col("_start"), F.col("size"))
    again = _between(goal - F.col("source_size") - F.col("_start"), F.col("size"))
    first_at = _inverse(F.col("_start") / F.col("target"), curriculum)
    again_at = _inverse((F.col("_start") + F.col("source_size")) / F.col("target"), curriculum)
    return placed.select(
        *rest,
        "size",
        "source_size",
        "target",
        (once + again).alias("taken"),
        F.when(once > 0, first_at).alias("first_at"),
        F.when(again > 0, again_at).alias("again_at"),
    )


def in_training_order(mixed: DataFrame, every: bool = False) -> DataFrame:
    """One row per copy that the mix takes at least half of, range-sorted by ``position``.

    ``copy`` is 1, or 2 for the repeat, and ``words`` what the mix takes of it; columns of
    ``mixed`` with these names are replaced. With ``every``, copies that it takes less of stay as
    well, and each row that it takes nowhere comes last, as a copy of no words without a position.
    Ties, and these last rows, go by a hash of the row: reruns agree on the order, and only rows
    that agree in every column stay together.
    """
    first, again = F.least("taken", "size"), F.greatest(F.col("taken") - F.col("size"), F.lit(0))
    copies = []
    for number, words, at in ((1, first, "first_at"), (2, again, "again_at")):
        copy = F.struct(
            F.lit(number).alias("copy"), words.alias("words"), F.col(at).alias("position")
        )
        whole = (F.col("size") > 0) & (2 * words >= F.col("size"))
        some = (words > 0) | F.lit(number == 1)
        copies.append(F.when(some if every else whole, copy))
    kept = F.filter(F.array(*copies), lambda x: x.isNotNull())
    rest = [c for c in mixed.columns if c not in ("copy", "words", "position")]
    rows = mixed.select(*rest, F.explode(kept).alias("_copy")).select(*rest, "_copy.*")
    order = (F.col("position").asc_nulls_last(), row_hash(rows))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _between(x: Column, most: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), most).cast("long")


def _targets(sums: DataFrame, weights: Sequence[float], percent: int, most: int) -> DataFrame:
    """(_source, source_size, _class, target) by filling up: what lies above a source's limit is
    shared again, until no target is above its own. Only sums come to the driver."""
    sizes = sums.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    sizes = sizes.withColumn("_last", F.col("_source") == "")  # documents without a source
    sizes = with_position(sizes, ["_last", "_source"])
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    sizes = sizes.select(
        "_source",
        "source_size",
        F.pmod("position", F.lit(len(weights))).cast("int").alias("_class"),
        F.element_at(kinds, F.pmod("position", F.lit(len(weights))).cast("int") + 1).alias("_w"),
        (F.col("source_size") * most).alias("_limit"),
    )
    sizes = staged(sizes, "mix-targets")
    share, full = None, -1
    while True:
        above = F.lit(False) if share is None else F.lit(share) * F.col("_w") >= F.col("_limit")
        row = sizes.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(above, F.col("_limit"))).alias("limits"),
            F.sum(F.when(~above, F.col("_w"))).alias("weights"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["weights"]:
            break
        full = row["full"]
        share = (row["words"] * percent / 100 - (row["limits"] or 0)) / row["weights"]
    share = share or 0.0
    target = F.least(F.lit(share) * F.col("_w"), F.col("_limit").cast("double"))
    return sizes.select("_source", "source_size", "_class", target.alias("target"))


def _inverse(part: Column, curriculum: Sequence[Schedule]) -> Column:
    """The training time at which a source's cumulative demand has come to ``part`` of it."""
    found = F.lit(None).cast("double")
    for place, schedule in enumerate(curriculum):
        pieces = [
            (t0, w0, (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0))
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])
        ]
        whole = sum(area for *_, area in pieces)
        time, done = F.lit(schedule[-1][0]), whole
        for t0, w0, slope, area in reversed(pieces):
            done -= area
            rest = part * whole - done
            # The root of slope / 2 * x**2 + w0 * x = rest, in a form that slope 0 allows.
            step = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
            time = F.when(part * whole < done + area, F.lit(t0) + step).otherwise(time)
        found = F.when(F.col("_class") % len(curriculum) == place, time).otherwise(found)
    return found
