"""Benchmark passages in documents by winnowing, in built-in expressions only.

Both sides keep, of every ``span`` successive word k-grams, the one with the least hash. Equal
windows keep the same k-gram, so that joining these fingerprints meets every shared window. What
meets gives an alignment of document and item; it is extended word by word, and only windows that
are equal as a whole count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsframe.session import staged

#: Fixed by the contract: what separates words once A-Z count as a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """The words of a text; none for null."""
    low = F.translate(text, _UPPER, _LOWER)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _with_fingerprints(df: DataFrame, window: int) -> DataFrame:
    """Adds ``prints``: place and hash of the k-grams that are least in some window of ``words``."""
    k = min(GRAM, window)
    reach = window - k + 1
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    grams = F.expr(
        f"CASE WHEN size(_h) >= {window} THEN transform(sequence(0, size(_h) - {k}), i -> "
        f"xxhash64({', '.join(f'_h[i + {j}]' for j in range(k))})) END"
    )
    # The leftmost of the least, for every window of grams.
    chosen = F.expr(
        f"array_distinct(transform(transform(sequence(1, size(_g) - {reach - 1}), "
        f"i -> struct(i, slice(_g, i, {reach}) AS s)), "
        f"x -> x.i + CAST(array_position(x.s, array_min(x.s)) AS int) - 2))"
    )
    prints = F.expr("transform(_c, p -> struct(p AS place, _g[p] AS print))")
    return (
        df.withColumn("_h", hashes)
        .withColumn("_g", grams)
        .withColumn("_c", chosen)
        .withColumn("prints", prints)
        .drop("_h", "_g", "_c")
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, part, n_words, n_hit, item_ids) per row of ``docs``.

    A window is ``window`` successive words of an item, or all of an item that has fewer but some;
    ``n_hit`` are the document's words inside an occurrence of any window, ``item_ids`` the items
    (as text, sorted, each once) with one. Null and wordless texts have no words, and an item
    without words is in nothing. An item without an id hits, but is in no list. ``part`` is a hash
    of the text that tells rows with the same id apart; rows that repeat both give equal results.
    Other columns are ignored. No items give no hits.
    """
    items = items.select(
        F.col(item_col).cast("string").alias("item"), word_list(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    items = staged(items.withColumn("reach", F.least(F.size("words"), F.lit(window))), "bench-items")
    items = items.withColumn("item_key", F.xxhash64("item", "words"))
    # Items shorter than a window have one window of their own; the least of them sets the length
    # that their fingerprints guarantee.
    least = items.where(F.col("reach") < window).agg(F.min("reach")).first()[0]
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("part"),
        F.col(text_col).alias("text"),
    )
    worded = texts.select("id", "part", word_list(F.col("text")).alias("words"))
    first = _met(worded, items.where(F.col("reach") == window), window, True)
    met = staged(first, "bench-met")
    rows = met.where("item_key IS NULL").select("id", "part", "n_words")
    pairs = met.where("item_key IS NOT NULL").select("id", "part", "item_key", "shift")
    if least is not None:
        short = _met(worded, items.where(F.col("reach") < window), least, False)
        pairs = pairs.unionByName(short.select("id", "part", "item_key", "shift"))
    pairs = staged(pairs.distinct(), "bench-pairs")
    # The words of the documents that met an item, once more, and those of the items.
    wanted = pairs.select(F.col("id").alias("w_id"), F.col("part").alias("w_part")).distinct()
    near = texts.join(
        wanted, texts.id.eqNullSafe(wanted.w_id) & (texts.part == wanted.w_part), "left_semi"
    )
    near = near.select("id", "part", word_list(F.col("text")).alias("words"))
    near = near.dropDuplicates(["id", "part"]).withColumnRenamed("words", "held")
    aligned = (
        pairs.alias("p")
        .join(near.alias("n"), F.expr("p.id <=> n.id AND p.part = n.part"))
        .join(items.alias("i"), F.expr("p.item_key = i.item_key"))
        .select("p.id", "p.part", "i.item", "i.words", "i.reach", "n.held", "p.shift")
        .withColumn(
            "starts",
            F.expr(
                "CASE WHEN least(size(words), size(held) - shift) - reach >= greatest(0, -shift) THEN"
                " filter(sequence(greatest(0, -shift), least(size(words), size(held) - shift) - reach),"
                " j -> slice(words, j + 1, reach) = slice(held, j + shift + 1, reach)) END"
            ),
        )
    )
    hits = staged(
        aligned.where(F.size("starts") > 0).select(
            "id",
            "part",
            "item",
            F.expr(
                "array_distinct(flatten(transform(starts, "
                "j -> sequence(j + shift, j + shift + reach - 1))))"
            ).alias("places"),
        ),
        "bench-hits",
    )
    places = hits.select("id", "part", F.explode("places").alias("place")).distinct()
    counts = places.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = hits.groupBy("id", "part").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = counts.alias("c").join(
        listed.alias("l"), F.expr("c.id <=> l.id AND c.part = l.part")
    ).select("c.id", "c.part", "n_hit", "item_ids")
    none = F.array().cast("array<string>")
    return (
        rows.alias("r")
        .join(found.alias("f"), F.expr("r.id <=> f.id AND r.part = f.part"), "left")
        .select(
            F.col("r.id").alias(id_col),
            "r.part",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("item_ids", none).alias("item_ids"),
        )
    )


def _met(docs: DataFrame, items: DataFrame, window: int, all_rows: bool) -> DataFrame:
    """(id, part, n_words, item_key, shift): alignments that share a fingerprint; with
    ``all_rows`` also a row without item for each document.

    The item side is one row per fingerprint and item; Spark broadcasts it where its size, known
    from the staged table, allows, and shuffles otherwise.
    """
    sides = _with_fingerprints(items, window).select("item_key", F.inline("prints"))
    sides = staged(
        sides.select("item_key", F.col("place").alias("at"), F.col("print").alias("known")).distinct(),
        "bench-prints",
    )
    found = _with_fingerprints(docs, window)
    prints = F.coalesce("prints", F.expr("CAST(array() AS array<struct<place int, print long>>)"))
    if all_rows:
        prints = F.concat(F.expr("array(struct(-1 AS place, CAST(NULL AS long) AS print))"), prints)
    spread = found.select(
        "id", "part", F.size("words").cast("long").alias("n_words"), F.inline(prints)
    )
    met = spread.join(sides, spread.print == sides.known, "left" if all_rows else "inner")
    return met.where(F.expr("place = -1 OR item_key IS NOT NULL")).select(
        "id", "part", "n_words", "item_key", (F.col("place") - F.col("at")).alias("shift")
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are hit, at least one."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
