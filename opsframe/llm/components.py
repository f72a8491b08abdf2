"""Connected components by alternating stars, every step a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsframe.session import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Large-star joins what lies above a node to the smallest node near it, small-star what lies
    below; both keep the components and end in stars. Only counts come to the driver.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "star",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.selectExpr("u", "m v").unionByName(
            small.where("v <> m").selectExpr("v u", "m v")
        )
        after = staged(small.where("u <> v").distinct(), "star")
        changed = _state(after)
        discard(edges)
        edges = after
        if changed == state:
            break
        state = changed
    nodes = edges.selectExpr("u node", "v component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots.distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")
    ).first()
    return row["n"], row["hash"]
