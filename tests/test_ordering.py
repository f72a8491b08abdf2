import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opsframe.operators import ordering


@pytest.fixture
def rows(spark):
    """Shuffled keys, half of them in one group, one group without a name."""
    rng = random.Random(3)
    keys = list(range(4000))
    rng.shuffle(keys)
    data = [("hot" if k % 2 else rng.choice(["a", "b", None]), k) for k in keys]
    return data, spark.createDataFrame(data, "grp STRING, k BIGINT").repartition(9)


def expected(data):
    places, seen = {}, {}
    for group, key in sorted(data, key=lambda r: r[1]):
        places[key] = seen.get(group, 0)
        seen[group] = places[key] + 1
    return places


def test_positions_inside_groups(rows):
    data, frame = rows
    placed = ordering.with_position(frame, ["k"], by=["grp"]).collect()
    assert {r["k"]: r["position"] for r in placed} == expected(data)
    assert len(placed) == len(data)


def test_a_hot_group_is_spread(spark, rows):
    _, frame = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = frame.repartitionByRange("grp", "k").withColumn("part", F.spark_partition_id())
        assert spread.where("grp = 'hot'").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def forty_tasks(spark):
    settings = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("bucket_rows", [40, 700, 1 << 16])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("order", [["k"], ["t", "k"], ["t"]])
def test_positions_by_any_buckets(spark, bucket_rows, by, order):
    rng = random.Random(bucket_rows)
    data = [
        (rng.choice(["hot", "hot", "a", "b", None]), i // 7, rng.choice([1.5, 1.5, 1.5, 2.0, None]), i)
        for i in rng.sample(range(2000), 2000)
    ]
    frame = spark.createDataFrame(data, "g STRING, h INT, t DOUBLE, k BIGINT").repartition(5)
    placed = ordering.with_position(frame, order, by, bucket_rows).collect()
    assert len(placed) == len(data) and len({r["k"] for r in placed}) == len(data)
    groups = {}
    for r in sorted(placed, key=lambda r: r["position"]):
        key = [(r[c] is not None, r[c]) for c in order]
        groups.setdefault(tuple(r[c] for c in by), []).append((r["position"], key))
    for rows_of_group in groups.values():
        assert [p for p, _ in rows_of_group] == list(range(len(rows_of_group)))
        keys = [key for _, key in rows_of_group]
        assert keys == sorted(keys)


def test_positions_take_one_shuffle_and_write_nothing(spark, rows, forty_tasks):
    _, frame = rows
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.rglob("*"))
    placed = ordering.with_position(frame.repartition(3), ["k"], ["grp"], bucket_rows=50)
    placed.collect()
    assert set(root.rglob("*")) == before
    plan = placed._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("== Initial Plan ==")]
    # The one by the test itself, and one by buckets.
    assert plan.count("Exchange ") == 2 and "Join" not in plan


@pytest.mark.parametrize("by", [[], ["g"]])
def test_a_constant_order_spreads(spark, by, forty_tasks):
    frame = spark.range(0, 20_000, 1, 8).selectExpr("1 AS g", "1 AS t", "id AS k")
    placed = ordering.with_position(frame, ["t"], by, bucket_rows=200)
    tasks = placed.withColumn("task", F.spark_partition_id()).groupBy("task")
    per_task = tasks.agg(F.count("position").alias("n")).agg(F.max("n")).first()[0]
    assert per_task < 20_000 / 8
    again = ordering.with_position(frame.repartition(3, "k"), ["t"], by, bucket_rows=300)
    assert {r["k"]: r["position"] for r in placed.collect()} == {
        r["k"]: r["position"] for r in again.collect()
    }


def test_positions_of_rows_with_maps_and_odd_names(spark):
    frame = spark.sql(
        "SELECT id % 3 AS `a.b`, map('x', struct(id)) AS m, parse_json(cast(id AS string)) AS v, "
        "0 AS `_bucket2` FROM range(300)"
    )
    placed = ordering.with_position(frame, ["a.b"], bucket_rows=20)
    assert placed.columns == [*frame.columns, "position"]
    assert sorted(r["position"] for r in placed.collect()) == list(range(300))


def test_index_without_groups(rows):
    _, frame = rows
    indexed = ordering.with_index(frame, ["k"]).collect()
    assert all(r["index"] == r["k"] + 1 for r in indexed)


def test_missing_names_get_the_index(spark):
    frame = spark.createDataFrame([(1, "x"), (2, None)], "k INT, name STRING")
    named = ordering.with_index(frame, ["k"], name_col="name").orderBy("k").collect()
    assert [r["name"] for r in named] == ["x", "unnamed-role-2"]


def test_chunks_have_the_asked_size(rows):
    data, frame = rows
    chunked = ordering.chunk_rows(frame, 100, ["k"], by=["grp"]).collect()
    places = expected(data)
    assert {r["k"]: r["chunk_id"] for r in chunked} == {k: p // 100 for k, p in places.items()}


def test_empty_input(spark):
    frame = spark.createDataFrame([], "k INT")
    assert ordering.chunk_rows(frame, 10, ["k"]).count() == 0


def test_first_per_key(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")]
    frame = spark.createDataFrame(rows, "g STRING, o INT, v STRING")
    first = {r["g"]: r["v"] for r in ordering.first_per_key(frame, ["g"], "o").collect()}
    assert first == {"a": "y", "b": "z"}
    last = {r["g"]: r["v"] for r in ordering.first_per_key(frame, ["g"], "o", last=True).collect()}
    assert last == {"a": "x", "b": "z"}


def test_first_per_key_without_order(spark):
    frame = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 3, "z")], "g STRING, o INT, v STRING")
    for last in (False, True):
        found = {r["g"]: r["v"] for r in ordering.first_per_key(frame, ["g"], "o", last=last).collect()}
        assert found == {"a": "x", "b": "z"}


@pytest.mark.parametrize("last", [False, True])
def test_first_per_key_of_ties_is_the_same_row_each_time(spark, last):
    frame = spark.range(500).selectExpr("id % 5 AS g", "1 AS o", "id AS v")
    found = [
        sorted(tuple(r) for r in ordering.first_per_key(f, ["g"], "o", last=last).collect())
        for f in (frame, frame.repartition(7, "v"), frame.orderBy(F.desc("v")))
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 5


def test_concat_pages_keeps_copies(spark):
    a, b = spark.createDataFrame([(1,)], "x INT"), spark.createDataFrame([(1, 2)], "x INT, y INT")
    rows = ordering.concat_pages(a, b).orderBy(F.col("y").asc_nulls_first()).collect()
    assert [tuple(r) for r in rows] == [(1, None), (1, 2)]


def test_sample_is_repeatable(spark):
    frame = spark.range(10000)
    first = ordering.sample_rows(frame, 0.1, seed=4).collect()
    other = ordering.sample_rows(frame.repartition(7), 0.1, seed=4).orderBy("id").collect()
    assert first == other
    assert 700 < len(first) < 1300
