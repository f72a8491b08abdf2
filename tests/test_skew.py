"""One key with a third of all rows: the plans must split it, the results must not change."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsframe.operators import catalog, logs, objects, ordering, policies as pol

ROWS = 60000


@pytest.fixture
def skewed(spark):
    """No broadcasts and no skew handling by Spark."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def largest_task(frame):
    """Rows of the fullest task that puts the result out."""
    counts = frame.withColumn("task", F.spark_partition_id()).groupBy("task").count()
    return counts.agg(F.max("count")).first()[0]


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    rows = frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return rows, text[: text.find("== Initial Plan ==")]


def hot_rows(spark, hot, other):
    """Rows whose key is ``hot`` for every third of them."""
    pick = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(other)
    return spark.range(0, ROWS, 1, 12).withColumn("key", pick)


def test_hot_table_in_the_key_audit(skewed):
    partitions = hot_rows(skewed, 7, F.col("id") % 500).selectExpr(
        "id AS PART_ID", "key AS TBL_ID", "'k' || (id % 2) || '=' || uuid() AS PART_NAME"
    )
    tables = skewed.range(500)
    ms = {
        "DBS": skewed.range(1).selectExpr("id AS DB_ID", "'db' AS NAME"),
        "TBLS": tables.selectExpr(
            "id AS TBL_ID", "0L AS DB_ID", "id AS SD_ID", "'t' || id AS TBL_NAME"
        ),
        "PARTITIONS": partitions,
        "PARTITION_KEYS": tables.selectExpr("id AS TBL_ID", "'k0' AS PKEY_NAME"),
    }
    mismatches = catalog.partition_key_mismatch(ms)
    assert mismatches.count() == ROWS // 2
    assert largest_task(mismatches.where("TBL_ID = 7")) < ROWS // 6 // 5


def test_hot_name_among_incoming_policies(skewed):
    incoming = hot_rows(skewed, -1, F.col("id")).selectExpr(
        "id AS ord", "'s' AS service", "'p' || key AS name", "uuid() AS body"
    )
    existing = skewed.range(0, ROWS, 2).selectExpr(
        "id AS ord", "'s' AS service", "'p' || id AS name", "id + 10 AS id"
    )
    plan = pol.plan_policy_upsert(incoming, existing, override=False)
    rows = plan.collect()
    hot = Counter(r["action"] for r in rows if r["name"] == "p-1")
    assert hot == {"create": 1, "fail": ROWS // 3 - 1}
    assert len(rows) == ROWS
    assert largest_task(plan.where("name = 'p-1'")) < ROWS // 3 // 5


def test_hot_policy_among_unmatched_grants(skewed):
    grants = hot_rows(skewed, -1, F.col("id")).selectExpr(
        "id AS row_no", "'p' || key AS policy_name", "uuid() AS group_name", "'r' AS permissions"
    )
    policies = skewed.range(500).selectExpr("'p' || id AS name", "'cm_hdfs' AS service")
    left = pol.unmatched_grants(policies, grants)
    known = sum(1 for i in range(500) if i % 3)
    assert left.count() == ROWS - known
    assert largest_task(left.where("policy_name = 'p-1'")) < ROWS // 3 // 5


def test_hot_query_id_is_spread_over_the_chunks(skewed):
    lines = hot_rows(skewed, "hot", F.concat(F.lit("q"), F.col("id").cast("string"))).select(
        F.lit(0).alias("file_rank"),
        F.floor(F.col("id") / 1000).alias("block"),
        F.col("id").alias("line_no"),
        F.when(
            F.floor(F.col("id") / 3) % 2 == 0,
            F.concat(F.lit("Compiling command(queryId="), "key", F.lit("): user=u; query=x")),
        )
        .otherwise(
            F.concat(
                F.lit("Completed compiling command(queryId="), "key", F.lit("); compileTime=1ms")
            )
        )
        .alias("line"),
        F.lit("f").alias("source_log"),
    )
    events = logs.classify_log_lines(lines)
    pairs = logs.pair_compile_events(events)
    rows, plan = final_plan(pairs)
    assert Counter(r["query_id"] for r in rows) == {"hot": ROWS // 6}
    # Lines are parsed once, and each window runs once.
    parsing = final_plan(events)[1].count("Generate ")
    assert plan.count("Generate ") == parsing > 0
    assert plan.count("Window ") == 2 and "Union" not in plan
    # Rows of the hot id that come out of a task of this very plan.
    outcomes = logs.event_outcomes(events).where("query_id = 'hot'").select("line_no", "outcome")
    assert largest_task(outcomes) < ROWS // 3 // 5


def test_hot_group_of_grants_shrinks_before_the_shuffle(skewed):
    grants = hot_rows(skewed, 1, F.col("id") % 50).selectExpr(
        "id AS row_no", "'p' || key AS policy_name", "'g' || (id % 4) AS group_name",
        "'rw' AS permissions",
    )
    policies = skewed.range(50).selectExpr(
        "id", "'p' || id AS name", "'cm_hdfs' AS service",
        "array(named_struct('accesses', array(named_struct('type', 'read', 'isAllowed', true)), "
        "'groups', array('g0'))) AS policyItems",
    )
    rows, plan = final_plan(pol.merge_grants(policies, grants))
    assert len(rows) == 50
    hot = [r for r in rows if r["name"] == "p1"][0]["policyItems"]
    assert [a["type"] for a in hot[0]["accesses"]] == ["read", "write"]
    assert sorted(i["groups"][0] for i in hot[1:]) == ["g1", "g2", "g3"]
    first = plan[: plan.rindex("FileScan") if "FileScan" in plan else len(plan)]
    assert "partial_min" in first


def test_one_hot_folder_is_counted_by_partial_sums(skewed):
    listing = hot_rows(skewed, "2024-01-01", F.lit("2024-01-02")).select(
        F.concat_ws("/", F.lit("wal_backups"), "key", F.col("id").cast("string")).alias("key")
    )
    rows, plan = final_plan(objects.expired_folders(listing, "2024-06-01 00:00:00"))
    assert {r["folder"]: r["n_objects"] for r in rows} == {
        "2024-01-01": ROWS // 3,
        "2024-01-02": ROWS - ROWS // 3,
    }
    assert "partial_count" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_one(skewed, how):
    big = hot_rows(skewed, 3, F.when(F.col("id") % 3 == 1, F.col("id") % 700)).selectExpr(
        "key AS k", "id"
    )
    small = skewed.range(0, 500, 3).selectExpr("id AS k", "id * 2 AS v").unionAll(
        skewed.range(3, 4).selectExpr("id AS k", "-1L AS v")
    )
    salted = ordering.salted_join(big, small, ["k"], "id", how)
    plain = big.join(small, "k", how)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    if how == "left_anti":
        assert largest_task(salted.where("k IS NULL")) < ROWS // 3 // 5


def test_hot_keys_are_found_in_one_pass_or_handed_in(skewed):
    big = hot_rows(skewed, 3, F.col("id") + 100).selectExpr("cast(key AS int) AS k", "id")
    small = skewed.range(0, 1000).selectExpr("id AS k", "id * 2 AS v")
    hot = ordering.hot_keys(big, ["k"], 160)
    assert len(hot) == 1 and 52 <= min(hot.values()) <= 56
    # Types that differ are joined, and hashed, as the wider one.
    salted = ordering.salted_join(big, small, ["k"], "id", "left")
    plain = big.join(small, "k", "left")
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    assert largest_task(salted.where("k = 3")) < ROWS // 3 // 5
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2 and plan.count("Join") == 1
    kinds = [("k", small.schema["k"].dataType)]
    given = ordering.salted_join(big, small, ["k"], "id", hot=ordering.hot_keys(big, ["k"], 160, kinds))
    assert largest_task(given.where("k = 3")) < ROWS // 3 // 5
