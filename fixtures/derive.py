"""The library's inputs, derived by Spark from the given parquet tables.

No table is cut down: every row of a base table becomes a row of the input, and the cases that
matter (nulls, absent partners, repeated keys) come from remapped values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsframe.session import shared_dir

SERVICE = (
    "CASE p_size % 3 WHEN 0 THEN 'cm_hive' WHEN 1 THEN 'cm_hdfs' ELSE 'cm_kafka' END AS service"
)
NOW_WORKLOAD = "2024-01-31 00:00:00"
NOW_ROWS = "2024-02-15 00:00:00"
NOW_OBJECTS = "2001-08-01 12:00:00"
BACKUP_DATE = "1998-10-03"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event; a file per day, a chunk per hour, query ids per user."""
    return (
        table(spark, sf_dir, "events")
        .withColumns(
            {
                "stamp": F.when(
                    F.col("event_id") % 97 != 0,
                    F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" ")),
                ),
                "query": F.expr(
                    "'SELECT 1' || repeat(' union  ALL SELECT 1', CAST(event_id % 6 AS INT))"
                ),
            }
        )
        .select(
            F.expr("datediff(ts, DATE'2024-01-01')").alias("file_rank"),
            F.hour("ts").cast("bigint").alias("block"),
            F.col("event_id").alias("line_no"),
            F.concat(
                F.coalesce("stamp", F.lit("")),
                F.when(
                    F.col("event_type").isin("error", "signup"),
                    F.expr(
                        "'INFO  Completed compiling command(queryId=q' || user_id || "
                        "'); compileTime=' || CAST(round(value * 100) AS BIGINT) || 'ms'"
                    ),
                ).otherwise(
                    F.expr(
                        "'INFO  Compiling command(queryId=q' || user_id || '): user=svc_' || "
                        "(event_id % 11) || '; query=' || query"
                    )
                ),
            ).alias("line"),
            F.concat(
                F.lit("server-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")
            ).alias("source_log"),
        )
    )


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The same lines as text files in log order; returns their folder."""
    path = shared_dir(spark, "log-files")
    lines = log_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select("line").write.text(path)
    return path


def query_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw workload records, one per event, numbers and flags as text attributes."""
    return table(spark, sf_dir, "events").select(
        F.expr("'q' || event_id").alias("queryId"),
        F.expr("CASE WHEN user_id % 25 <> 0 THEN 'u' || user_id END").alias("user"),
        F.lit("FINISHED").alias("queryState"),
        F.col("ts").alias("startTime"),
        F.expr(
            """map(
              'query_duration', CAST(CAST(round(value * 100) AS BIGINT) AS STRING),
              'spilled', CASE event_type WHEN 'error' THEN 'true' WHEN 'signup' THEN 'TRUE'
                                         WHEN 'click' THEN 'false' END,
              'stats_missing', CASE WHEN event_id % 3 = 0 THEN 'true' END,
              'admission_wait', CASE WHEN event_id % 2 = 1
                 THEN CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 60 AS STRING) END,
              'rows_inserted', CAST(event_id AS STRING),
              'request_pool', CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN NULL
                                              ELSE 'root.' || event_type END,
              'pool', CASE WHEN event_id % 2 = 0 THEN 'etl' END)"""
        ).alias("attributes"),
        F.expr(
            """named_struct(
              'hostname', CASE WHEN user_id % 5 = 0 THEN '' ELSE 'node' || (user_id % 8) END,
              'hostId', CASE WHEN user_id % 10 = 0 THEN 'id' || user_id END)"""
        ).alias("coordinator"),
    )


def metastore(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A catalog with a table per customer, columns from orders, partitions from lineitem."""
    customer = table(spark, sf_dir, "customer")
    return {
        "DBS": table(spark, sf_dir, "nation").selectExpr(
            "n_nationkey AS DB_ID", "n_name AS NAME"
        ),
        "TBLS": customer.selectExpr(
            "c_custkey AS TBL_ID", "c_nationkey AS DB_ID", "c_custkey + 1 AS SD_ID",
            "c_name AS TBL_NAME",
        ),
        "SDS": customer.selectExpr("c_custkey + 1 AS SD_ID", "c_custkey * 2 AS CD_ID"),
        "COLUMNS_V2": table(spark, sf_dir, "orders").selectExpr(
            "CASE WHEN o_custkey % 6 = 1 THEN o_custkey * 2 + 1 ELSE o_custkey * 2 END AS CD_ID",
            "o_orderpriority AS COLUMN_NAME",
        ),
        "PARTITIONS": table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey * 8 + l_linenumber AS PART_ID",
            "CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS TBL_ID",
            "CASE WHEN l_linestatus = 'O' THEN 'building' ELSE 'shipped' END || '=' "
            "|| l_linenumber || '/hr=1' AS PART_NAME",
        ),
        "PARTITION_KEYS": customer.selectExpr(
            "CASE WHEN c_custkey % 4 = 3 THEN c_custkey - 1 ELSE c_custkey END AS TBL_ID",
            "CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE lower(c_mktsegment) END AS PKEY_NAME",
        ),
    }


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy per part, with URL resources and two items."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "'pol_' || p_partkey AS name",
        SERVICE,
        """CASE WHEN p_partkey % 5 <> 0 THEN map('url', named_struct('values',
             CASE WHEN p_partkey % 7 = 0 THEN array('/datafiles/' || p_type)
                  ELSE array('/schemas/' || p_type || '.db', '/datafiles/' || p_type,
                             '/x/' || p_brand || '.db') END))
           ELSE map('path', named_struct('values', array('/schemas/' || p_brand)))
           END AS resources""",
        """array(
             named_struct('accesses', array(named_struct('type', 'read', 'isAllowed', true)),
                          'users', array('admin'), 'groups', array(p_type, 'all'),
                          'roles', array(p_brand, p_type), 'delegateAdmin', false),
             named_struct('accesses',
                          CAST(array() AS ARRAY<STRUCT<type: STRING, isAllowed: BOOLEAN>>),
                          'users', CAST(array() AS ARRAY<STRING>), 'groups', array(p_brand),
                          'roles', CAST(NULL AS ARRAY<STRING>), 'delegateAdmin', true)
           ) AS policyItems""",
        "p_partkey AS ord",
    )


def policy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy per part as JSON text, with fields at three depths that no operator knows."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        SERVICE,
        """CASE WHEN p_partkey % 5 = 0 THEN '{"path": {"values": ["/schemas/' || p_brand || '"], "n": 1}}'
           WHEN p_partkey % 7 = 0 THEN '{"url": {"values": ["/datafiles/' || p_type || '"], "n": null}}'
           ELSE '{"url": {"n": {"er": [' || p_partkey || ']}, "values": ["/schemas/' || p_type
             || '.db", "/datafiles/' || p_type || '", "/x/' || p_brand || '.db"]}}'
           END AS resources""",
        "p_type", "p_brand", "p_size",
    ).selectExpr(
        """concat('{"service": "', service, '", "name": "pol_', id, '", "id": ', id,
             ', "labels": {"team": {"of": "', p_brand, '"}, "rank": [', p_size, ', null]}',
             ', "resources": ', resources, ', "policyItems": [{"users": ["admin"], "groups": ["',
             p_type, '", "all"], "roles": ["', p_brand, '"], "extra": {"b": [{"c": 1.5}]}',
             ', "accesses": [{"type": "read", "why": {"by": "', p_type, '"}}]}]}') AS value"""
    )


def role_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role per order as a whole document, with users that have fields of their own."""
    text = F.expr(
        """concat('{"name": "role_', o_orderkey, '", "users": [{"since": {"y": [', o_custkey,
             ']}, "name": "u", "isAdmin": true}], "options": {"a": {"b": {"c": null}}}, "id": ',
             o_orderkey, '}')"""
    )
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.parse_json(text).alias("doc"), F.col("o_orderkey").alias("ord"))


def existing_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the server holds: some names of ours, some without an id, each in two versions."""
    part = table(spark, sf_dir, "part")
    base = part.selectExpr(
        "CASE WHEN p_partkey % 22 <> 0 THEN p_partkey + 100000 END AS id",
        "CASE WHEN p_partkey % 2 = 0 THEN 'pol_' ELSE 'old_' END || p_partkey AS name",
        SERVICE,
        "p_partkey AS ord",
    )
    later = base.withColumns(
        {"id": F.col("id") + 1, "ord": F.col("ord") + 1_000_000_000}
    )
    return base.unionByName(later)


def incoming_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies to upload; three parts share the name of one that the server does not hold."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ord",
        "'pol_' || CASE WHEN p_partkey % 8 IN (1, 2) THEN p_partkey - p_partkey % 8 + 1 "
        "ELSE p_partkey END AS name",
        SERVICE,
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grant per line item: many repeats per policy and group, some on no policy at all."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "named_struct('o', l_orderkey, 'n', l_linenumber, 'p', l_partkey, 's', l_suppkey) "
        "AS row_no",
        "'pol_' || CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 1000000 ELSE l_partkey END "
        "AS policy_name",
        "CASE WHEN l_suppkey % 3 = 0 THEN 'all' ELSE 'grp' || (l_suppkey % 4) END AS group_name",
        "CASE l_linenumber % 4 WHEN 0 THEN 'rw' WHEN 1 THEN 'x' WHEN 2 THEN 'rr' ELSE 'q-w' END "
        "AS permissions",
    )


def import_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS index",
        "'role_' || o_orderkey AS name",
        "CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 400 END AS status",
    )


def config_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 2 = 0 THEN 'service' ELSE 'role_group' END AS scope",
        "'cluster' || (p_size % 3) AS cluster",
        "'svc' || (p_partkey % 10) AS service",
        "CASE WHEN p_partkey % 2 = 1 THEN 'rg_' || p_brand END AS role_group",
        """CASE p_partkey % 6 WHEN 0 THEN 'ssl_server_keystore_password'
             WHEN 1 THEN 'impala.ssl_private_key_password'
             WHEN 2 THEN 'Ranger.SSL.KeyStore.Password'
             WHEN 3 THEN 'truststore_password'
             WHEN 4 THEN 'keystore_path' ELSE 'db_password' END AS key""",
        "p_name AS value",
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        """CASE s_suppkey % 6 WHEN 0 THEN 'HIVE-' || s_suppkey WHEN 1 THEN 'hive_2'
             WHEN 2 THEN 'Hue' WHEN 3 THEN 'yarn' WHEN 4 THEN 'oozie-12'
             ELSE 'ranger' END AS service""",
        "s_suppkey AS ord",
    )


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat layout: a date folder per order date, some folders that are no dates."""
    return table(spark, sf_dir, "orders").selectExpr(
        "'wal_backups/' || CASE WHEN o_orderkey % 50 = 0 THEN 'misc' "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END || '/' || o_orderkey || '.wal' AS key"
    )


def clustered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered layout, with files that lie straight in the node folder and bear a date."""
    return table(spark, sf_dir, "orders").selectExpr(
        "'c' || (o_custkey % 3) || '/wal_backups/psqld' || (o_orderkey % 3 + 1) || '/' || "
        "date_format(o_orderdate, 'yyyy-MM-dd') || "
        "CASE WHEN o_orderkey % 40 = 0 THEN '' ELSE '/' || o_orderkey || '.wal' END AS key"
    )


def backup_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds of backups, one object per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        """'c1/' || CASE o_orderstatus
             WHEN 'F' THEN 'file_systembackups/psqld1/' || date_format(o_orderdate, 'yyyy-MM-dd')
                           || '.tar.gz'
             WHEN 'O' THEN 'sql_backups/psqld1/' || CASE WHEN o_orderkey % 2 = 0
                    THEN 'db' || o_orderkey || '_' || date_format(o_orderdate, 'yyyyMMdd') || '.sql'
                    ELSE date_format(o_orderdate, 'yyyy-MM-dd') || '/db' || o_orderkey || '.sql' END
             ELSE 'wal_backups/psqld1/' || date_format(o_orderdate, 'yyyy-MM-dd') || '/'
                  || o_orderkey || '.wal' END AS key"""
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'UTATB' WHEN 'HOUSEHOLD' THEN 'DTAVB' "
        "WHEN 'MACHINERY' THEN 'AVBATB' ELSE 'LAB' END || c_nationkey AS cluster",
    )
