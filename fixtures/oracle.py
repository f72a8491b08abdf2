"""The same results in DuckDB SQL, straight from the base columns.

Nothing here reads the texts, maps or nested documents that the Spark side builds and parses.
"""

from __future__ import annotations

LOG = """
fx AS (
  SELECT event_id AS pos, 'q' || CAST(user_id AS VARCHAR) AS query_id,
    CASE WHEN event_type IN ('error', 'signup') THEN 'END' ELSE 'START' END AS kind,
    'svc_' || CAST(event_id % 11 AS VARCHAR) AS usr,
    'SELECT 1' || repeat(' union  ALL SELECT 1', CAST(event_id % 6 AS INT)) AS query,
    CAST(event_id % 6 AS INT) AS unions,
    CAST(round(value * 100) AS BIGINT) AS compile_ms,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE date_trunc('millisecond', ts) END AS ts,
    'server-' || strftime(ts, '%Y-%m-%d') || '.log' AS source_log
  FROM events),
lk AS (
  SELECT *, lag(kind) OVER o AS pk, lag(usr) OVER o AS pusr, lag(query) OVER o AS pquery,
    lag(unions) OVER o AS punions, lag(ts) OVER o AS pts, lead(kind) OVER o AS nk
  FROM fx WINDOW o AS (PARTITION BY query_id ORDER BY pos)),
pr AS (
  SELECT query_id, pusr AS "user", compile_ms AS compile_time_ms, punions AS union_count,
    pts AS start_ts, ts AS end_ts, source_log, pquery AS query,
    compile_ms > 10000 AS slow_compile, punions > 3 AS excessive_unions
  FROM lk WHERE kind = 'END' AND pk = 'START')
"""
MS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%g') AS {0}"

USER_STATS = f"""
WITH {LOG}
SELECT "user", count(*) AS total_queries, count(*) FILTER (slow_compile) AS slow_queries,
  count(*) FILTER (excessive_unions) AS excessive_union_queries,
  CAST(sum(compile_time_ms) AS BIGINT) AS total_compile_ms,
  max(compile_time_ms) AS max_compile_ms,
  CAST(sum(compile_time_ms) AS DOUBLE) / count(*) AS avg_compile_ms
FROM pr GROUP BY 1
"""
HOUR_STATS = f"""
WITH {LOG}
SELECT strftime(coalesce(start_ts, end_ts), '%Y-%m-%d %H') AS hour, count(*) AS total_queries,
  count(*) FILTER (slow_compile) AS slow_queries,
  CAST(sum(compile_time_ms) AS BIGINT) AS sum_compile_ms,
  CAST(sum(compile_time_ms) AS DOUBLE) / count(*) AS avg_compile_ms
FROM pr WHERE coalesce(start_ts, end_ts) IS NOT NULL GROUP BY 1
"""
QUALITY = f"""
WITH {LOG}
SELECT CAST(0 AS BIGINT) AS parse_errors,
  count(*) FILTER (kind = 'END' AND pk IS DISTINCT FROM 'START') AS orphan_ends,
  count(*) FILTER (kind = 'START' AND nk IS DISTINCT FROM 'END') AS unfinished_starts,
  count(*) FILTER (kind = 'END' AND pk = 'START') AS pairs
FROM lk
"""

FLAT = """
fl AS (
  SELECT 'q' || CAST(event_id AS VARCHAR) AS query_id,
    CASE WHEN user_id % 25 = 0 THEN 'unknown' ELSE 'u' || CAST(user_id AS VARCHAR) END AS "user",
    'FINISHED' AS state, ts AS query_time,
    CAST(round(value * 100) AS DOUBLE) AS duration_ms,
    CAST(round(value * 100) AS DOUBLE) / 1000 AS duration_s,
    CAST(0 AS DOUBLE) AS memory_per_node_peak,
    event_type IN ('error', 'signup') AS spilled, event_id % 3 = 0 AS stats_missing,
    CASE WHEN event_id % 2 = 0 THEN CAST(0 AS DOUBLE)
      ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 60 END AS admission_wait_ms,
    event_id AS rows_inserted,
    CAST(0 AS DOUBLE) AS planning_wait_s, CAST(0 AS DOUBLE) AS network_receive_wait_s,
    CASE WHEN user_id % 5 <> 0 THEN 'node' || CAST(user_id % 8 AS VARCHAR)
         WHEN user_id % 10 = 0 THEN 'id' || CAST(user_id AS VARCHAR)
         ELSE 'Unknown' END AS coordinator,
    CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN 'root.' || event_type
         WHEN event_id % 2 = 0 THEN 'etl' ELSE 'default' END AS pool
  FROM events),
flat AS (
  SELECT *, admission_wait_ms / 1000 AS admission_wait_s, admission_wait_ms > 1000 AS queued
  FROM fl)
"""
DAY = "query_time BETWEEN TIMESTAMP '2024-01-30 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"
TEN_DAYS = "query_time BETWEEN TIMESTAMP '2024-01-21 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"


def _bottlenecks(where: str = "true") -> str:
    return f"""
WITH {FLAT}, t AS (
  SELECT count(*) AS n, count(*) FILTER (spilled) AS a, count(*) FILTER (stats_missing) AS b,
    count(*) FILTER (queued) AS c FROM flat WHERE {where})
SELECT 'Spilling to Disk' AS issue, a AS count, a * CAST(100 AS DOUBLE) / n AS pct,
  'Increase Mem / Fix Joins' AS action FROM t
UNION ALL SELECT 'Missing Table Stats', b, b * CAST(100 AS DOUBLE) / n, 'Run COMPUTE STATS' FROM t
UNION ALL SELECT 'Admission Queueing', c, c * CAST(100 AS DOUBLE) / n, 'Check Resource Pools' FROM t
"""


def _users(where: str = "true", limit: str = "LIMIT 5") -> str:
    return f"""
WITH {FLAT}
SELECT "user", sum(duration_ms) / 1000 AS total_duration_s, count(*) AS query_count,
  count(*) FILTER (spilled) AS spill_count
FROM flat WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 {limit}
"""


def _coordinators(where: str = "true") -> str:
    return f"""
WITH {FLAT}
SELECT coordinator, count(*) AS total, count(*) FILTER (queued) AS queued,
  count(*) FILTER (queued) * CAST(100 AS DOUBLE) / count(*) AS pct_queued,
  sum(admission_wait_ms) / count(*) AS avg_wait_ms
FROM flat WHERE {where} GROUP BY 1
"""


def _pools(where: str = "true") -> str:
    return f"""
WITH {FLAT}
SELECT pool, count(*) AS total, count(*) FILTER (queued) AS queued,
  count(*) FILTER (queued) * CAST(100 AS DOUBLE) / count(*) AS pct_queued
FROM flat WHERE {where} GROUP BY 1
"""


# Straight from the tables: a customer is a table of its nation, the orders of five customers in
# six are its columns, line items are partitions of the table with their supplier's number.
META = """
columns_of AS (
  SELECT o_custkey AS tbl, count(*) AS n FROM orders WHERE o_custkey % 6 <> 1 GROUP BY o_custkey),
piece AS (
  SELECT l_suppkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS tbl,
    if(l_linestatus = 'O', 'building', 'shipped') AS first_key FROM lineitem),
pieces_of AS (SELECT tbl, count(*) AS n FROM piece GROUP BY tbl),
inventory AS (
  SELECT (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS DB_NAME,
    c_name AS TBL_NAME, (SELECT n FROM columns_of WHERE tbl = c_custkey) AS colCount,
    coalesce((SELECT n FROM pieces_of WHERE tbl = c_custkey), 0) AS partCount, c_custkey
  FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation))
"""
INVENTORY = f"WITH {META} SELECT DB_NAME, TBL_NAME, colCount, partCount FROM inventory"

POL = """
pol AS (
  SELECT p_partkey AS id, 'pol_' || CAST(p_partkey AS VARCHAR) AS name, p_type, p_brand,
    CASE p_size % 3 WHEN 0 THEN 'cm_hive' WHEN 1 THEN 'cm_hdfs' ELSE 'cm_kafka' END AS service,
    CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 7 = 0 THEN 'new' ELSE 'old' END AS u
  FROM part),
urls AS (
  SELECT *,
    CASE u WHEN 'new' THEN '/datafiles/' || p_type WHEN 'old' THEN '/schemas/' || p_type
      || '.db|/datafiles/' || p_type || '|/x/' || p_brand || '.db' END AS original,
    CASE u WHEN 'new' THEN '/datafiles/' || p_type WHEN 'old' THEN '/datafiles/' || p_type
      || '|/datafiles/' || p_type || '|/x/' || p_brand END AS moved,
    CASE u WHEN 'new' THEN '/datafiles/' || p_type
      WHEN 'old' THEN '/datafiles/' || p_type || '|/x/' || p_brand || '.db' END AS matched
  FROM pol)
"""
URLS_ALL = f"""
WITH {POL} SELECT id, name, service,
  CASE WHEN service = 'cm_hive' THEN moved ELSE original END AS urls FROM urls
"""

GRANTS = """
gr AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    'pol_' || CAST(CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 1000000 ELSE l_partkey END
      AS VARCHAR) AS policy_name,
    CASE WHEN l_suppkey % 3 = 0 THEN 'all' ELSE 'grp' || CAST(l_suppkey % 4 AS VARCHAR) END
      AS group_name,
    CASE l_linenumber % 4 WHEN 0 THEN 'rw' WHEN 1 THEN 'x' WHEN 2 THEN 'rr' ELSE 'q-w' END
      AS permissions,
    CASE l_linenumber % 4 WHEN 0 THEN 'read|write' WHEN 1 THEN 'execute' WHEN 2 THEN 'read|read'
      ELSE 'write' END AS parsed
  FROM lineitem)
"""

# One row per policy, group and permission with its first place; then as the items come out.
MERGE = f"""
WITH {POL}, {GRANTS},
wanted AS (
  SELECT policy_name AS name, group_name, p AS permission,
    min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE p WHEN 'write' THEN 1 ELSE 0 END))
      AS place
  FROM (SELECT *, unnest(string_split(parsed, '|')) AS p FROM gr)
  WHERE policy_name IN (SELECT name FROM pol WHERE service = 'cm_hdfs') GROUP BY 1, 2, 3),
gain AS (
  SELECT name, string_agg(permission, '|' ORDER BY place) AS gained FROM wanted
  WHERE group_name = 'all' AND permission <> 'read' GROUP BY 1),
fresh AS (
  SELECT name, group_name, string_agg(permission, '|' ORDER BY place) AS accesses,
    min(place) AS place
  FROM wanted WHERE group_name <> 'all' GROUP BY 1, 2)
SELECT name, 0 AS item, p_type || '|all' AS "groups",
  'read' || coalesce('|' || gained, '') AS accesses, false AS delegate_admin
FROM pol LEFT JOIN gain USING (name)
UNION ALL SELECT name, 1, p_brand, '', true FROM pol
UNION ALL SELECT name,
  CAST(1 + row_number() OVER (PARTITION BY name ORDER BY place) AS INT), group_name, accesses,
  false FROM fresh
"""

UPSERT = """
inc AS (
  SELECT p_partkey AS ord, 'pol_' || CAST(CASE WHEN p_partkey % 8 IN (1, 2)
      THEN p_partkey - p_partkey % 8 + 1 ELSE p_partkey END AS VARCHAR) AS name,
    CASE p_size % 3 WHEN 0 THEN 'cm_hive' WHEN 1 THEN 'cm_hdfs' ELSE 'cm_kafka' END AS service
  FROM part),
held AS (
  SELECT 'pol_' || CAST(p_partkey AS VARCHAR) AS name,
    CASE p_size % 3 WHEN 0 THEN 'cm_hive' WHEN 1 THEN 'cm_hdfs' ELSE 'cm_kafka' END AS service,
    CASE WHEN p_partkey % 22 <> 0 THEN p_partkey + 100000 END AS id
  FROM part WHERE p_partkey % 2 = 0),
joined AS (
  SELECT i.*, h.name IS NOT NULL AS found, h.id AS found_id,
    row_number() OVER (PARTITION BY i.service, i.name ORDER BY i.ord) AS nth
  FROM inc i LEFT JOIN held h ON i.name = h.name AND i.service = h.service),
plan AS (
  SELECT ord, name, service, CASE WHEN NOT found AND nth = 1 THEN 'create' {0} ELSE 'fail' END
    AS action, CAST({1} AS BIGINT) AS target_id FROM joined)
"""
NO_OVERRIDE = UPSERT.format("", "NULL")
OVERRIDE = UPSERT.format("WHEN NOT found OR found_id IS NOT NULL THEN 'update'", "found_id")

FAILURES = """
SELECT o_orderkey AS index, 'role_' || CAST(o_orderkey AS VARCHAR) AS name,
  CASE o_orderstatus WHEN 'O' THEN 400 END AS status, false AS success
FROM orders WHERE o_orderstatus <> 'F'
"""

CONFIG = """
cfg AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'service' ELSE 'role_group' END AS scope,
    'cluster' || CAST(p_size % 3 AS VARCHAR) AS cluster,
    'svc' || CAST(p_partkey % 10 AS VARCHAR) AS service,
    CASE WHEN p_partkey % 2 = 1 THEN 'rg_' || p_brand END AS role_group,
    CASE p_partkey % 6 WHEN 0 THEN 'ssl_server_keystore_password'
      WHEN 1 THEN 'impala.ssl_private_key_password' WHEN 2 THEN 'Ranger.SSL.KeyStore.Password'
      WHEN 3 THEN 'truststore_password' WHEN 4 THEN 'keystore_path' ELSE 'db_password' END AS key,
    p_name AS value, p_partkey % 6 IN (0, 1, 2) AS wide, p_partkey % 6 IN (0, 2) AS narrow
  FROM part)
"""
SERVICES = """
svc AS (
  SELECT s_suppkey AS ord,
    CASE s_suppkey % 6 WHEN 0 THEN 'HIVE-' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'hive_2'
      WHEN 2 THEN 'Hue' WHEN 3 THEN 'yarn' WHEN 4 THEN 'oozie-12' ELSE 'ranger' END AS service,
    CASE WHEN s_suppkey % 6 IN (0, 1) THEN 'hive' WHEN s_suppkey % 6 = 2 THEN 'hue'
      WHEN s_suppkey % 6 = 3 THEN 'yarn' WHEN s_suppkey % 6 = 4 THEN 'oozie' ELSE 'ranger' END
      AS service_key
  FROM supplier)
"""

FLAT_KEYS = """
obj AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END
      AS folder,
    'wal_backups/' || CASE WHEN o_orderkey % 50 = 0 THEN 'misc'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END || '/' || CAST(o_orderkey AS VARCHAR) || '.wal'
      AS key, CAST(o_orderdate AS DATE) AS day
  FROM orders),
doomed AS (
  SELECT * FROM obj WHERE folder IS NOT NULL
    AND CAST(day AS TIMESTAMP) < TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 15 DAY)
"""

DAY_SQL = "CAST(o_orderdate AS DATE) = DATE '1998-10-03'"


BACKUP_WAL = f"""
SELECT 'c1/wal_backups/psqld1/1998-10-03/' || CAST(o_orderkey AS VARCHAR) || '.wal' AS key,
  'wal_backups/' || CAST(o_orderkey AS VARCHAR) || '.wal' AS target
FROM orders WHERE o_orderstatus = 'P' AND {DAY_SQL}"""


def all_sql() -> dict[str, str]:
    start_end = f"{MS.format('start_ts')}, {MS.format('end_ts')}"
    pairs = f"""
WITH {LOG} SELECT query_id, "user", compile_time_ms, union_count, {start_end}, source_log, query
FROM pr"""
    return {
        "classify_log_lines": f"""
WITH {LOG} SELECT pos AS line_no, kind, query_id, source_log,
  CASE WHEN kind = 'START' THEN usr END AS "user", CASE WHEN kind = 'START' THEN query END AS query,
  CASE WHEN kind = 'END' THEN compile_ms END AS compile_ms,
  CASE WHEN kind = 'START' THEN unions END AS union_count, {MS.format('ts')} FROM fx""",
        "pair_compile_events": pairs,
        "with_compile_flags": f"""
WITH {LOG} SELECT query_id, compile_time_ms, union_count, slow_compile, excessive_unions FROM pr""",
        "unfinished_queries": f"""
WITH {LOG} SELECT query_id, usr AS "user", strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS start_ts,
  source_log, query, CASE WHEN nk IS NULL THEN 'unfinished' ELSE 'replaced' END AS status
FROM lk WHERE kind = 'START' AND nk IS DISTINCT FROM 'END'""",
        "compile_stats_by_user": USER_STATS,
        "compile_stats_by_hour": HOUR_STATS,
        "log_parse_quality": QUALITY,
        "write_csv": f"""
WITH {LOG}, t AS (SELECT *, strftime(start_ts, '%Y-%m-%dT%H:%M:%S.%f') AS s,
  strftime(end_ts, '%Y-%m-%dT%H:%M:%S.%f') AS e FROM pr)
SELECT query_id, "user", CAST(compile_time_ms AS VARCHAR) AS compile_time_ms,
  CAST(union_count AS VARCHAR) AS union_count,
  CASE WHEN slow_compile THEN 'True' ELSE 'False' END AS slow_compile,
  CASE WHEN excessive_unions THEN 'True' ELSE 'False' END AS excessive_unions,
  regexp_replace(s, '[.]000000$', '') AS start_ts, regexp_replace(e, '[.]000000$', '') AS end_ts,
  query FROM t""",
        "compile_log_report_per_user": USER_STATS,
        "compile_log_report_per_hour": HOUR_STATS,
        "compile_log_report_quality": QUALITY,
        "write_summary_json_per_user": USER_STATS,
        "write_summary_json_per_hour": HOUR_STATS,
        "scan_log_lines": """
SELECT CAST(event_id AS VARCHAR) || '|' || event_type AS line, event_id % 2 = 1 AS first_argument
FROM events""",
        "count_union_all": """
SELECT doc_id, CAST((length(text) - length(replace(text, '. ', ''))) / 2 AS BIGINT) AS n_unions
FROM documents""",
        "truncate_query": """
SELECT doc_id, CASE WHEN length(text) > 20000 THEN substr(text, 1, 20000) || ' --[TRUNCATED]'
  ELSE text END AS query FROM documents""",
        "strip_ws": """
SELECT doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160))
  AS stripped FROM documents""",
        "flatten_query_records": f"""
WITH {FLAT} SELECT * EXCLUDE (query_time), {MS.format('query_time')} FROM flat""",
        "scan_query_records": _users(limit=""),
        "filter_lookback": f"""
WITH {FLAT} SELECT query_id AS "queryId",
  strftime(query_time, '%Y-%m-%d %H:%M:%S.%g') AS "startTime" FROM flat WHERE {DAY}""",
        "filter_min_duration": f"""
WITH {FLAT} SELECT query_id, duration_s FROM flat WHERE duration_ms > 5000""",
        "filter_queue_or_slow": f"""
WITH {FLAT} SELECT query_id, duration_s FROM flat
WHERE admission_wait_ms > 100 OR duration_ms > 1000""",
        "label_queries": f"""
WITH {FLAT} SELECT query_id, CASE WHEN spilled THEN 'YES' ELSE 'No' END AS spilled_label,
  CASE WHEN stats_missing THEN 'MISSING' ELSE 'Ok' END AS stats_label FROM flat""",
        "bottleneck_overview": _bottlenecks(),
        "top_slow_queries": f"""
WITH {FLAT} SELECT "user", duration_s, CASE WHEN spilled THEN 'YES' ELSE 'No' END AS spilled,
  CASE WHEN stats_missing THEN 'MISSING' ELSE 'Ok' END AS stats, query_id
FROM flat ORDER BY duration_s DESC, query_id LIMIT 5""",
        "workload_by_user": _users(),
        "queue_congestion": f"""
WITH {FLAT} SELECT max(admission_wait_s) AS max_wait_s, max(admission_wait_s) > 5 AS alert
FROM flat""",
        "queue_by_coordinator": _coordinators(),
        "queue_by_pool": _pools(),
        "workload_total": "SELECT count(*) AS total FROM events",
        "cap_records": f"WITH {FLAT} SELECT query_id FROM flat ORDER BY query_id LIMIT 5000",
        "workload_report_bottlenecks": _bottlenecks(f"{DAY} AND duration_ms > 5000"),
        "workload_report_total": f"""
WITH {FLAT} SELECT count(*) AS total FROM flat WHERE {DAY} AND duration_ms > 5000""",
        "workload_report_slowest": f"""
WITH {FLAT} SELECT "user", duration_s, if(spilled, 'YES', 'No') AS spilled,
  if(stats_missing, 'MISSING', 'Ok') AS stats, query_id
FROM flat WHERE {DAY} AND duration_ms > 5000 ORDER BY duration_s DESC, query_id LIMIT 5""",
        "workload_report_congestion": f"""
WITH {FLAT} SELECT max(admission_wait_s) AS max_wait_s, max(admission_wait_s) > 5 AS alert
FROM flat WHERE {DAY} AND duration_ms > 5000""",
        "workload_report_users": _users(f"{DAY} AND duration_ms > 5000"),
        "queue_report_coordinators": _coordinators(
            f"{TEN_DAYS} AND (admission_wait_ms > 100 OR duration_ms > 1000)"
        ),
        "queue_report_pools": _pools(
            f"{TEN_DAYS} AND (admission_wait_ms > 100 OR duration_ms > 1000)"
        ),
        "column_counts": f"""
WITH {META} SELECT c_custkey AS TBL_ID, colCount FROM inventory WHERE colCount > 0""",
        "partition_counts": f"""
WITH {META} SELECT c_custkey AS TBL_ID, partCount FROM inventory""",
        "table_inventory": INVENTORY,
        "inventory_report": INVENTORY,
        "scan_metastore": INVENTORY,
        "table_inventory_of_databases": f"{INVENTORY} WHERE DB_NAME IN ('NATION_1', 'NATION_7')",
        "partition_key_mismatch": f"""
WITH {META}, declared AS (
  SELECT c_custkey - CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS tbl,
    lower(c_mktsegment) AS key FROM customer WHERE c_custkey % 7 <> 2)
SELECT piece.tbl AS TBL_ID, (SELECT DB_NAME FROM inventory WHERE c_custkey = piece.tbl) AS DB_NAME,
  (SELECT c_name FROM customer WHERE c_custkey = piece.tbl) AS TBL_NAME, first_key AS part_key,
  key AS PKEY_NAME
FROM piece, declared
WHERE piece.tbl = declared.tbl AND key <> first_key
  AND EXISTS (FROM customer WHERE c_custkey = piece.tbl)""",
        "rewrite_policy_urls_all": URLS_ALL,
        "rewrite_policy_urls_matched": f"""
WITH {POL} SELECT id, name, service,
  CASE WHEN service = 'cm_hive' THEN matched ELSE original END AS urls FROM urls""",
        "policy_change_log": f"""
WITH {POL} SELECT name AS "policyName", original, matched AS updated FROM urls
WHERE service = 'cm_hive' AND u = 'old'""",
        "policy_change_count": f"""
WITH {POL} SELECT count(*) AS changed FROM urls WHERE service = 'cm_hive' AND u = 'old'""",
        "roles_to_groups": """
SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_type, 'all', p_brand])), '|')
  AS "groups", 0 AS n_roles FROM part""",
        "roles_to_groups_items": """
SELECT p_partkey AS id, 0 AS item,
  array_to_string(list_sort(list_distinct([p_type, 'all', p_brand])), '|') AS "groups",
  0 AS n_roles FROM part
UNION ALL SELECT p_partkey, 1, p_brand, 0 FROM part""",
        "merge_grants": MERGE,
        "unmatched_grants": f"""
WITH {POL}, {GRANTS} SELECT policy_name, group_name, permissions, l_orderkey FROM gr
WHERE policy_name NOT IN (SELECT name FROM pol WHERE service = 'cm_hdfs')""",
        "plan_policy_upsert": f"WITH {NO_OVERRIDE} SELECT * FROM plan",
        "plan_policy_upsert_override": f"WITH {OVERRIDE} SELECT * FROM plan",
        "policy_upsert_report": f"""
WITH {OVERRIDE}, placed AS (
  SELECT *, (row_number() OVER (ORDER BY ord) - 1) // 100 AS chunk_id FROM plan)
SELECT chunk_id, count(*) FILTER (action <> 'fail') AS succeeded,
  count(*) FILTER (action = 'fail') AS failed FROM placed GROUP BY 1""",
        "import_outcome_summary": """
SELECT count(*) FILTER (o_orderstatus = 'F') AS succeeded,
  count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders""",
        "import_failures": f"{FAILURES} ORDER BY o_orderkey LIMIT 10",
        "import_failures_all": FAILURES,
        "parse_permissions": f"WITH {GRANTS} SELECT l_orderkey, permissions, parsed FROM gr",
        "page_completeness": """
SELECT CAST(20000 AS BIGINT) AS declared, count(*) AS fetched,
  CAST(100 AS BIGINT) AS expected_pages, count(*) = 20000 AS complete FROM orders""",
        "migrate_policies": f"""
WITH {POL} SELECT id, CASE WHEN service = 'cm_hive' THEN matched ELSE original END AS urls, item,
  CASE item WHEN 0 THEN array_to_string(list_sort(list_distinct([p_type, 'all', p_brand])), '|')
    ELSE p_brand END AS "groups", 0 AS n_roles
FROM urls, (VALUES (0), (1)) AS items(item)""",
        "migrate_policies_documents": f"""
WITH {POL} SELECT id, CASE WHEN id % 3 > 0 THEN 'denyPolicyItems|' ELSE '' END
    || 'description|id|isEnabled|name|policyItems|resources|service' AS fields,
  CAST(id % 2 = 0 AS VARCHAR) AS enabled, 'say "' || name || '", {{ok}}' AS description,
  CASE WHEN id % 3 > 0 THEN '[{{"delegateAdmin":true,"users":["' || name || '"]}}]' END AS denied,
  'true' AS delegate FROM pol""",
        "whole_policy_documents": f"""
WITH {POL} SELECT name, md5('{{"id":' || id || ',"labels":{{"rank":[' || size
  || ',null],"team":{{"of":"' || p_brand || '"}}}},"name":"' || name
  || '","policyItems":[{{"accesses":[{{"type":"read","why":{{"by":"' || p_type
  || '"}}}}],"extra":{{"b":[{{"c":1.5}}]}},"groups":["'
  || array_to_string(list_sort(list_distinct([p_type, 'all', p_brand])), '","')
  || '"],"roles":[],"users":["admin"]}}],"resources":' || CASE u
    WHEN 'none' THEN '{{"path":{{"n":1,"values":["/schemas/' || p_brand || '"]}}}}'
    ELSE '{{"url":{{"n":' || CASE u WHEN 'new' THEN 'null' ELSE '{{"er":[' || id || ']}}' END
      || ',"values":["' || replace(CASE WHEN service = 'cm_hive' THEN matched ELSE original END,
        '|', '","') || '"]}}}}' END
  || ',"service":"' || service || '"}}') AS hash
FROM urls JOIN (SELECT p_partkey AS id, p_size AS size FROM part) USING (id)""",
        "whole_role_pages": """
SELECT 'role_' || CAST(o_orderkey AS VARCHAR) AS name, md5('{"name":"role_' || o_orderkey
  || '","options":{"a":{"b":{"c":null}}},"users":[{"isAdmin":true,"name":"u","since":{"y":['
  || o_custkey || ']}}]}') AS hash
FROM orders""",
        "scan_policy_list": URLS_ALL,
        "scan_policy_map": f"WITH {POL} SELECT id, name, service FROM pol",
        "map_documents": f"WITH {POL} SELECT id, name, service FROM pol",
        "scan_parquet": "SELECT * FROM customer",
        "scan_document_pages": """
SELECT o_orderkey AS id, 'role_' || CAST(o_orderkey AS VARCHAR) AS name FROM orders""",
        "scan_grants_csv": MERGE,
        "scan_config_tree": f"""
WITH {CONFIG} SELECT scope, cluster, service, role_group, key, value FROM cfg""",
        "scan_config_tree_scopes": f"""
WITH {CONFIG}, scopes(scope, in_cluster, role_group) AS (VALUES ('service', true, NULL),
  ('role_group', true, 'rg'), ('manager', false, NULL), ('management_service', false, NULL),
  ('management_role_group', false, 'mrg')), own(is_own) AS (VALUES (true), (false))
SELECT s.scope, CASE WHEN in_cluster THEN cluster END AS cluster,
  CASE WHEN in_cluster THEN service END AS service, s.role_group,
  CASE WHEN is_own THEN key ELSE 'path' END AS key, value
FROM cfg, scopes s, own WHERE is_own OR s.scope <> 'manager'""",
        "scan_services": f"""
WITH {SERVICES} SELECT service, CAST((row_number() OVER (PARTITION BY ord // 50 ORDER BY ord) - 1)
  AS INT) AS place FROM svc""",
        "scan_documents": """
SELECT 'pol_' || CAST(p_partkey AS VARCHAR) AS name,
  CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 200 AS INT) AS page_row FROM part""",
        "chunk_rows": """
SELECT o_orderkey AS index, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 400 END AS status,
  (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 AS chunk_id
FROM orders""",
        "with_index": """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS index,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'role_' || CAST(o_orderkey AS VARCHAR)
    ELSE 'unnamed-role-' || CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR) END AS name
FROM orders""",
        "first_per_key": """
SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey)
  AS o_orderstatus FROM orders GROUP BY 1""",
        "concat_pages": """
SELECT o_orderkey AS index, 'role_' || CAST(o_orderkey AS VARCHAR) AS name,
  CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 400 END AS status FROM orders
UNION ALL SELECT c_custkey, NULL, NULL FROM customer""",
        "scan_object_listing": """
SELECT 'in/o_orderstatus=' || o_orderstatus AS folder,
  CAST(sum(strlen(o_orderpriority) + 2) AS BIGINT) AS bytes FROM orders GROUP BY o_orderstatus""",
        "expired_folders": f"""
WITH {FLAT_KEYS} SELECT folder, strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g')
  AS folder_ts, count(*) AS n_objects FROM doomed GROUP BY 1, 2""",
        "expired_folders_clustered": """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS folder,
  strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g') AS folder_ts,
  count(*) FILTER (o_orderkey % 40 <> 0) AS n_objects
FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 3 = 2
  AND CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
    < TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 15 DAY
GROUP BY 1, 2""",
        "retention_plan": f"""
WITH {FLAT_KEYS} SELECT folder, key,
  (row_number() OVER (PARTITION BY folder ORDER BY key) - 1) // 5 AS chunk_id FROM doomed""",
        "parse_object_key": f"""
WITH {FLAT_KEYS} SELECT key, folder, folder AS folder_day, 3 AS n_parts FROM obj""",
        "select_backup_objects_filesystem": f"""
SELECT 'c1/file_systembackups/psqld1/1998-10-03.tar.gz' AS key,
  'file_systembackups/1998-10-03.tar.gz' AS target
FROM orders WHERE o_orderstatus = 'F' AND {DAY_SQL}""",
        "select_backup_objects_sql": f"""
SELECT 'c1/sql_backups/psqld1/db' || CAST(o_orderkey AS VARCHAR) || '_19981003.sql' AS key,
  'sql_backups/db' || CAST(o_orderkey AS VARCHAR) || '_19981003.sql' AS target
FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND {DAY_SQL}""",
        "select_backup_objects_sql_by_key": f"""
SELECT 'c1/sql_backups/psqld1/1998-10-03/db' || CAST(o_orderkey AS VARCHAR) || '.sql' AS key,
  'sql_backups/db' || CAST(o_orderkey AS VARCHAR) || '.sql' AS target
FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 1 AND {DAY_SQL}""",
        "select_backup_objects_wal": BACKUP_WAL,
        "select_backup_objects_today": BACKUP_WAL,
        "endpoint_for": """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'UTATB' WHEN 'HOUSEHOLD' THEN 'DTAVB'
    WHEN 'MACHINERY' THEN 'AVBATB' ELSE 'LAB' END || CAST(c_nationkey AS VARCHAR) AS cluster,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'virginia' WHEN 'HOUSEHOLD' THEN 'texas'
    WHEN 'MACHINERY' THEN 'virginia' END AS site
FROM customer""",
        "split_by_retention": """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'delete' ELSE 'keep' END
  AS part FROM events""",
        "retention_delete_counts": """
SELECT 'actions' AS source, count(*) AS deleted FROM events
WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
UNION ALL SELECT 'history', count(*) FROM events
WHERE epoch_ms(date_trunc('second', ts)) <= epoch_ms(TIMESTAMP '2024-01-15 00:00:00')""",
        "config_change_plan": f"""
WITH {CONFIG} SELECT DISTINCT scope, cluster, service, role_group, key, '***' AS new_value,
  'would_update' AS action FROM cfg WHERE wide""",
        "config_updates_by_scope": f"""
WITH {CONFIG} SELECT scope, cluster, service, role_group,
  string_agg(DISTINCT key, '|' ORDER BY key) AS keys, '***' AS new_values
FROM cfg WHERE wide GROUP BY 1, 2, 3, 4""",
        "is_password_key": f"WITH {CONFIG} SELECT key, wide, narrow FROM cfg",
        "normalize_service_name": f"WITH {SERVICES} SELECT ord, service_key FROM svc",
        "normalized_service_groups": f"""
WITH {SERVICES} SELECT *, row_number() OVER (PARTITION BY service_key ORDER BY ord) - 1 AS position
FROM svc""",
        "rotation_targets": f"""
WITH {SERVICES}, f AS (SELECT service_key, arg_min(service, ord) AS service FROM svc GROUP BY 1),
m(level, service_key, config_key, role_group) AS (VALUES
  ('service', 'hive', 'hive_metastore_database_password', NULL),
  ('service', 'hue', 'database_password', NULL),
  ('service', 'ranger', 'db_password', NULL),
  ('service', 'yarn', 'yarn_resourcemanager_store_password', NULL),
  ('role_group', 'oozie', 'oozie_database_password', 'oozie-OOZIE_SERVER-BASE'),
  ('role_group', 'ranger', 'ranger_ldap_bind_password', 'ranger-RANGER_ADMIN-BASE'),
  ('service', 'hue', 'ldap_bind_password', NULL))
SELECT level, service_key, service, role_group, config_key, '***' AS new_value
FROM f JOIN m USING (service_key)""",
        "reports_manager_target": """
SELECT 'role_group' AS level, 'reportsmanager-REPORTSMANAGER_SERVER-BASE' AS role_group,
  'headlamp_database_password' AS config_key, '***' AS new_value
FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0""",
        "max_string_lengths": """
SELECT * FROM (
  SELECT 'text' AS "column", CAST(max(length(text)) AS INT) AS max_len FROM documents
  UNION ALL SELECT 'lang', CAST(max(length(lang)) AS INT) FROM documents
  UNION ALL SELECT 'source', CAST(max(length(source)) AS INT) FROM documents)""",
        "dataset_profile": """
SELECT 'role' AS "column", CAST(max(length(role)) AS INT) AS max_len,
  CAST(4 AS BIGINT) AS total_columns, CAST(2 AS BIGINT) AS string_columns FROM conversations
UNION ALL SELECT 'text', CAST(max(length(text)) AS INT), 4, 2 FROM conversations""",
        "copy_table": """
SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders""",
        "sample_rows": """
SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate)
FROM lineitem WHERE substr(md5(concat_ws('/', '7', l_orderkey, l_linenumber)), 1, 8) < '028f5c28'""",
        "stream_compile_records": f"""
WITH {LOG} SELECT query_id, "user", compile_time_ms, union_count, slow_compile, excessive_unions,
  {start_end}, query FROM pr""",
        "stream_compile_stats_by_hour": HOUR_STATS,
        "stream_unfinished": f"""
WITH {LOG}, newest AS (SELECT max(ts) AS newest_ts FROM fx)
SELECT query_id, usr AS "user", strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS start_ts, query,
  'expired' AS status FROM lk, newest
WHERE kind = 'START' AND nk IS NULL AND ts < newest_ts - INTERVAL 6 HOUR""",
    }
