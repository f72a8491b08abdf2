"""Schemas of the inputs and of the fixed-layout outputs."""

#: The column in which a scan keeps a whole document beside its typed fields.
DOCUMENT = "doc"

ACCESS = "STRUCT<type: STRING, isAllowed: BOOLEAN>"
POLICY_ITEM = (
    f"STRUCT<accesses: ARRAY<{ACCESS}>, users: ARRAY<STRING>, groups: ARRAY<STRING>, "
    "roles: ARRAY<STRING>, delegateAdmin: BOOLEAN, "
    "conditions: ARRAY<STRUCT<type: STRING, values: ARRAY<STRING>>>>"
)
RESOURCES = "MAP<STRING, STRUCT<values: ARRAY<STRING>, isExcludes: BOOLEAN, isRecursive: BOOLEAN>>"
POLICY_DDL = (
    f"id BIGINT, name STRING, service STRING, resources {RESOURCES}, "
    f"policyItems ARRAY<{POLICY_ITEM}>"
)

ROLE_DDL = (
    "id BIGINT, name STRING, description STRING, "
    "users ARRAY<STRUCT<name: STRING, isAdmin: BOOLEAN>>, "
    "groups ARRAY<STRUCT<name: STRING, isAdmin: BOOLEAN>>, "
    "roles ARRAY<STRUCT<name: STRING, isAdmin: BOOLEAN>>"
)

QUERY_RECORD_DDL = (
    "queryId STRING, user STRING, queryState STRING, startTime TIMESTAMP_NTZ, "
    "attributes MAP<STRING, STRING>, coordinator STRUCT<hostname: STRING, hostId: STRING>"
)

GRANT_DDL = "policy_name STRING, group_name STRING, permissions STRING"

CONFIG_ITEMS = "STRUCT<items: ARRAY<STRUCT<name: STRING, value: STRING>>>"
ROLE_GROUPS = f"ARRAY<STRUCT<name: STRING, config: {CONFIG_ITEMS}>>"
CONFIG_TREE_DDL = (
    f"clusters ARRAY<STRUCT<name: STRING, services: ARRAY<STRUCT<name: STRING, "
    f"config: {CONFIG_ITEMS}, roleConfigGroups: {ROLE_GROUPS}>>>>, "
    f"manager STRUCT<config: {CONFIG_ITEMS}>, "
    f"management STRUCT<config: {CONFIG_ITEMS}, roleConfigGroups: {ROLE_GROUPS}>"
)

SERVICES_DDL = "items ARRAY<STRUCT<name: STRING, type: STRING>>"

# Column order of the compile-record CSV (fixed values).
COMPILE_RECORD_COLUMNS = [
    "query_id",
    "user",
    "compile_time_ms",
    "union_count",
    "slow_compile",
    "excessive_unions",
    "start_ts",
    "end_ts",
    "source_log",
    "query",
]
