"""Access policies: rewriting, grant merging, upsert planning, import outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opsframe.functions import (
    array_union_sorted,
    expected_pages,
    missing_items,
    same_set,
    sorted_distinct,
    without_field,
)
from opsframe.functions.text import PERMISSIONS
from opsframe.operators.ordering import salted_join, top_k
from opsframe.schemas import ACCESS, DOCUMENT

# Services, the path rewrite, batch and page sizes, success states.
URL_SERVICE = "cm_hive"
GRANT_SERVICE = "cm_hdfs"
OLD_PATH, NEW_PATH = "/schemas/", "/datafiles/"
DB_SUFFIX = r"\.db$"
POLICY_BATCH = 100
ROLE_PAGE_SIZE = 200
ROLE_OK = (200,)
POLICY_OK = (200, 201)


def _field(struct: Column, fields: Sequence[str], name: str) -> Column:
    """A list field of a struct, null when the documents were read without it."""
    return struct[name] if name in fields else F.lit(None).cast("array<string>")


def roles_to_groups(entries: DataFrame) -> DataFrame:
    """Groups become the sorted union of groups and roles, roles become empty."""
    for name in ("groups", "roles"):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast("array<string>"))
    return entries.withColumns(
        {
            "groups": array_union_sorted(F.col("groups"), F.col("roles")),
            "roles": F.array().cast("array<string>"),
        }
    )


def roles_to_groups_items(policies: DataFrame) -> DataFrame:
    """The same inside every policy item; policies without items stay as they are."""
    fields = policies.schema["policyItems"].dataType.elementType.names

    def move(item: Column) -> Column:
        groups = array_union_sorted(_field(item, fields, "groups"), _field(item, fields, "roles"))
        return item.withField("groups", groups).withField(
            "roles", F.array().cast("array<string>")
        )

    return policies.withColumn("policyItems", F.transform("policyItems", move))


def _moved(value: Column) -> Column:
    new_path = F.replace(value, F.lit(OLD_PATH), F.lit(NEW_PATH))
    return F.regexp_replace(new_path, DB_SUFFIX, "")


def _rewritten_urls(values: Column, mode: str) -> Column:
    """New URL values; null where the policy stays as it is."""
    if mode == "all":
        return F.transform(values, _moved)
    if mode != "matched":
        raise ValueError(f"unknown mode {mode!r}, expected 'all' or 'matched'")
    touched = F.transform(values, lambda v: F.when(v.contains(OLD_PATH), _moved(v)).otherwise(v))
    result = sorted_distinct(touched)
    return F.when(~same_set(values, result), result)


def rewrite_policy_urls(
    policies: DataFrame, service: str = URL_SERVICE, mode: str = "all"
) -> DataFrame:
    """Moves URL resources of one service to the new path and drops a trailing ``.db``.

    ``all`` treats every value and keeps order and copies. ``matched`` treats values below the
    old path, gives them sorted without copies, and only where the set of values changes.
    """

    def rewrite(key: Column, resource: Column) -> Column:
        values = F.coalesce(
            _rewritten_urls(resource["values"], mode), resource["values"]
        )
        ours = (key == "url") & (F.col("service") == service)
        return F.when(ours, resource.withField("values", values)).otherwise(resource)

    return policies.withColumn("resources", F.transform_values("resources", rewrite))


def policy_change_log(policies: DataFrame, service: str = URL_SERVICE) -> DataFrame:
    """``policyName, original, updated`` of the policies that mode ``matched`` changes."""
    values = F.col("resources")["url"]["values"]
    return (
        policies.where(F.col("service") == service)
        .select(
            F.col("name").alias("policyName"),
            values.alias("original"),
            _rewritten_urls(values, "matched").alias("updated"),
        )
        .where(F.col("updated").isNotNull())
    )


def policy_change_count(policies: DataFrame, service: str = URL_SERVICE) -> DataFrame:
    return policy_change_log(policies, service).agg(F.count(F.lit(1)).alias("changed"))


def drop_document_id(documents: DataFrame) -> DataFrame:
    """Documents without their server-given id, as an import wants them."""
    if DOCUMENT in documents.columns:
        documents = documents.withColumn(DOCUMENT, without_field(F.col(DOCUMENT), "id"))
    return documents.drop("id")


def _named(policies: DataFrame, service: str) -> DataFrame:
    return policies.where(F.col("service") == service)


def unmatched_grants(
    policies: DataFrame, grants: DataFrame, service: str = GRANT_SERVICE
) -> DataFrame:
    """Grants that name no policy of the service."""
    names = _named(policies, service).select(F.col("name").alias("policy_name"))
    return salted_join(grants, names, ["policy_name"], spread_by="row_no", how="left_anti").select(
        *grants.columns
    )


def _first_places(df: DataFrame, *keys: str) -> DataFrame:
    """Per key: the first grant at all and the first one of each permission."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ["first", *PERMISSIONS.values()]])


def grant_targets(
    policies: DataFrame, grants: DataFrame, service: str = GRANT_SERVICE
) -> DataFrame:
    """Where grants go: ``name, item, group_name, first`` and a place per permission.

    ``item`` is the first item of the policy that holds the group, null when a new one is
    needed. Grants shrink to one row per policy and group before the shuffle.
    """
    letter_at = {
        name: F.when(
            F.col("permissions").contains(letter),
            F.struct("row_no", F.instr("permissions", letter).alias("at")),
        ).alias(name)
        for letter, name in PERMISSIONS.items()
    }
    wanted = _first_places(
        grants.select(
            F.col("policy_name").alias("name"),
            "group_name",
            F.col("row_no").alias("first"),
            *letter_at.values(),
        ),
        "name",
        "group_name",
    )
    ours = _named(policies, service)
    held = (
        ours.select("name", F.posexplode("policyItems.groups").alias("item", "groups"))
        .select("name", "item", F.explode("groups").alias("group_name"))
        .groupBy("name", "group_name")
        .agg(F.min("item").alias("item"))
    )
    # An inner join on purpose: a semi join would move below the aggregation, to all grants.
    return wanted.join(ours.select("name"), "name").join(held, ["name", "group_name"], "left")


def _by_place() -> Column:
    """The permissions that have a place, in order of their places."""
    places = [
        F.struct(F.col(name).alias("at"), F.lit(name).alias("permission"))
        for name in PERMISSIONS.values()
    ]
    present = F.filter(F.array(*places), lambda p: p["at"].isNotNull())
    return F.transform(F.array_sort(present), lambda p: p["permission"])


def merge_grants(
    policies: DataFrame, grants: DataFrame, service: str = GRANT_SERVICE
) -> DataFrame:
    """Policies with the grants merged into their items; policy names are unique per service.

    A group that an item holds gets the permissions its first such item lacks; other groups
    get a new item each, in order of their first grant. A policy without grants is unchanged.
    What is collected per policy is one entry per item of the merged document, whatever the
    number of grants.
    """
    # New accesses and items may be null in places, so the columns have to allow it.
    item_list = policies.schema["policyItems"].dataType.simpleString()
    policies = policies.withColumn("policyItems", F.col("policyItems").cast(item_list))
    new_group = F.when(F.col("item").isNull(), F.col("group_name"))
    targets = grant_targets(policies, grants, service).withColumn("new_group", new_group)
    items = _named(policies, service).select(
        "name", F.posexplode("policyItems").alias("item", "_doc")
    )
    entries = targets.drop("group_name").unionByName(
        items.drop("_doc"), allowMissingColumns=True
    )
    entry = F.struct(
        F.col("item").isNull().alias("is_new"), "item", "first", "new_group",
        _by_place().alias("permissions"),
    )
    gains = (
        _first_places(entries, "name", "item", "new_group")
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    )

    item_type = policies.schema["policyItems"].dataType.elementType

    def allow(permissions: Column) -> Column:
        return F.transform(
            permissions,
            lambda p: F.struct(p.alias("type"), F.lit(True).alias("isAllowed")).cast(ACCESS),
        )

    def extend(item: Column, gain: Column) -> Column:
        accesses = F.coalesce(item["accesses"], F.array().cast(f"array<{ACCESS}>"))
        lacking = missing_items(gain["permissions"], F.transform(accesses, lambda a: a["type"]))
        return F.when(F.size(lacking) == 0, item).otherwise(
            item.withField("accesses", F.concat(accesses, allow(lacking)))
        )

    def new_item(entry: Column) -> Column:
        known = {
            "accesses": allow(entry["permissions"]),
            "groups": F.array(entry["new_group"]),
            "users": F.array().cast("array<string>"),
            "delegateAdmin": F.lit(False),
        }
        return F.struct(
            *[
                known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in item_type.fields
            ]
        )

    old = F.coalesce("policyItems", F.array().cast(policies.schema["policyItems"].dataType))
    # Entries of existing items come first and in item order, so both lists line up.
    extended = F.zip_with(old, F.slice("_entries", 1, F.size(old)), extend)
    added = F.transform(F.filter("_entries", lambda e: e["is_new"]), new_item)
    ours = F.col("service") == service
    return (
        policies.join(gains, "name", "left")
        .withColumn(
            "policyItems",
            F.when(ours & F.col("_entries").isNotNull(), F.concat(extended, added)).otherwise(
                F.col("policyItems")
            ),
        )
        .select(*policies.columns)
    )


def plan_policy_upsert(
    incoming: DataFrame,
    existing: DataFrame,
    override: bool = False,
    order: str = "ord",
    existing_order: str = "ord",
) -> DataFrame:
    """Adds ``action`` (create, update or fail) and ``target_id`` to the incoming policies.

    A policy is matched by service and name. Without a match the first of its name creates it
    and later ones meet it as existing. With ``override`` a match that has an id is updated;
    the id of one just created is not known yet and stays null.
    """
    # As a struct the key also matches where a part of it is null.
    key = F.struct("service", "name").alias("_key")
    matches = existing.groupBy(key).agg(
        F.struct(F.min_by("id", existing_order).alias("id")).alias("_match")
    )
    plan = incoming.groupBy(key).agg(F.min(order).alias("_first")).join(matches, "_key", "left")
    joined = salted_join(incoming.withColumn("_key", key), plan, ["_key"], spread_by=order)
    found = F.col("_match").isNotNull()
    found_id = F.nullif(F.col("_match.id"), F.lit(0).cast("bigint"))
    creates = ~found & (F.col(order) == F.col("_first"))
    updates = F.lit(override) & (~found | found_id.isNotNull())
    action = F.when(creates, "create").when(updates, "update").otherwise("fail")
    return joined.select(
        *incoming.columns,
        action.alias("action"),
        F.when(~creates & updates, found_id).alias("target_id"),
    )


def import_outcomes(results: DataFrame, ok: Sequence[int] = ROLE_OK) -> DataFrame:
    """Adds ``success``: the server answered with one of the states in ``ok``."""
    success = F.coalesce(F.col("status").isin(*ok), F.lit(False))
    return results.withColumn("success", success)


def import_outcome_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )


def import_failures(results: DataFrame, k: int | None = 10) -> DataFrame:
    """The first ``k`` failures by index, or all of them for ``None``."""
    failed = results.where(~F.col("success"))
    return failed if k is None else top_k(failed, k, F.asc("index"))


def page_completeness(
    pages: DataFrame, declared_total: int, page_size: int = ROLE_PAGE_SIZE
) -> DataFrame:
    """One row: rows fetched against the declared total, and the pages that total needs."""
    fetched = pages.agg(F.count(F.lit(1)).alias("fetched"))
    declared = F.lit(declared_total).cast("bigint")
    return fetched.select(
        declared.alias("declared"),
        "fetched",
        expected_pages(declared, page_size).alias("expected_pages"),
        (F.col("fetched") == declared).alias("complete"),
    )
