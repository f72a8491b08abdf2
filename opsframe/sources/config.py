"""Configuration documents: the item tree and the service list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsframe.schemas import CONFIG_TREE_DDL, SERVICES_DDL


def _items(
    nodes: DataFrame, scope: str, config: str, cluster: Column, service: Column, group: Column
) -> DataFrame:
    return nodes.select(
        F.lit(scope).alias("scope"),
        cluster.alias("cluster"),
        service.alias("service"),
        group.alias("role_group"),
        F.inline(f"{config}.items").alias("key", "value"),
    ).where(F.col("key").isNotNull() & (F.col("key") != ""))


def scan_config_tree(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of all five scopes: ``scope, cluster, service, role_group, key, value``.

    Scopes: ``service``, ``role_group``, ``manager``, ``management_service`` and
    ``management_role_group``.
    """
    tree = spark.read.schema(CONFIG_TREE_DDL).json(path, multiLine=not lines, mode="FAILFAST")
    none = F.lit(None).cast("string")
    services = tree.select(F.inline("clusters").alias("cluster", "services")).select(
        "cluster", F.inline("services").alias("service", "config", "groups")
    )
    groups = services.select(
        "cluster", "service", F.inline("groups").alias("role_group", "config")
    )
    manager = tree.select("manager.config")
    management = tree.select("management.config")
    management_groups = tree.select(
        F.inline("management.roleConfigGroups").alias("role_group", "config")
    )
    cluster, service, group = F.col("cluster"), F.col("service"), F.col("role_group")
    return (
        _items(services, "service", "config", cluster, service, none)
        .unionByName(_items(groups, "role_group", "config", cluster, service, group))
        .unionByName(_items(manager, "manager", "config", none, none, none))
        .unionByName(_items(management, "management_service", "config", none, none, none))
        .unionByName(
            _items(management_groups, "management_role_group", "config", none, none, group)
        )
    )


def scan_services(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``service, type, ord`` in listing order."""
    tree = spark.read.schema(SERVICES_DDL).json(path, multiLine=not lines, mode="FAILFAST")
    return tree.select(
        F.monotonically_increasing_id().alias("page"), F.posexplode("items").alias("pos", "item")
    ).select(
        F.col("item.name").alias("service"),
        F.col("item.type").alias("type"),
        F.struct("page", "pos").alias("ord"),
    )
