"""Configuration audit: secret keys, masked change plans, rotation targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsframe.functions import is_password_key, mask_secret, normalize_service_name
from opsframe.operators.ordering import with_position

SCOPE = ["scope", "cluster", "service", "role_group"]

# Which setting of which service holds a database or directory password.
ROTATION_DDL = "service_key STRING, type STRING, config_key STRING, role_group STRING"
DATABASE_ROTATION = [
    ("hive", "service_level", "hive_metastore_database_password", None),
    ("hue", "service_level", "database_password", None),
    ("ranger", "service_level", "db_password", None),
    ("rangerkms", "service_level", "db_password", None),
    ("yarn", "service_level", "yarn_resourcemanager_store_password", None),
    ("oozie", "role_level", "oozie_database_password", "oozie-OOZIE_SERVER-BASE"),
    (
        "nifiregistry",
        "role_level",
        "nifi.registry.db.password",
        "nifiregistry-NIFI_REGISTRY_SERVER-BASE",
    ),
    (
        "sqlstreambuilder",
        "role_level",
        "spring.datasource.password",
        "sqlstreambuilder-SQL_STREAM_BUILDER_SERVER-BASE",
    ),
]
DIRECTORY_ROTATION = [
    ("ranger", None, "ranger_ldap_bind_password", "ranger-RANGER_ADMIN-BASE"),
    ("atlas", None, "atlas_ldap_bind_password", "atlas-ATLAS_SERVER-BASE"),
    (
        "nifiregistry",
        None,
        "nifiregistry_ldap_bind_password",
        "nifiregistry-NIFI_REGISTRY_SERVER-BASE",
    ),
    ("hue", "service_level", "ldap_bind_password", None),
    ("nifi", None, "nifi.security.user.ldap.password", "nifi-NIFI_NODE-BASE"),
]
REPORTS_ROLE = "REPORTSMANAGER"
REPORTS_ROLE_GROUP = "reportsmanager-REPORTSMANAGER_SERVER-BASE"
REPORTS_KEY = "headlamp_database_password"


def config_updates(items: DataFrame, wide: bool = True) -> DataFrame:
    """Secret keys to change, one row per scope and key, the new value masked."""
    return (
        items.where(is_password_key(F.col("key"), wide))
        .select(*SCOPE, "key")
        .distinct()
        .withColumn("new_value", mask_secret())
    )


def config_updates_by_scope(items: DataFrame, wide: bool = True) -> DataFrame:
    """``updates``: one ``key -> masked value`` map per scope; scopes without keys give none.

    A map holds each secret key of its scope once, however often the key was listed.
    """
    entries = F.array_sort(F.collect_list(F.struct("key", "new_value")))
    return (
        config_updates(items, wide).groupBy(*SCOPE).agg(F.map_from_entries(entries).alias("updates"))
    )


def normalized_service_groups(services: DataFrame) -> DataFrame:
    """Services numbered in listing order below their normalised name.

    One row per service rather than a list per name, so that no group has to fit one row.
    """
    keyed = services.withColumn("service_key", normalize_service_name(F.col("service")))
    return with_position(keyed, ["ord"], by=["service_key"])


def rotation_mapping(spark: SparkSession) -> DataFrame:
    """The built-in mapping: database passwords, then directory passwords."""
    return spark.createDataFrame([*DATABASE_ROTATION, *DIRECTORY_ROTATION], ROTATION_DDL)


def rotation_targets(services: DataFrame, mapping: DataFrame) -> DataFrame:
    """Settings to change for the services that exist: ``level, service_key, service, ...``.

    Of several services with one normalised name the first listed counts. A mapping entry is
    service-level only when it says so.
    """
    firsts = services.groupBy(
        normalize_service_name(F.col("service")).alias("service_key")
    ).agg(F.min_by("service", "ord").alias("service"))
    by_service = F.col("type").eqNullSafe("service_level")
    return firsts.join(mapping, "service_key").select(
        F.when(by_service, "service").otherwise("role_group").alias("level"),
        "service_key",
        "service",
        F.when(~by_service, F.col("role_group")).alias("role_group"),
        "config_key",
        mask_secret().alias("new_value"),
    )


def has_role_type(roles: DataFrame, role_type: str) -> DataFrame:
    """One row when some role has the type, else none."""
    return (
        roles.where(F.col("type") == role_type)
        .agg(F.count(F.lit(1)).alias("n_roles"))
        .where("n_roles > 0")
    )


def reports_manager_target(roles: DataFrame) -> DataFrame:
    """The reports manager's setting, only where such a role exists."""
    return has_role_type(roles, REPORTS_ROLE).select(
        F.lit("role_group").alias("level"),
        F.lit(REPORTS_ROLE_GROUP).alias("role_group"),
        F.lit(REPORTS_KEY).alias("config_key"),
        mask_secret().alias("new_value"),
    )
