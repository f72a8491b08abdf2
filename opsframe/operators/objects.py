"""Backup objects: expired folders and the choice of objects to restore."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opsframe.functions import basename, build_key, compact_date, parse_object_key, relative_key
from opsframe.functions.keys import layout_of
from opsframe.session import as_instant

# Folder names, retention in days, delete batch.
WAL_FOLDER = "wal_backups"
SQL_FOLDER = "sql_backups"
FILESYSTEM_FOLDER = "file_systembackups"
RETENTION_DAYS = 15
DELETE_BATCH = 1000


def _prefix(layout: str, cluster: str | None, node: str | None, base: str) -> str:
    if layout == "flat":
        return f"{base}/"
    if cluster is None or node is None:
        raise ValueError("the clustered layout needs a cluster and a node")
    return f"{cluster}/{base}/{node}/"


def filter_expired_objects(
    listing: DataFrame,
    now: str | datetime | Column,
    days: int = RETENTION_DAYS,
    layout: str = "flat",
    cluster: str | None = None,
    node: str | None = None,
    base: str = WAL_FOLDER,
) -> DataFrame:
    """Objects that name an expired date folder, with ``folder, folder_ts, deletable``.

    A folder is expired when its midnight lies strictly before ``now`` minus ``days``, time of
    day included. An object is deletable when it lies inside the folder.
    """
    inside = layout_of(layout)["inside_parts"]
    cutoff = as_instant(now) - F.make_dt_interval(days=F.lit(days))
    parsed = listing.where(F.col("key").startswith(_prefix(layout, cluster, node, base))).select(
        "*", parse_object_key(F.col("key"), layout).alias("_at")
    )
    return parsed.where(F.col("_at.folder_ts") < cutoff).select(
        *listing.columns,
        F.col("_at.folder").alias("folder"),
        F.col("_at.folder_ts").alias("folder_ts"),
        (F.col("_at.n_parts") >= inside).alias("deletable"),
    )


def expired_folders(listing: DataFrame, now: str | datetime | Column, **where) -> DataFrame:
    """``folder, folder_ts, n_objects`` of expired folders; arguments as for the filter."""
    return (
        filter_expired_objects(listing, now, **where)
        .groupBy("folder", "folder_ts")
        .agg(F.count_if("deletable").alias("n_objects"))
    )


def select_backup_objects(
    listing: DataFrame,
    cluster: str,
    instance: str,
    kind: str,
    date: str | None = None,
    root: str | None = None,
    date_match: str = "basename_compact",
) -> DataFrame:
    """Objects of one backup: ``key`` and ``target``, the path below the local folder.

    ``Filesystem`` is one archive by name; ``SQL`` are dumps with the date in the file name
    (``basename_compact``, without dashes) or anywhere in the key (``key_iso``); ``WAL`` is
    everything in the date folder. Without a ``date`` it is today's.
    """
    top = f"{root}/{cluster}" if root else cluster
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if date is None else F.lit(date)
    key = F.col("key")
    if kind == "Filesystem":
        wanted = F.concat(F.lit(f"{top}/{FILESYSTEM_FOLDER}/{instance}/"), day, F.lit(".tar.gz"))
        return listing.where(key == wanted).select(
            "key", build_key(FILESYSTEM_FOLDER, basename(key)).alias("target")
        )
    if kind == "SQL":
        if date_match not in ("basename_compact", "key_iso"):
            raise ValueError(f"unknown date match {date_match!r}")
        dated = (
            basename(key).contains(compact_date(day))
            if date_match == "basename_compact"
            else key.contains(day)
        )
        return listing.where(key.startswith(f"{top}/{SQL_FOLDER}/{instance}/") & dated).select(
            "key", build_key(SQL_FOLDER, basename(key)).alias("target")
        )
    if kind == "WAL":
        folder = f"{top}/{WAL_FOLDER}/{instance}/"
        in_folder = relative_key(key, folder)
        return listing.where(
            key.startswith(folder) & in_folder.startswith(F.concat(day, F.lit("/")))
        ).select(
            "key",
            build_key(WAL_FOLDER, F.substr(in_folder, F.length(day) + 2)).alias("target"),
        )
    raise ValueError(f"invalid backup type {kind!r}: must be one of SQL, Filesystem, WAL")


def endpoint_for(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    cluster_col: str = "cluster",
    missing: str = "error",
) -> DataFrame:
    """Adds ``site``: that of the first rule ``(contains or equals, token, site)`` the cluster
    name meets.

    A cluster without a rule is an error, or has a null site for ``missing='null'``.
    """
    name = F.col(cluster_col)
    site = F.lit(None).cast("string")
    for how, token, place in reversed(rules):
        met = name.contains(token) if how == "contains" else name == token
        site = F.when(met, place).otherwise(site)
    if missing == "error":
        shown = F.concat(F.lit("no site for cluster "), F.coalesce(name, F.lit("null")))
        site = F.coalesce(site, F.raise_error(shown))
    return df.withColumn("site", site)
