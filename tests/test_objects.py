import datetime as dt
import random
from collections import Counter

import pytest

from opsframe import plans, sources
from opsframe.operators import objects, retention

NOW = dt.datetime(2024, 3, 20, 12)


def listing(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key STRING")


def model(keys, now, days, layout, prefix):
    """Expired folders with the number of objects inside them."""
    part, least = (1, 3) if layout == "flat" else (3, 4)
    keys = [k for k in keys if k.startswith(prefix)]
    folders = {}
    for key in keys:
        parts = key.split("/")
        if len(parts) >= least:
            try:
                day = dt.datetime.strptime(parts[part], "%Y-%m-%d")
            except ValueError:
                continue
            if day < now - dt.timedelta(days=days):
                folders[parts[part]] = day
    return {f: (d, sum(k.startswith(f"{prefix}{f}/") for k in keys)) for f, d in folders.items()}


@pytest.mark.parametrize("layout", ["flat", "clustered"])
def test_expired_folders_equal_the_model(spark, layout):
    rng = random.Random(9)
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(12)]
    names = [d.isoformat() for d in days] + ["2024-3-2", "2024-02-31", "misc", "20240301", ""]
    tops = ["wal_backups"] if layout == "flat" else ["c1/wal_backups/n1", "c2/wal_backups/n1"]
    keys = {
        "/".join([rng.choice(tops), rng.choice(names), *["f%d" % i] * rng.randrange(3)])
        for i in range(400)
    } | {"other/2024-03-01/f", "wal_backups", "wal_backups/"}
    where = {} if layout == "flat" else {"layout": layout, "cluster": "c1", "node": "n1"}
    found = objects.expired_folders(listing(spark, sorted(keys)), NOW, **where).collect()
    wanted = model(keys, NOW, 15, layout, tops[0] + "/")
    assert {r["folder"]: (r["folder_ts"], r["n_objects"]) for r in found} == wanted and wanted


@pytest.mark.parametrize(
    "now, expired", [("2024-03-20 12:00:00", True), ("2024-03-20 00:00:00", False)]
)
def test_time_of_day_counts(spark, now, expired):
    found = objects.expired_folders(listing(spark, ["wal_backups/2024-03-05/f"]), now)
    assert bool(found.count()) is expired


def test_days_and_base_are_parameters(spark):
    keys = listing(spark, ["b/2024-03-01/f", "wal_backups/2024-03-01/f"])
    found = objects.expired_folders(keys, NOW, days=20, base="b").collect()
    assert found == []
    assert objects.expired_folders(keys, NOW, days=19, base="b").count() == 1
    with pytest.raises(ValueError):
        objects.expired_folders(keys, NOW, layout="clustered")


def test_files_named_like_a_folder_are_kept(spark):
    keys = listing(spark, ["c/wal_backups/n/2024-01-01", "c/wal_backups/n/2024-01-02/f"])
    where = {"layout": "clustered", "cluster": "c", "node": "n"}
    found = objects.expired_folders(keys, NOW, **where).collect()
    assert {r["folder"]: r["n_objects"] for r in found} == {"2024-01-01": 0, "2024-01-02": 1}
    plan = plans.retention_plan(keys, NOW, **where).collect()
    assert [r["key"] for r in plan] == ["c/wal_backups/n/2024-01-02/f"]


def test_plan_batches_one_large_folder(spark):
    keys = [f"wal_backups/2024-01-01/{i:05d}" for i in range(2500)]
    keys += [f"wal_backups/2024-01-02/{i}" for i in range(3)]
    plan = plans.retention_plan(listing(spark, keys).repartition(6), NOW).collect()
    sizes = Counter((r["folder"], r["chunk_id"]) for r in plan)
    assert sizes == {
        ("2024-01-01", 0): 1000,
        ("2024-01-01", 1): 1000,
        ("2024-01-01", 2): 500,
        ("2024-01-02", 0): 3,
    }
    first = sorted(r["key"] for r in plan if r["folder"] == "2024-01-01" and r["chunk_id"] == 0)
    assert first == keys[:1000]


KEYS = [
    "r/c/file_systembackups/i/2024-01-05.tar.gz",
    "r/c/file_systembackups/i/2024-01-05.tar.gz.md5",
    "r/c/sql_backups/i/db_20240105.sql",
    "r/c/sql_backups/i/2024-01-05/db.sql",
    "r/c/sql_backups/j/db_20240105.sql",
    "r/c/wal_backups/i/2024-01-05/a/b.wal",
    "r/c/wal_backups/i/2024-01-051/x.wal",
    "c/wal_backups/i/2024-01-05/x.wal",
]


@pytest.mark.parametrize(
    "kind, extra, expected",
    [
        ("Filesystem", {}, [(KEYS[0], "file_systembackups/2024-01-05.tar.gz")]),
        ("SQL", {}, [(KEYS[2], "sql_backups/db_20240105.sql")]),
        ("SQL", {"date_match": "key_iso"}, [(KEYS[3], "sql_backups/db.sql")]),
        ("WAL", {}, [(KEYS[5], "wal_backups/a/b.wal")]),
        ("WAL", {"root": None}, [(KEYS[7], "wal_backups/x.wal")]),
    ],
)
def test_backup_selection(spark, kind, extra, expected):
    where = {"cluster": "c", "instance": "i", "date": "2024-01-05", "root": "r", **extra}
    found = objects.select_backup_objects(listing(spark, KEYS), kind=kind, **where)
    assert [tuple(r) for r in found.collect()] == expected


def test_backup_of_today(spark):
    key = f"c/wal_backups/i/{dt.datetime.now(dt.timezone.utc).date()}/x"
    found = objects.select_backup_objects(listing(spark, [key]), "c", "i", "WAL")
    assert found.first()["target"] == "wal_backups/x"


def test_bad_kinds(spark):
    with pytest.raises(ValueError, match="invalid backup type"):
        objects.select_backup_objects(listing(spark, KEYS), "c", "i", "TAPE")
    with pytest.raises(ValueError):
        objects.select_backup_objects(listing(spark, KEYS), "c", "i", "SQL", date_match="size")


def test_endpoints(spark):
    names = spark.createDataFrame([("UTATBX",), ("xAVB",), ("PVOS",)], "cluster STRING")
    rules = [("contains", "ATB", "virginia"), ("contains", "AVB", "texas")]
    sites = objects.endpoint_for(names, rules, missing="null").collect()
    assert [r["site"] for r in sites] == ["virginia", "texas", None]
    named = [("equals", "PVOS", "virginia"), ("equals", "PTOS", "texas")]
    exact = objects.endpoint_for(names, named, missing="null")
    assert [r["site"] for r in exact.collect()] == [None, None, "virginia"]
    with pytest.raises(Exception, match="no site for cluster PVOS"):
        objects.endpoint_for(names, rules).collect()


def test_listing_of_files(spark, tmp_path):
    root = tmp_path / "the bucket"
    for key in ["wal_backups/2024-01-01/a b", "wal_backups/2024-01-02/c", "sql/x"]:
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12345")
    found = sources.scan_object_listing(spark, str(root), "wal_backups/").collect()
    assert sorted((r["key"], r["length"]) for r in found) == [
        ("wal_backups/2024-01-01/a b", 5),
        ("wal_backups/2024-01-02/c", 5),
    ]
    assert sources.scan_object_listing(spark, str(root)).count() == 3
    part = sources.scan_object_listing(spark, str(root), "wal_backups/2024-01-01/a")
    assert part.count() == 1
    assert sources.scan_object_listing(spark, str(root), "none/").count() == 0


def test_row_retention_bounds(spark):
    cutoff = dt.datetime(2024, 2, 29, 10)
    at = int(cutoff.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = spark.createDataFrame(
        [(cutoff, at), (cutoff - dt.timedelta(microseconds=1), at + 1), (None, None)],
        "ts TIMESTAMP_NTZ, ms BIGINT",
    )
    now = "2024-03-31 10:00:00"
    past, kept = retention.split_by_retention(rows, "ts", now)
    assert [r["ms"] for r in past.collect()] == [at + 1] and kept.count() == 2
    past, kept = retention.split_by_retention(rows, "ms", now, unit="ms")
    assert [r["ts"] for r in past.collect()] == [cutoff] and kept.count() == 2
    counts = retention.retention_delete_counts(
        {"a": (rows, "ts", "timestamp"), "b": (rows, "ms", "ms")}, now
    )
    assert {r["source"]: r["deleted"] for r in counts.collect()} == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        retention.split_by_retention(rows, "ts", now, unit="days")
    with pytest.raises(ValueError):
        retention.retention_delete_counts({}, now)
