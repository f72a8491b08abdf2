import random
from collections import Counter
from unittest.mock import MagicMock

import pytest

from opsframe.operators import catalog
from opsframe.plans import copy_table, inventory_report
from opsframe.sinks import write_jdbc
from opsframe.sources import scan_metastore, scan_parquet, scan_table

DDL = {
    "DBS": "DB_ID BIGINT, NAME STRING",
    "TBLS": "TBL_ID BIGINT, DB_ID BIGINT, SD_ID BIGINT, TBL_NAME STRING",
    "SDS": "SD_ID BIGINT, CD_ID BIGINT",
    "COLUMNS_V2": "CD_ID BIGINT, COLUMN_NAME STRING",
    "PARTITIONS": "PART_ID BIGINT, TBL_ID BIGINT, PART_NAME STRING",
    "PARTITION_KEYS": "TBL_ID BIGINT, PKEY_NAME STRING",
}


@pytest.fixture
def data():
    rng = random.Random(5)
    tables = range(30)
    return {
        "DBS": [(i, f"db{i}") for i in range(4)],
        "TBLS": [(t, rng.randrange(5), t + 100, f"t{t}") for t in tables],
        "SDS": [(t + 100, t // 2) for t in tables],
        "COLUMNS_V2": [(rng.choice([1, rng.randrange(18)]), f"c{i}") for i in range(90)],
        "PARTITIONS": [
            (i, rng.choice([2, rng.randrange(35)]), rng.choice(["dt=1/hr=2", "hr=3", "plain"]))
            for i in range(120)
        ],
        "PARTITION_KEYS": [
            (t, key) for t in range(0, 30, 2) for key in rng.choice([["dt"], ["dt", "hr"], [None]])
        ],
    }


@pytest.fixture
def ms(spark, data):
    return {name: spark.createDataFrame(rows, DDL[name]) for name, rows in data.items()}


def brute_inventory(data, dbs=None):
    names = {i: n for i, n in data["DBS"] if dbs is None or n in dbs}
    descriptor = dict(data["SDS"])
    columns = Counter(c for c, _ in data["COLUMNS_V2"])
    partitions = Counter(t for _, t, _ in data["PARTITIONS"])
    rows = [
        (names[db], name, columns[descriptor[sd]] or None, partitions[table])
        for table, db, sd, name in data["TBLS"]
        if db in names
    ]
    return sorted(rows, key=lambda r: r[:2])


@pytest.mark.parametrize("dbs", [None, ["db1", "db3"], ["none"]])
def test_inventory(ms, data, dbs):
    rows = [tuple(r) for r in inventory_report(ms, dbs).collect()]
    assert rows == brute_inventory(data, dbs)


def test_mismatches(ms, data):
    names, tables = dict(data["DBS"]), {t: (db, n) for t, db, _, n in data["TBLS"]}
    wanted = sorted(
        (table, names[tables[table][0]], tables[table][1], part.split("=")[0], key)
        for _, table, part in data["PARTITIONS"]
        for key_table, key in data["PARTITION_KEYS"]
        if table == key_table
        and table in tables
        and tables[table][0] in names
        and key is not None
        and part.split("=")[0] != key
    )
    rows = [tuple(r) for r in catalog.partition_key_mismatch(ms).collect()]
    assert sorted(rows) == wanted and wanted


def test_scan_of_exported_tables(spark, ms, folder):
    for name, frame in ms.items():
        frame.write.parquet(folder(f"ms/{name}"))
    again = scan_metastore(spark, folder("ms"))
    assert catalog.partition_counts(again).count() == 30
    assert scan_parquet(spark, folder("ms/DBS")).count() == 4


def test_copy_modes(spark, folder):
    spark.range(3).write.mode("overwrite").saveAsTable("src_t")
    copy_table(spark, "src_t", "dst_t", path=folder("dst"), show=True)
    copy_table(spark, "src_t", "dst_t", mode="append")
    copy_table(spark, "src_t", "dst_t", mode="ignore")
    assert scan_table(spark, "dst_t").count() == 6
    with pytest.raises(Exception, match="already exists"):
        copy_table(spark, "src_t", "dst_t", mode="error")
    copy_table(spark, "src_t", "dst_t")
    assert scan_table(spark, "dst_t").count() == 3
    with pytest.raises(ValueError):
        copy_table(spark, "src_t", "dst_t", mode="upsert")


def test_jdbc_copy_hands_spark_the_target(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr("opsframe.plans.catalog.write_jdbc", lambda df, **kw: seen.update(kw))
    spark.range(1).createOrReplaceTempView("jdbc_src")
    options = {"url": "jdbc:x://h/db", "driver": "d", "user": "hive"}
    copy_table(spark, "jdbc_src", "db.t", jdbc=options)
    assert seen == {"table": "db.t", "mode": "overwrite", **options}


def test_jdbc_reads_are_split_on_the_id():
    spark = MagicMock()
    reader = spark.read.format.return_value.options.return_value
    reader.option.return_value.load.return_value.first.return_value = (5, 90)
    tables = scan_metastore(spark, {"url": "jdbc:x://h/ms"}, num_partitions=8)
    assert list(tables) == list(DDL)
    split = reader.option.return_value.options
    assert split.call_args_list[0].kwargs == {
        "partitionColumn": '"DB_ID"',
        "lowerBound": 5,
        "upperBound": 91,
        "numPartitions": 8,
    }
    asked = [call.args for call in reader.option.call_args_list[:2]]
    assert asked == [
        ("query", 'SELECT min("DB_ID") AS lo, max("DB_ID") AS hi FROM "DBS"'),
        ("dbtable", '"DBS"'),
    ]


def test_jdbc_sink_options():
    frame = MagicMock()
    write_jdbc(frame, "jdbc:x://h/db", "db.t", "d", "u", mode="append", numPartitions="4")
    frame.write.format.assert_called_once_with("jdbc")
    assert frame.write.format.return_value.options.call_args.kwargs == {
        "url": "jdbc:x://h/db",
        "dbtable": "db.t",
        "driver": "d",
        "user": "u",
        "numPartitions": "4",
    }
    with pytest.raises(ValueError):
        write_jdbc(frame, "u", "t", "d", "u", mode="merge")
