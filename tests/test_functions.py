import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe import functions as fn

# Names that must count as password keys.
PASSWORD_KEYS = [
    "ssl_private_key_password",
    "ssl_server_keystore_password",
    "ssl_client_keystore_password",
    "ranger.ssl.keystore.password",
    "ranger.kms.keystore.password",
    "hive.ssl.keystore.password",
    "rangerkms.ssl.keystore.password",
    "impala.ssl_private_key_password",
]


def value(spark, expression, **columns):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return frame.select(expression).first()[0]


@pytest.mark.parametrize(
    "text, n",
    [
        ("select 1 UNION ALL select 2", 1),
        ("a union\tall b Union \n All c", 2),
        ("UNIONALL xunion all union allx", 0),
        ("", 0),
        ("é union all é", 1),
    ],
)
def test_count_union_all(spark, text, n):
    assert value(spark, fn.count_union_all(F.col("q")), q=text) == n


def test_truncation_starts_past_the_limit_and_hides_later_unions(spark):
    fits, over = "x" * 20000, "x" * 20000 + " union all"
    assert value(spark, fn.truncate_query(F.col("q")), q=fits) == fits
    cut = value(spark, fn.truncate_query(F.col("q")), q=over)
    assert cut == fits + " --[TRUNCATED]"
    assert value(spark, fn.count_union_all(fn.truncate_query(F.col("q"))), q=over) == 0


def test_strip_takes_every_kind_of_whitespace(spark):
    text = " \t \x1f  a b 　\r\n"
    assert value(spark, fn.strip_ws(F.col("t")), t=text) == text.strip() == "a b"


@pytest.mark.parametrize(
    "line, expected",
    [
        ("2024-11-14 10:12:34,567 INFO", dt.datetime(2024, 11, 14, 10, 12, 34, 567000)),
        (" 2024-11-14 10:12:34,567", None),
        ("2024-13-14 10:12:34,567", None),
        ("2024-02-30 10:12:34,567", None),
        ("no time", None),
        ("2024-11-14 10:12:34.567", None),
    ],
)
def test_log_timestamp(spark, line, expected):
    assert value(spark, fn.parse_log_timestamp(F.col("l")), l=line) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "text", ["2024-11-14 10:12:34.567", "2024-11-14 10:12:34", "2024-03-10 02:30:00.000001"]
)
def test_time_texts_know_no_zone(spark, zone, text):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = F.lit(text).cast("timestamp_ntz")
        assert value(spark, fn.iso_ts(ts)) == dt.datetime.fromisoformat(text).isoformat()
        assert value(spark, fn.hour_key(ts)) == text[:13]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "text, expected",
    [("true", True), ("TRUE", True), ("false", False), (None, False), ("yes", False)],
)
def test_flag(spark, text, expected):
    assert value(spark, fn.flag(F.lit(text).cast("string"))) is expected
    assert value(spark, fn.flag(F.lit(True))) is True


@pytest.mark.parametrize(
    "text, expected",
    [
        ("rw-x", ["read", "write", "execute"]),
        ("q", []),
        ("rr", ["read", "read"]),
        ("", []),
        ("XR", []),
    ],
)
def test_parse_permissions(spark, text, expected):
    assert value(spark, fn.parse_permissions(F.col("p")), p=text) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("HIVE-1", "hive"), ("hive_on_tez-2", "hive_on_tez"), ("s3", "s3"), ("Hue", "hue")],
)
def test_normalize_service_name(spark, name, expected):
    assert value(spark, fn.normalize_service_name(F.col("n")), n=name) == expected


@pytest.mark.parametrize(
    "key, layout, folder",
    [
        ("wal_backups/2024-1-5/f", "flat", "2024-1-5"),
        ("wal_backups/2024-02-31/f", "flat", None),
        ("wal_backups/x", "flat", None),
        ("wal_backups/2024-01-05", "flat", None),
        ("wal_backups/0000-01-05/f", "flat", None),
        ("wal_backups/24-01-05/f", "flat", None),
        ("c/wal_backups/n/2024-01-01", "clustered", "2024-01-01"),
        ("c/wal_backups/n/2024-01-01/f", "clustered", "2024-01-01"),
        ("c/wal_backups/2024-01-01", "clustered", None),
    ],
)
def test_parse_object_key(spark, key, layout, folder):
    at = value(spark, fn.parse_object_key(F.col("k"), layout), k=key)
    assert at["folder"] == folder
    assert (at["folder_ts"] is None) == (folder is None)
    assert at["n_parts"] == len(key.split("/"))


def test_unknown_layout_is_refused():
    with pytest.raises(ValueError):
        fn.parse_object_key(None, "deep")


def test_password_keys(spark):
    keys = [*PASSWORD_KEYS, "KEYSTORE_Password", "truststore_password", "keystore_path"]
    frame = spark.createDataFrame([(k,) for k in keys], "k STRING")
    rows = frame.select("k", fn.is_password_key(F.col("k")), fn.is_password_key(F.col("k"), False))
    found = {k: (wide, narrow) for k, wide, narrow in rows.collect()}
    assert all(found[k][0] for k in PASSWORD_KEYS)
    assert found["KEYSTORE_Password"] == (True, True)
    assert found["impala.ssl_private_key_password"] == (True, False)
    assert found["truststore_password"] == found["keystore_path"] == (False, False)


def test_key_helpers(spark):
    key = F.lit("a/b/c.txt")
    assert value(spark, fn.basename(key)) == "c.txt"
    assert value(spark, fn.relative_key(key, "a/")) == "b/c.txt"
    assert value(spark, fn.relative_key(key, "x/")) is None
    assert value(spark, fn.build_key("x", F.lit("y"))) == "x/y"
    assert value(spark, fn.compact_date(F.lit("2024-01-31"))) == "20240131"
    assert value(spark, fn.split_part(F.lit("nokey"), "=", 1)) == "nokey"
    assert value(spark, fn.split_part(F.lit("a=1/b=2"), "=", 1)) == "a"


def test_numbers(spark):
    assert value(spark, fn.number(F.lit("12.5"))) == 12.5
    assert value(spark, fn.number(F.lit("many"))) == 0.0
    assert value(spark, fn.pct(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, fn.pct(F.lit(1), F.lit(8))) == 12.5
    assert value(spark, fn.expected_pages(F.lit(401), 200)) == 3
    assert value(spark, fn.ms_to_s(F.lit(1500))) == 1.5
    assert value(spark, fn.default_to(F.lit(None).cast("string"), "d")) == "d"


def test_sets(spark):
    a, b = F.array(F.lit("b"), F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))
    null = F.lit(None).cast("array<string>")
    assert value(spark, fn.same_set(a, b)) is True
    assert value(spark, fn.same_set(null, F.array().cast("array<string>"))) is True
    assert value(spark, fn.sorted_distinct(a)) == ["a", "b"]
    assert value(spark, fn.array_union_sorted(a, null)) == ["a", "b"]
    assert value(spark, fn.missing_items(a, F.array(F.lit("a")))) == ["b"]
    documents = F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit("doc")))
    assert value(spark, fn.map_documents(documents)) == ["doc"]


def test_month_cutoff_clamps(spark):
    cutoff = value(spark, fn.epoch_ms_cutoff("2024-03-31 10:00:00"))
    assert cutoff == dt.datetime(2024, 2, 29, 10, tzinfo=dt.timezone.utc).timestamp() * 1000


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("2024-01-30T12:00:00.000Z", dt.datetime(2024, 1, 30, 12)),
        ("2024-01-30T12:00:00.25+02:00", dt.datetime(2024, 1, 30, 10, 0, 0, 250000)),
        ("2024-01-30 12:00:00.5", dt.datetime(2024, 1, 30, 12, 0, 0, 500000)),
        ("1969-12-31T23:59:59.999Z", dt.datetime(1969, 12, 31, 23, 59, 59, 999000)),
        ("2024-01-30T12:00:00+05", dt.datetime(2024, 1, 30, 7)),
        ("2024-01-30T12:00:00+5:30", dt.datetime(2024, 1, 30, 6, 30)),
        ("2024-01-30T12:00:00-0530", dt.datetime(2024, 1, 30, 17, 30)),
        ("2024-01-30T12:00:00UTC+3", dt.datetime(2024, 1, 30, 9)),
        ("2024-01-30T12:00:00 GMT-03:00", dt.datetime(2024, 1, 30, 15)),
        ("2024-01-30T12:00:00Europe/Paris", dt.datetime(2024, 1, 30, 11)),
        ("2024-07-30 12:00:00.5 Europe/Paris", dt.datetime(2024, 7, 30, 10, 0, 0, 500000)),
        ("2024-01-30T12:00+01:00", dt.datetime(2024, 1, 30, 11)),
        ("2024-01-30T12:00", dt.datetime(2024, 1, 30, 12)),
        (" 2024-01-30 ", dt.datetime(2024, 1, 30)),
        (None, None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zone_free(spark, text, wanted, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(text,)], "t STRING").select(fn.zone_free(F.col("t")))
        assert frame.first()[0] == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text", ["soon", "12:00", "2024-01-30T12:00:00 Mars/Base", "2024-01-30Z", ""])
def test_zone_free_refuses_other_text(spark, text):
    frame = spark.createDataFrame([(text,)], "t STRING").select(fn.zone_free(F.col("t")))
    with pytest.raises(Exception, match=f"no time: {text}"):
        frame.collect()
