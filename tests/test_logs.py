import csv
import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators import logs
from opsframe.plans import compile_log_report
from opsframe.schemas import COMPILE_RECORD_COLUMNS
from opsframe.sources import scan_log_lines

T = "2024-11-14 10:12:34,567 INFO "
LINES = "file_rank INT, block BIGINT, line_no BIGINT, line STRING, source_log STRING"


def start(query_id, query="SELECT 1", user="u", time=T):
    return f"{time}Compiling command(queryId={query_id}): user={user}; query={query}"


def end(query_id, ms=5, time=T):
    return f"{time}Completed compiling command(queryId={query_id}); compileTime={ms}ms"


def events(spark, texts):
    rows = [(0, 0, i, text, "a.log") for i, text in enumerate(texts)]
    return logs.classify_log_lines(spark.createDataFrame(rows, LINES))


def pairs(spark, texts):
    found = logs.pair_compile_events(events(spark, texts)).collect()
    return sorted((r["query_id"], r["query"], r["compile_time_ms"]) for r in found)


@pytest.mark.parametrize(
    "line, kind",
    [
        ("x Completed compiling command(queryId=q1); user=u; query=x", "START"),
        ("x compiling COMMAND(queryId=q1): user=u; query=x", "START"),
        ("x Compiling command(queryId=q1): user=svc; more", None),
        ("x Completed compiling command(queryId=q1); compileTime=7ms", "END"),
        ("x Completed compiling command(queryId=q1); compileTime=ms", None),
        ("x Compiling command(queryId=): user=u; query=x", None),
        ("nothing of the kind", None),
    ],
)
def test_classify(spark, line, kind):
    found = events(spark, [line]).collect()
    assert [r["kind"] for r in found] == ([kind] if kind else [])


def test_fields_are_stripped_and_unions_counted_before_truncation(spark):
    lines = spark.createDataFrame(
        [(0, 0, 0, start(" q1 ", "  select union all " + "y" * 30, " bob "), "a.log")], LINES
    )
    row = logs.classify_log_lines(lines, max_query_len=10).first()
    assert (row["query_id"], row["user"]) == ("q1", "bob")
    assert (row["query"], row["union_count"]) == ("select uni --[TRUNCATED]", 1)
    whole = logs.classify_log_lines(lines).first()
    assert whole["query"] == "select union all " + "y" * 30


def test_long_queries_are_kept_and_counted_whole(spark):
    text = "SELECT 1 " + "x" * 30_000 + " UNION ALL SELECT 2" * 5
    lines = spark.createDataFrame([(0, 0, 0, start("q1", text, "bob"), "a.log")], LINES)
    row = logs.classify_log_lines(lines).first()
    assert (row["query"], row["union_count"]) == (text, 5)


def test_unreadable_time_is_a_parse_error_and_leaves_the_start_open(spark):
    texts = [start("q"), end("q", "9" * 30), end("q", 4)]
    assert pairs(spark, texts) == [("q", "SELECT 1", 4)]
    quality = logs.log_parse_quality(events(spark, texts)).first()
    assert tuple(quality) == (1, 0, 0, 1)


def test_pairing_rules(spark):
    assert pairs(spark, [start("q", "a"), start("q", "b"), end("q")]) == [("q", "b", 5)]
    assert pairs(spark, [start("q", "a"), end("q", 1), end("q", 2)]) == [("q", "a", 1)]
    assert pairs(spark, [end("q"), start("q")]) == []


def model(rows):
    """One pass over the lines in order, with the open STARTs by query id."""
    waiting, found, open_rows = {}, [], []
    for place, kind, query_id, tag in rows:
        if kind == "START":
            if query_id in waiting:
                open_rows.append((waiting[query_id], "replaced"))
            waiting[query_id] = tag
        elif query_id in waiting:
            found.append((query_id, waiting.pop(query_id), tag))
    open_rows += [(tag, "unfinished") for tag in waiting.values()]
    return sorted(found), sorted(open_rows)


@pytest.mark.parametrize("seed", range(6))
def test_pairing_equals_one_pass_with_a_hot_id_over_many_chunks(spark, seed):
    rng = random.Random(seed)
    rows, lines = [], []
    for i in range(1500):
        place = (i // 400, (i % 400) // rng.choice([40, 40, 40]), i)
        hot = rng.random() < 0.35
        query_id = "hot" if hot else f"q{rng.randrange(1 + seed * 40)}"
        kind = rng.choice(["START", "END"])
        rows.append((place, kind, query_id, i))
        text = start(query_id, f"t{i}") if kind == "START" else end(query_id, i)
        lines.append((*place, text, f"{place[0]}.log"))
    rng.shuffle(lines)
    found = logs.classify_log_lines(spark.createDataFrame(lines, LINES).repartition(7))
    paired = logs.pair_compile_events(found).collect()
    wanted, wanted_open = model(rows)
    got = sorted((r["query_id"], int(r["query"][1:]), r["compile_time_ms"]) for r in paired)
    assert got == wanted
    open_rows = logs.unfinished_queries(found).collect()
    assert sorted((int(r["query"][1:]), r["status"]) for r in open_rows) == wanted_open
    quality = logs.log_parse_quality(found).first()
    assert quality["pairs"] == len(wanted)
    assert quality["unfinished_starts"] == len(wanted_open)


def write_log(path, texts, zipped=False):
    with (gzip.open if zipped else open)(path, "wb") as out:
        out.write(b"".join(t if isinstance(t, bytes) else t.encode() + b"\n" for t in texts))
    return str(path)


def test_files_rank_in_argument_order(spark, tmp_path):
    a = write_log(tmp_path / "a.log", [end("q", 3)])
    b = write_log(tmp_path / "b.log.gz", [start("q", "first")], zipped=True)
    forward = logs.pair_compile_events(
        logs.classify_log_lines(scan_log_lines(spark, [b, a]))
    ).collect()
    assert [(r["query"], r["source_log"]) for r in forward] == [("first", a)]
    backward = logs.classify_log_lines(scan_log_lines(spark, [a, b]))
    assert logs.pair_compile_events(backward).count() == 0


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    path = write_log(tmp_path / "a b.log", [b"bad \xff\xfe end\n", "good é"])
    rows = scan_log_lines(spark, path).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["bad  end", "good é"]
    assert rows[0]["source_log"] == path


def test_splits_do_not_change_the_pairs(spark, tmp_path):
    rng = random.Random(1)
    texts = [
        start(f"q{rng.randrange(40)}", "x" * rng.randrange(80))
        if rng.random() < 0.5
        else end(f"q{rng.randrange(40)}", i)
        for i in range(3000)
    ]
    paths = [write_log(tmp_path / "a.log", texts[:2000])]
    paths.append(write_log(tmp_path / "b.log.gz", texts[2000:], zipped=True))
    whole = pairs(spark, texts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = scan_log_lines(spark, paths)
        assert lines.select("file_rank", "block").distinct().count() > 5
        found = logs.pair_compile_events(logs.classify_log_lines(lines)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["query_id"], r["query"], r["compile_time_ms"]) for r in found) == whole


def test_report_files(spark, tmp_path):
    path = write_log(
        tmp_path / "hs.log",
        [
            start("q1", 'select "a", 1 union all union all union all union all', "ann"),
            end("q1", 20000),
            start("q2", "select 2", "ann", time=""),
            end("q2", 10, time=""),
            start("q3", "select 3", "bob", time=""),
            end("q3", 30),
        ],
    )
    report = compile_log_report(spark, [path])
    report.write(str(tmp_path / "csv"), str(tmp_path / "summary"))

    parts = [p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv")]
    rows = []
    for part in parts:
        with open(tmp_path / "csv" / part, newline="") as f:
            rows += list(csv.DictReader(f))
    assert list(rows[0]) == COMPILE_RECORD_COLUMNS
    by_id = {r["query_id"]: r for r in rows}
    assert by_id["q1"]["start_ts"] == "2024-11-14T10:12:34.567000"
    assert by_id["q1"]["query"].startswith('select "a", 1 union all')
    assert (by_id["q1"]["slow_compile"], by_id["q1"]["excessive_unions"]) == ("True", "True")
    assert (by_id["q2"]["start_ts"], by_id["q2"]["end_ts"]) == ("", "")
    assert by_id["q1"]["source_log"] == path


    def section(name):
        text = "".join(p.read_text() for p in (tmp_path / "summary" / name).glob("*.json"))
        return [json.loads(line) for line in text.splitlines()]

    meta = section("meta")
    assert meta == [{"compile_threshold_ms": 10000, "union_threshold": 3, "parse_errors": 0}]
    users = {row.pop("user"): row for row in section("per_user")}
    hours = {row.pop("hour"): row for row in section("per_hour")}
    assert users["ann"] == {
        "total_queries": 2,
        "slow_queries": 1,
        "excessive_union_queries": 1,
        "total_compile_ms": 20010,
        "max_compile_ms": 20000,
        "avg_compile_ms": 10005.0,
    }
    # q2 has no time at all and is in no hour; q3 has only an end time.
    assert hours == {
        "2024-11-14 10": {
            "total_queries": 2,
            "slow_queries": 1,
            "sum_compile_ms": 20030,
            "avg_compile_ms": 10015.0,
        }
    }


def test_summary_sections_are_lines(spark, tmp_path):
    from opsframe.sinks import write_summary_json

    users = spark.range(5).select(F.col("id").cast("string").alias("user"), F.lit(1).alias("n"))
    hours = spark.range(2).select(F.col("id").cast("string").alias("hour"), F.lit(1).alias("n"))
    write_summary_json(users, hours, {"parse_errors": 0}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "per_user")).count() == 5


def test_thresholds_are_strict(spark):
    frame = spark.createDataFrame(
        [(10000, 3), (10001, 4)], "compile_time_ms BIGINT, union_count INT"
    )
    flags = logs.with_compile_flags(frame).select("slow_compile", "excessive_unions").collect()
    assert [tuple(r) for r in flags] == [(False, False), (True, True)]


def test_no_paths_is_an_error(spark):
    with pytest.raises(ValueError):
        scan_log_lines(spark, [])
