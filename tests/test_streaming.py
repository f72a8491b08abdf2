import os
import random

import pytest

from opsframe import sources, streaming
from opsframe.operators import logs


def texts(n, seed=2):
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        query_id = "hot" if rng.random() < 0.35 else f"q{rng.randrange(60)}"
        time = f"2024-01-0{1 + i * 3 // n} {i % 24:02d}:00:00,000 " if i % 7 else ""
        if rng.random() < 0.5:
            begun = f"Compiling command(queryId={query_id}): user=u; query=t{i}"
            lines.append(time + begun)
        else:
            done = f"Completed compiling command(queryId={query_id}); compileTime={i}ms"
            lines.append(time + done)
    return lines


def write(folder, name, lines, at):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (at, at))
    return str(path)


@pytest.fixture
def log(tmp_path):
    """A folder of six files, each newer than the one before."""
    lines = texts(900)
    paths = [
        write(tmp_path / "log", f"{i}.log", lines[i * 150 : (i + 1) * 150], 1_700_000_000 + i)
        for i in range(6)
    ]
    return str(tmp_path / "log"), paths


def rows(frame):
    return sorted(tuple(str(v) for v in r) for r in frame.collect())


SHOWN = ["query_id", "user", "compile_time_ms", "union_count", "start_ts", "end_ts", "query"]


@pytest.mark.parametrize("per_batch", [1, 4, None])
def test_stream_equals_batch(spark, log, folder, per_batch):
    path, paths = log
    lines = sources.stream_log_lines(spark, path, per_batch)
    query = streaming.stream_compile_records(lines, folder("out"), folder("state"))
    query.awaitTermination()
    batches = {1: 6, 4: 2, None: 1}[per_batch]
    assert len(os.listdir(folder("out/open"))) == min(batches, 2)
    events = logs.classify_log_lines(sources.scan_log_lines(spark, paths))
    wanted = logs.pair_compile_events(events).select(*SHOWN)
    records = spark.read.parquet(folder("out/records")).select(*SHOWN)
    assert rows(records) == rows(wanted) and wanted.count() > 100


def test_a_restart_goes_on_and_repeats_nothing(spark, log, folder, tmp_path):
    path, paths = log

    def run():
        lines = sources.stream_log_lines(spark, path, 2)
        streaming.stream_compile_records(lines, folder("out"), folder("state")).awaitTermination()

    run()
    before = spark.read.parquet(folder("out/records")).count()
    run()
    assert spark.read.parquet(folder("out/records")).count() == before
    more = texts(200, seed=8)
    paths.append(write(tmp_path / "log", "9.log", more, 1_700_000_100))
    run()
    events = logs.classify_log_lines(sources.scan_log_lines(spark, paths))
    wanted = logs.pair_compile_events(events).select(*SHOWN)
    assert rows(spark.read.parquet(folder("out/records")).select(*SHOWN)) == rows(wanted)


def test_old_starts_are_given_up(spark, tmp_path, folder):
    def start(day, query_id):
        begun = f"Compiling command(queryId={query_id}): user=u; query=x"
        return f"2024-01-{day} 00:00:00,000 {begun}"

    def end(day, query_id):
        done = f"Completed compiling command(queryId={query_id}); compileTime=1ms"
        return f"2024-01-{day} 00:00:00,000 {done}"

    log = tmp_path / "log"
    write(log, "1.log", [start("01", "old"), start("01", "done"), end("01", "done")], 1_700_000_000)
    write(log, "2.log", [start("05", "new")], 1_700_000_001)
    write(log, "3.log", [end("05", "old"), end("05", "new")], 1_700_000_002)
    lines = sources.stream_log_lines(spark, str(log), 1)
    query = streaming.stream_compile_records(lines, folder("out"), folder("state"), ttl_s=86400)
    query.awaitTermination()
    records = spark.read.parquet(folder("out/records")).collect()
    assert sorted(r["query_id"] for r in records) == ["done", "new"]
    memory = (
        streaming.stream_unfinished(spark, folder("out"))
        .writeStream.format("memory")
        .queryName("given_up")
        .option("checkpointLocation", folder("state2"))
        .trigger(availableNow=True)
        .start()
    )
    memory.awaitTermination()
    found = spark.table("given_up").collect()
    assert [(r["query_id"], r["status"]) for r in found] == [("old", "expired")]


def test_hourly_windows_equal_the_batch(spark, log, folder):
    path, paths = log
    lines = sources.stream_log_lines(spark, path, 3)
    streaming.stream_compile_records(lines, folder("out"), folder("state")).awaitTermination()
    hours = streaming.stream_compile_stats_by_hour(streaming.record_stream(spark, folder("out")))
    query = (
        hours.writeStream.format("memory")
        .queryName("hours")
        .outputMode("complete")
        .option("checkpointLocation", folder("state2"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    events = logs.classify_log_lines(sources.scan_log_lines(spark, paths))
    records = logs.with_compile_flags(logs.pair_compile_events(events))
    wanted = logs.compile_stats_by_hour(records)
    assert rows(spark.table("hours").select(*wanted.columns)) == rows(wanted)
