"""Every operator as a query over whole tables; lists are joined to text to be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fixtures import derive as d
from opsframe import functions as fn
from opsframe import plans, sinks, sources, streaming
from opsframe.operators import (
    catalog,
    configs,
    logs,
    objects,
    ordering,
    policies as pol,
    profile,
    retention,
    workload as w,
)
from opsframe.schemas import COMPILE_RECORD_COLUMNS
from opsframe.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _ms(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS").alias(col)


def _joined(col: Column | str, sep: str = "|") -> Column:
    return F.array_join(col, sep)


# --- logs -------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return logs.classify_log_lines(d.log_lines(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return logs.with_compile_flags(logs.pair_compile_events(_events(spark, sf)))


def _with_times(df: DataFrame, *times: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in times], *[_ms(t) for t in times])


def _pair(spark, sf):
    return _with_times(logs.pair_compile_events(_events(spark, sf)), "start_ts", "end_ts")


def _classify(spark, sf):
    events = _events(spark, sf).drop("file_rank", "block")
    return _with_times(events, "ts")


def _csv(spark, sf):
    path = shared_dir(spark, "records-csv")
    sinks.write_csv(_records(spark, sf), path, COMPILE_RECORD_COLUMNS)
    return spark.read.csv(path, header=True, escape='"').drop("source_log")


def _summary(section: str) -> Query:
    def run(spark, sf):
        path = shared_dir(spark, "summary")
        report = plans.compile_log_report(spark, d.log_files(spark, sf))
        report.write(shared_dir(spark, "records-csv"), path)
        report.close()
        return spark.read.json(f"{path}/{section}")

    return run


def _scan_lines(spark, sf):
    """Two arguments, the first of them compressed: its lines rank before all others."""
    path = shared_dir(spark, "lines")
    events = d.table(spark, sf, "events")
    zipped, plain = f"{path}/zipped", f"{path}/plain"
    text = F.concat_ws("|", "event_id", "event_type").alias("value")
    events.where("event_id % 2 = 1").select(text).write.text(zipped, compression="gzip")
    events.where("event_id % 2 = 0").select(text).write.text(plain)
    lines = sources.scan_log_lines(spark, [zipped, plain])
    first_plain = F.min(F.when(F.col("source_log").contains("/plain/"), F.col("file_rank")))
    start = lines.agg(first_plain.alias("rank")).scalar()
    return lines.select("line", (F.col("file_rank") < start).alias("first_argument"))


def _report(part: str) -> Query:
    def run(spark, sf):
        report = plans.compile_log_report(spark, d.log_files(spark, sf))
        return getattr(report, part)

    return run


def _documents(expression: Callable[[Column], Column], name: str) -> Query:
    def run(spark, sf):
        return d.table(spark, sf, "documents").select(
            "doc_id", expression(F.col("text")).alias(name)
        )

    return run


def _count_unions(text: Column) -> Column:
    sql = F.replace(text, F.lit(". "), F.lit(" union  ALL "))
    return fn.count_union_all(sql).cast("bigint")


# --- workload ---------------------------------------------------------------------------


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return w.flatten_query_records(d.query_records(spark, sf))


def _on_flat(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(_flat(spark, sf))


def _flatten(spark, sf):
    return _with_times(_flat(spark, sf), "query_time")


def _lookback(spark, sf):
    raw = d.query_records(spark, sf)
    return w.filter_lookback(raw, "startTime", d.NOW_WORKLOAD).select("queryId", _ms("startTime"))


def _workload_part(part: str) -> Query:
    return lambda spark, sf: plans.workload_report(
        d.query_records(spark, sf), d.NOW_WORKLOAD, hours=24
    )[part]


def _queue_part(part: str) -> Query:
    return lambda spark, sf: plans.queue_report(
        d.query_records(spark, sf), d.NOW_WORKLOAD, hours=240
    )[part]


def _scan_records(spark, sf):
    path = shared_dir(spark, "record-pages")
    raw = d.query_records(spark, sf)
    page = F.floor(F.expr("CAST(substring(queryId, 2) AS BIGINT)") / 1000)
    raw.groupBy(page.alias("page")).agg(
        F.collect_list(F.struct(*raw.columns)).alias("queries")
    ).select("queries").write.json(path)
    return w.workload_by_user(
        w.flatten_query_records(sources.scan_query_records(spark, path, lines=True)), k=None
    )


def _metastore_files(spark, sf):
    path = shared_dir(spark, "metastore")
    for name, df in d.metastore(spark, sf).items():
        df.write.parquet(f"{path}/{name}")
    return catalog.table_inventory(sources.scan_metastore(spark, path))


# --- policies ---------------------------------------------------------------------------


def _urls(mode: str) -> Query:
    def run(spark, sf):
        out = pol.rewrite_policy_urls(d.policies(spark, sf), mode=mode)
        return out.select(
            "id", "name", "service", _joined(F.col("resources")["url"]["values"]).alias("urls")
        )

    return run


def _change_log(spark, sf):
    return pol.policy_change_log(d.policies(spark, sf)).select(
        "policyName", _joined("original").alias("original"), _joined("updated").alias("updated")
    )


def _roles_items(spark, sf):
    out = pol.roles_to_groups_items(d.policies(spark, sf))
    return out.select("id", F.posexplode("policyItems").alias("item", "doc")).select(
        "id",
        "item",
        _joined("doc.groups").alias("groups"),
        F.size("doc.roles").alias("n_roles"),
    )


def _roles_entries(spark, sf):
    entries = d.table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "array(p_type, 'all') AS groups", "array(p_brand, p_type) AS roles"
    )
    return pol.roles_to_groups(entries).select(
        "id", _joined("groups").alias("groups"), F.size("roles").alias("n_roles")
    )


def _merge(spark, sf):
    return _items_as_text(pol.merge_grants(d.policies(spark, sf), d.grants(spark, sf)))


def _items_as_text(policies: DataFrame) -> DataFrame:
    return policies.select("name", F.posexplode("policyItems").alias("item", "doc")).select(
        "name",
        "item",
        _joined("doc.groups").alias("groups"),
        _joined("doc.accesses.type").alias("accesses"),
        F.col("doc.delegateAdmin").alias("delegate_admin"),
    )


def _unmatched(spark, sf):
    return pol.unmatched_grants(d.policies(spark, sf), d.grants(spark, sf)).select(
        "policy_name", "group_name", "permissions", F.col("row_no.o").alias("l_orderkey")
    )


def _upsert(override: bool) -> Query:
    def run(spark, sf):
        return pol.plan_policy_upsert(
            d.incoming_policies(spark, sf), d.existing_policies(spark, sf), override
        )

    return run


def _upsert_report(spark, sf):
    return plans.policy_upsert_report(
        d.incoming_policies(spark, sf), d.existing_policies(spark, sf), override=True
    )


def _outcomes(spark, sf):
    return pol.import_outcomes(d.import_results(spark, sf))


def _permissions(spark, sf):
    return d.grants(spark, sf).select(
        F.col("row_no.o").alias("l_orderkey"),
        "permissions",
        _joined(fn.parse_permissions(F.col("permissions"))).alias("parsed"),
    )


def _page_completeness(spark, sf):
    return pol.page_completeness(d.import_results(spark, sf), 20000)


def _migrate(spark, sf):
    out = plans.migrate_policies(d.policies(spark, sf), ["urls_matched", "item_roles"])
    return out.select(
        "id",
        _joined(F.col("resources")["url"]["values"]).alias("urls"),
        F.posexplode("policyItems").alias("item", "doc"),
    ).select(
        "id", "urls", "item", _joined("doc.groups").alias("groups"), F.size("doc.roles").alias("n_roles")
    )


def _migrate_files(spark, sf):
    """From file to file, with fields that no operator knows."""
    path, out = shared_dir(spark, "policies"), shared_dir(spark, "policies-migrated")
    denied = F.array(F.struct(F.array("name").alias("users"), F.lit(True).alias("delegateAdmin")))
    d.policies(spark, sf).drop("ord").withColumns(
        {
            "isEnabled": F.col("id") % 2 == 0,
            "description": F.concat(F.lit('say "'), "name", F.lit('", {ok}')),
            "denyPolicyItems": F.when(F.col("id") % 3 > 0, denied),
        }
    ).write.json(path)
    policies = sources.scan_policy_list(spark, path, lines=True)
    sinks.write_documents_json(plans.migrate_policies(policies, "urls_matched"), out)
    text = F.col("value")
    return spark.read.text(out).select(
        F.get_json_object(text, "$.id").cast("bigint").alias("id"),
        F.array_join(F.array_sort(F.json_object_keys(text)), "|").alias("fields"),
        F.get_json_object(text, "$.isEnabled").alias("enabled"),
        F.get_json_object(text, "$.description").alias("description"),
        F.get_json_object(text, "$.denyPolicyItems").alias("denied"),
        F.get_json_object(text, "$.policyItems[1].delegateAdmin").alias("delegate"),
    )


def _whole_policies(spark, sf):
    """Whole documents after two migrations, compared by the hash of their text."""
    path, out = shared_dir(spark, "policies"), shared_dir(spark, "policies-migrated")
    d.policy_texts(spark, sf).write.text(path)
    policies = sources.scan_policy_list(spark, path, lines=True)
    migrated = plans.migrate_policies(policies, ["urls_matched", "item_roles"])
    sinks.write_documents_json(migrated, out)
    return _hashed(spark, out)


def _whole_roles(spark, sf):
    """Whole roles through pages, without their ids."""
    path, out = shared_dir(spark, "role-pages"), shared_dir(spark, "roles")
    sinks.write_documents_json(d.role_documents(spark, sf), path, envelope="vList")
    roles = pol.drop_document_id(sources.scan_document_pages(spark, path))
    sinks.write_documents_json(roles, out)
    return _hashed(spark, out)


def _hashed(spark: SparkSession, path: str) -> DataFrame:
    name = F.get_json_object("value", "$.name").alias("name")
    return spark.read.text(path).select(name, F.md5("value").alias("hash"))


def _policy_files(spark, sf):
    path = shared_dir(spark, "policies")
    sinks.write_documents_json(d.policies(spark, sf), path)
    back = sources.scan_policy_list(spark, path, lines=True)
    return pol.rewrite_policy_urls(back, mode="all").select(
        "id", "name", "service", _joined(F.col("resources")["url"]["values"]).alias("urls")
    )


def _policy_pages(spark, sf):
    path = shared_dir(spark, "policy-pages")
    sinks.write_documents_json(d.policies(spark, sf), path, envelope="vList", page_size=200)
    back = sources.scan_documents(spark, path, ddl="id BIGINT, name STRING", lines=True)
    return pol.drop_document_id(back.withColumn("page_row", F.col("ord.doc_pos"))).select(
        "name", "page_row"
    )


def _policy_map(spark, sf):
    path = shared_dir(spark, "policy-map")
    rows = d.policies(spark, sf).select("id", F.struct("id", "name", "service").alias("doc"))
    # Each object names its first policy twice; only the second of the two counts.
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("id", "doc"))),
        lambda e: F.concat(F.lit('"k'), e["id"], F.lit('": '), F.to_json(e["doc"])),
    )
    stale = F.concat(F.lit('"k'), F.min("id"), F.lit('": {"id": -1, "name": "stale"}, '))
    rows.groupBy(F.floor(F.col("id") / 100).alias("page")).agg(
        F.concat(F.lit("{"), stale, F.array_join(entries, ", "), F.lit("}")).alias("text")
    ).select("text").write.text(path)
    return sources.scan_policy_map(spark, path, lines=True).select("id", "name", "service")


def _map_documents(spark, sf):
    entries = F.collect_list(F.struct("name", F.struct("id", "name", "service")))
    page = F.floor(F.col("id") / 100).alias("page")
    maps = d.policies(spark, sf).groupBy(page).agg(F.map_from_entries(entries).alias("documents"))
    return maps.select(F.inline(fn.map_documents(F.col("documents"))))


def _document_pages(spark, sf):
    path = shared_dir(spark, "role-pages")
    roles = d.import_results(spark, sf).select(
        F.col("index").alias("id"), "name", F.col("index").alias("ord")
    )
    sinks.write_documents_json(roles, path, envelope="vList")
    return sources.scan_document_pages(spark, path).select("id", "name")


def _grants_csv(spark, sf):
    path = shared_dir(spark, "grants")
    grants = d.grants(spark, sf).repartitionByRange("row_no").sortWithinPartitions("row_no")
    grants.drop("row_no").write.csv(path, header=True)
    merged = pol.merge_grants(d.policies(spark, sf), sources.scan_grants_csv(spark, path))
    return _items_as_text(merged)


def _config_tree(spark, sf):
    path = shared_dir(spark, "config-trees")
    one = F.struct(F.array(F.struct(F.col("key").alias("name"), "value")).alias("items"))
    group = F.struct(F.col("role_group").alias("name"), one.alias("config"))
    service = F.struct(
        F.col("service").alias("name"),
        F.when(F.col("scope") == "service", one).alias("config"),
        F.when(F.col("scope") == "role_group", F.array(group)).alias("roleConfigGroups"),
    )
    cluster = F.struct(F.col("cluster").alias("name"), F.array(service).alias("services"))
    d.config_items(spark, sf).select(F.array(cluster).alias("clusters")).write.json(path)
    return sources.scan_config_tree(spark, path, lines=True)


def _config_scopes(spark, sf):
    path = shared_dir(spark, "config-scopes")
    own = F.struct(F.col("key").alias("name"), "value")
    place = F.struct(F.lit("path").alias("name"), F.col("value"))

    def settings(*items: Column) -> Column:
        return F.struct(F.array(*items).alias("items")).alias("config")

    def group(name: str) -> Column:
        return F.array(F.struct(F.lit(name).alias("name"), settings(own, place)))

    service = F.struct(
        F.col("service").alias("name"), settings(own, place), group("rg").alias("roleConfigGroups")
    )
    cluster = F.struct(F.col("cluster").alias("name"), F.array(service).alias("services"))
    d.config_items(spark, sf).select(
        F.array(cluster).alias("clusters"),
        F.struct(settings(own)).alias("manager"),
        F.struct(settings(place, own), group("mrg").alias("roleConfigGroups")).alias("management"),
    ).write.json(path)
    return sources.scan_config_tree(spark, path, lines=True)


def _object_files(spark, sf):
    path = shared_dir(spark, "objects")
    d.table(spark, sf, "orders").select(
        "o_orderstatus", F.concat("o_orderpriority", F.lit("x")).alias("value")
    ).write.partitionBy("o_orderstatus").text(f"{path}/in")
    found = sources.scan_object_listing(spark, path, "in/o_orderstatus=")
    folder = F.substring_index("key", "/", 2)
    return found.groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"))


def _service_lists(spark, sf):
    path = shared_dir(spark, "service-lists")
    rows = d.services(spark, sf).groupBy(F.floor(F.col("ord") / 50).alias("page"))
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "service"))),
        lambda s: F.struct(s["service"].alias("name")),
    )
    rows.agg(items.alias("items")).select("items").write.json(path)
    return sources.scan_services(spark, path, lines=True).select(
        "service", F.col("ord.pos").alias("place")
    )


# --- ordering ---------------------------------------------------------------------------


def _chunks(spark, sf):
    return ordering.chunk_rows(
        d.import_results(spark, sf).select("index", "status"), 100, ["index"], by=["status"]
    )


def _index(spark, sf):
    unnamed = d.import_results(spark, sf).select(
        F.col("index").alias("o_orderkey"),
        F.when(F.col("status").isNotNull(), F.col("name")).alias("name"),
    )
    return ordering.with_index(unnamed, ["o_orderkey"], name_col="name")


def _first(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ordering.first_per_key(orders, ["o_custkey"], "o_orderkey")


def _pages(spark, sf):
    done = d.import_results(spark, sf)
    more = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("index"))
    return ordering.concat_pages(done, more).select("index", "name", "status")


# --- objects and rows -------------------------------------------------------------------


def _folders(layout: str) -> Query:
    def run(spark, sf):
        if layout == "flat":
            out = objects.expired_folders(d.object_listing(spark, sf), d.NOW_OBJECTS)
        else:
            out = objects.expired_folders(
                d.clustered_listing(spark, sf),
                d.NOW_OBJECTS,
                layout="clustered",
                cluster="c0",
                node="psqld3",
            )
        return out.select("folder", _ms("folder_ts"), "n_objects")

    return run


def _retention_plan(spark, sf):
    return plans.retention_plan(d.object_listing(spark, sf), d.NOW_OBJECTS, batch=5)


def _parse_keys(spark, sf):
    at = fn.parse_object_key(F.col("key"))
    return (
        d.object_listing(spark, sf)
        .select("key", at.alias("at"))
        .select(
            "key",
            "at.folder",
            F.date_format("at.folder_ts", "yyyy-MM-dd").alias("folder_day"),
            "at.n_parts",
        )
    )


def _backup(kind: str, date_match: str = "basename_compact") -> Query:
    return lambda spark, sf: objects.select_backup_objects(
        d.backup_listing(spark, sf),
        cluster="c1",
        instance="psqld1",
        kind=kind,
        date=d.BACKUP_DATE,
        date_match=date_match,
    )


def _backup_of_today(spark, sf):
    """Without a date, from a listing whose backups of one day are moved to today."""
    then, today = F.lit(d.BACKUP_DATE), F.current_date().cast("string")
    moved = d.backup_listing(spark, sf).withColumn("key", F.replace("key", then, today))
    chosen = objects.select_backup_objects(moved, cluster="c1", instance="psqld1", kind="WAL")
    return chosen.select(*[F.replace(c, today, then).alias(c) for c in ("key", "target")])


def _endpoints(spark, sf):
    rules = [("contains", "ATB", "virginia"), ("contains", "AVB", "texas")]
    return objects.endpoint_for(d.clusters(spark, sf), rules, missing="null")


def _split_rows(spark, sf):
    events = d.table(spark, sf, "events").select("event_id", "ts")
    past, kept = retention.split_by_retention(events, "ts", d.NOW_ROWS)
    return (
        past.withColumn("part", F.lit("delete"))
        .unionByName(kept.withColumn("part", F.lit("keep")))
        .select("event_id", "part")
    )


def _delete_counts(spark, sf):
    events = d.table(spark, sf, "events").select("ts")
    millis = d.table(spark, sf, "events").select(
        F.expr("datediff(ts, DATE'1970-01-01') * 86400000L + hour(ts) * 3600000L "
               "+ minute(ts) * 60000L + second(ts) * 1000L").alias("sample_date")
    )
    return retention.retention_delete_counts(
        {"actions": (events, "ts", "timestamp"), "history": (millis, "sample_date", "ms")},
        d.NOW_ROWS,
    )


# --- configuration ----------------------------------------------------------------------


def _scope_maps(spark, sf):
    out = configs.config_updates_by_scope(d.config_items(spark, sf))
    keys = F.array_sort(F.map_keys("updates"))
    values = F.array_distinct(F.map_values("updates"))
    return out.select(
        *configs.SCOPE, _joined(keys).alias("keys"), _joined(values).alias("new_values")
    )


def _password_keys(spark, sf):
    return d.config_items(spark, sf).select(
        "key",
        fn.is_password_key(F.col("key")).alias("wide"),
        fn.is_password_key(F.col("key"), wide=False).alias("narrow"),
    )


def _normalized(spark, sf):
    return d.services(spark, sf).select(
        "ord", fn.normalize_service_name(F.col("service")).alias("service_key")
    )


def _rotation(spark, sf):
    return configs.rotation_targets(d.services(spark, sf), configs.rotation_mapping(spark))


def _reports_manager(spark, sf):
    roles = d.table(spark, sf, "customer").selectExpr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'REPORTSMANAGER' ELSE c_mktsegment END AS type"
    )
    return configs.reports_manager_target(roles)


# --- profile, copies, streams -----------------------------------------------------------


def _copy(spark, sf):
    d.table(spark, sf, "orders").createOrReplaceTempView("opsframe_copy_source")
    name = "opsframe_copy_" + shared_dir(spark, "x")[-12:]
    plans.copy_table(
        spark, "opsframe_copy_source", name, path=shared_dir(spark, "copied-table")
    )
    return _with_days(sources.scan_table(spark, name), "o_orderdate")


def _sample(spark, sf):
    lines = d.table(spark, sf, "lineitem")
    sample = ordering.sample_rows(lines, 0.01, ["l_orderkey", "l_linenumber"], seed=7)
    return _with_days(sample, "l_shipdate")


def _with_days(df: DataFrame, *days: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in days})


def _stream(spark: SparkSession, sf: str) -> str:
    out, state = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-checkpoint")
    lines = sources.stream_log_lines(spark, d.log_files(spark, sf))
    streaming.stream_compile_records(lines, out, state).awaitTermination()
    return out


def _stream_records(spark, sf):
    records = spark.read.parquet(f"{_stream(spark, sf)}/records").drop("batch", "source_log")
    return _with_times(records, "start_ts", "end_ts")


def _stream_hours(spark, sf):
    records = streaming.record_stream(spark, _stream(spark, sf))
    path = shared_dir(spark, "hours")

    def keep(hours: DataFrame, batch: int) -> None:
        hours.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(
            f"{path}/part={batch}"
        )

    query = (
        streaming.stream_compile_stats_by_hour(records)
        .writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", shared_dir(spark, "hours-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # Each batch writes the hours that it changed; the last state of an hour counts.
    states = spark.read.parquet(f"{path}/*")
    return ordering.first_per_key(states, ["hour"], "batch", last=True).drop("batch")


def _stream_open(spark, sf):
    out, state = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-checkpoint")
    lines = sources.stream_log_lines(spark, d.log_files(spark, sf))
    streaming.stream_compile_records(lines, out, state, ttl_s=6 * 3600).awaitTermination()
    path = shared_dir(spark, "expired")
    query = (
        streaming.stream_unfinished(spark, out)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", shared_dir(spark, "expired-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _with_times(spark.read.parquet(path).drop("source_log"), "start_ts")


def all_queries() -> dict[str, Query]:
    return {
        # logs
        "classify_log_lines": _classify,
        "pair_compile_events": _pair,
        "with_compile_flags": lambda s, sf: _records(s, sf).select(
            "query_id", "compile_time_ms", "union_count", "slow_compile", "excessive_unions"
        ),
        "unfinished_queries": lambda s, sf: _with_times(
            logs.unfinished_queries(_events(s, sf)), "start_ts"
        ),
        "compile_stats_by_user": lambda s, sf: logs.compile_stats_by_user(_records(s, sf)),
        "compile_stats_by_hour": lambda s, sf: logs.compile_stats_by_hour(_records(s, sf)),
        "log_parse_quality": lambda s, sf: logs.log_parse_quality(_events(s, sf)),
        "write_csv": _csv,
        "compile_log_report_per_user": _report("per_user"),
        "compile_log_report_per_hour": _report("per_hour"),
        "compile_log_report_quality": _report("quality"),
        "write_summary_json_per_user": _summary("per_user"),
        "write_summary_json_per_hour": _summary("per_hour"),
        "scan_log_lines": _scan_lines,
        "count_union_all": _documents(_count_unions, "n_unions"),
        "truncate_query": _documents(fn.truncate_query, "query"),
        "strip_ws": _documents(
            lambda t: fn.strip_ws(F.concat(F.lit("\t\xa0 \n"), t, F.lit("\r\n  "))), "stripped"
        ),
        # workload
        "flatten_query_records": _flatten,
        "scan_query_records": _scan_records,
        "filter_lookback": _lookback,
        "filter_min_duration": _on_flat(
            lambda f: w.filter_min_duration(f).select("query_id", "duration_s")
        ),
        "filter_queue_or_slow": _on_flat(
            lambda f: w.filter_queue_or_slow(f).select("query_id", "duration_s")
        ),
        "label_queries": _on_flat(
            lambda f: w.label_queries(f).select("query_id", "spilled_label", "stats_label")
        ),
        "bottleneck_overview": _on_flat(w.bottleneck_overview),
        "top_slow_queries": _on_flat(w.top_slow_queries),
        "workload_by_user": _on_flat(w.workload_by_user),
        "queue_congestion": _on_flat(w.queue_congestion),
        "queue_by_coordinator": _on_flat(w.queue_by_coordinator),
        "queue_by_pool": _on_flat(w.queue_by_pool),
        "workload_total": _on_flat(w.workload_total),
        "cap_records": _on_flat(lambda f: w.cap_records(f, 5000).select("query_id")),
        "workload_report_bottlenecks": _workload_part("bottlenecks"),
        "workload_report_users": _workload_part("users"),
        "workload_report_total": _workload_part("total"),
        "workload_report_slowest": _workload_part("slowest"),
        "workload_report_congestion": _workload_part("congestion"),
        "queue_report_coordinators": _queue_part("coordinators"),
        "queue_report_pools": _queue_part("pools"),
        # metastore
        "column_counts": lambda s, sf: catalog.column_counts(d.metastore(s, sf)),
        "partition_counts": lambda s, sf: catalog.partition_counts(d.metastore(s, sf)),
        "table_inventory": lambda s, sf: catalog.table_inventory(d.metastore(s, sf)),
        "inventory_report": lambda s, sf: plans.inventory_report(d.metastore(s, sf)),
        "table_inventory_of_databases": lambda s, sf: catalog.table_inventory(
            d.metastore(s, sf), dbs=["NATION_1", "NATION_7"]
        ),
        "scan_metastore": _metastore_files,
        "partition_key_mismatch": lambda s, sf: catalog.partition_key_mismatch(
            d.metastore(s, sf)
        ),
        # policies
        "rewrite_policy_urls_all": _urls("all"),
        "rewrite_policy_urls_matched": _urls("matched"),
        "policy_change_log": _change_log,
        "policy_change_count": lambda s, sf: pol.policy_change_count(d.policies(s, sf)),
        "roles_to_groups": _roles_entries,
        "roles_to_groups_items": _roles_items,
        "merge_grants": _merge,
        "unmatched_grants": _unmatched,
        "plan_policy_upsert": _upsert(False),
        "plan_policy_upsert_override": _upsert(True),
        "policy_upsert_report": _upsert_report,
        "import_outcome_summary": lambda s, sf: pol.import_outcome_summary(_outcomes(s, sf)),
        "import_failures": lambda s, sf: pol.import_failures(_outcomes(s, sf)),
        "import_failures_all": lambda s, sf: pol.import_failures(_outcomes(s, sf), k=None),
        "parse_permissions": _permissions,
        "page_completeness": _page_completeness,
        "migrate_policies": _migrate,
        "migrate_policies_documents": _migrate_files,
        "whole_policy_documents": _whole_policies,
        "whole_role_pages": _whole_roles,
        "map_documents": _map_documents,
        "scan_policy_list": _policy_files,
        "scan_documents": _policy_pages,
        "scan_policy_map": _policy_map,
        "scan_document_pages": _document_pages,
        "scan_grants_csv": _grants_csv,
        "chunk_rows": _chunks,
        "with_index": _index,
        "first_per_key": _first,
        "concat_pages": _pages,
        # objects and rows
        "scan_object_listing": _object_files,
        "scan_parquet": lambda s, sf: sources.scan_parquet(s, f"{sf}/customer.parquet"),
        "expired_folders": _folders("flat"),
        "expired_folders_clustered": _folders("clustered"),
        "retention_plan": _retention_plan,
        "parse_object_key": _parse_keys,
        "select_backup_objects_filesystem": _backup("Filesystem"),
        "select_backup_objects_sql": _backup("SQL"),
        "select_backup_objects_sql_by_key": _backup("SQL", "key_iso"),
        "select_backup_objects_wal": _backup("WAL"),
        "select_backup_objects_today": _backup_of_today,
        "endpoint_for": _endpoints,
        "split_by_retention": _split_rows,
        "retention_delete_counts": _delete_counts,
        # configuration
        "config_change_plan": lambda s, sf: plans.config_change_plan(d.config_items(s, sf)),
        "scan_config_tree": _config_tree,
        "scan_config_tree_scopes": _config_scopes,
        "scan_services": _service_lists,
        "config_updates_by_scope": _scope_maps,
        "is_password_key": _password_keys,
        "normalize_service_name": _normalized,
        "normalized_service_groups": lambda s, sf: configs.normalized_service_groups(
            d.services(s, sf)
        ),
        "rotation_targets": _rotation,
        "reports_manager_target": _reports_manager,
        # profile, copies, streams
        "max_string_lengths": lambda s, sf: profile.max_string_lengths(
            d.table(s, sf, "documents")
        ),
        "dataset_profile": lambda s, sf: profile.dataset_profile(d.table(s, sf, "conversations")),
        "sample_rows": _sample,
        "copy_table": _copy,
        "stream_compile_records": _stream_records,
        "stream_compile_stats_by_hour": _stream_hours,
        "stream_unfinished": _stream_open,
    }
