import json

from opsframe import plans, sources
from opsframe.operators import configs, profile

SECRET = "hunter2"


def tree(tmp_path):
    def items(*names):
        return {"items": [{"name": n, "value": SECRET} for n in names]}

    document = {
        "clusters": [
            {
                "name": "c1",
                "services": [
                    {
                        "name": "s1",
                        "config": items("ssl_server_keystore_password", "port", ""),
                        "roleConfigGroups": [
                            {"name": "g1", "config": items("x.ssl_private_key_password")},
                            {"name": "g2", "config": items("port")},
                        ],
                    },
                    {"name": "s2", "config": {"items": []}},
                ],
            }
        ],
        "manager": {"config": items("KEYSTORE_PASSWORD")},
        "management": {
            "config": items("keystore_path"),
            "roleConfigGroups": [{"name": "g9", "config": items("keystore_password", "k")}],
        },
    }
    path = tmp_path / "tree.json"
    path.write_text(json.dumps(document))
    return str(path)


def test_tree_has_all_scopes(spark, tmp_path):
    rows = sources.scan_config_tree(spark, tree(tmp_path)).collect()
    assert sorted({r["scope"] for r in rows}) == [
        "management_role_group",
        "management_service",
        "manager",
        "role_group",
        "service",
    ]
    assert len(rows) == 8
    group = [r for r in rows if r["role_group"] == "g1"][0]
    assert (group["cluster"], group["service"], group["key"]) == (
        "c1",
        "s1",
        "x.ssl_private_key_password",
    )


def test_change_plan_never_shows_a_secret(spark, tmp_path):
    items = sources.scan_config_tree(spark, tree(tmp_path))
    plan = plans.config_change_plan(items).collect()
    assert sorted((r["scope"], r["key"]) for r in plan) == [
        ("management_role_group", "keystore_password"),
        ("manager", "KEYSTORE_PASSWORD"),
        ("role_group", "x.ssl_private_key_password"),
        ("service", "ssl_server_keystore_password"),
    ]
    assert {(r["new_value"], r["action"]) for r in plan} == {("***", "would_update")}
    assert SECRET not in str(plan)
    narrow = plans.config_change_plan(items, wide=False, dry_run=False)
    assert {r["action"] for r in narrow.collect()} == {"update"} and narrow.count() == 3
    scopes = configs.config_updates_by_scope(items).collect()
    assert len(scopes) == 4 and SECRET not in str(scopes)


def test_a_large_scope_is_one_map(spark):
    keys = [("service", "c", "s", None, f"keystore_password_{i}", "v") for i in range(2500)] * 2
    items = spark.createDataFrame(
        keys,
        "scope STRING, cluster STRING, service STRING, role_group STRING, key STRING, value STRING",
    )
    maps = configs.config_updates_by_scope(items).collect()
    assert [len(r["updates"]) for r in maps] == [2500]


def test_rotation(spark, tmp_path):
    path = tmp_path / "services.json"
    names = ["HIVE-1", "hive_2", "nifi-3", "oozie", "unknown"]
    path.write_text(json.dumps({"items": [{"name": n} for n in names]}))
    services = sources.scan_services(spark, str(path))
    groups = configs.normalized_service_groups(services).orderBy("service_key", "position")
    assert [(r["service_key"], r["service"]) for r in groups.collect()][:2] == [
        ("hive", "HIVE-1"),
        ("hive", "hive_2"),
    ]
    rows = configs.rotation_targets(services, configs.rotation_mapping(spark)).collect()
    assert sorted((r["service"], r["level"], r["role_group"]) for r in rows) == [
        ("HIVE-1", "service", None),
        ("nifi-3", "role_group", "nifi-NIFI_NODE-BASE"),
        ("oozie", "role_group", "oozie-OOZIE_SERVER-BASE"),
    ]


def test_reports_manager(spark):
    ddl = "type STRING"
    some = spark.createDataFrame([("X",), ("REPORTSMANAGER",), ("REPORTSMANAGER",)], ddl)
    assert configs.reports_manager_target(some).count() == 1
    none = spark.createDataFrame([("X",)], ddl)
    assert configs.reports_manager_target(none).count() == 0


def test_profile(spark):
    rows = [("a", "éé", None, 1), ("abc", "x", None, 2)]
    frame = spark.createDataFrame(rows, "`a.b` STRING, c STRING, empty STRING, n INT")
    assert profile.column_summary(frame) == {"total_columns": 4, "string_columns": 3}
    found = profile.max_string_lengths(frame)
    assert [tuple(r) for r in found.collect()] == [("a.b", 3), ("c", 2), ("empty", None)]
    assert profile.max_string_lengths(frame, k=1).count() == 1
    assert profile.max_string_lengths(frame, fraction=0.5, seed=1).count() == 3
    assert profile.max_string_lengths(spark.range(3)).count() == 0
    assert profile.dataset_profile(frame).first()["total_columns"] == 4
