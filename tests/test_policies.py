import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opsframe import plans, sinks, sources
from opsframe.operators import policies as pol
from opsframe.schemas import POLICY_DDL, ROLE_DDL

LETTERS = {"r": "read", "w": "write", "x": "execute"}


def policy(name="p", service="cm_hive", urls=None, items=None, id=1):
    resources = None if urls is None else {"url": {"values": urls}}
    return {
        "id": id,
        "name": name,
        "service": service,
        "resources": resources,
        "policyItems": items,
    }


def item(groups=None, roles=None, accesses=()):
    return {
        "groups": groups,
        "roles": roles,
        "users": [],
        "accesses": [{"type": a, "isAllowed": True} for a in accesses],
        "delegateAdmin": False,
    }


def frame(spark, *policies):
    text = [(json.dumps(p),) for p in policies]
    parsed = spark.createDataFrame(text, "t STRING").select(
        F.from_json("t", POLICY_DDL).alias("p")
    )
    return parsed.select("p.*")


def urls_after(spark, values, mode, service="cm_hive"):
    out = pol.rewrite_policy_urls(frame(spark, policy(urls=values, service=service)), mode=mode)
    return out.first()["resources"]["url"]["values"]


@pytest.mark.parametrize(
    "values, every, matched",
    [
        (["/x/y.db"], ["/x/y"], ["/x/y.db"]),
        (["/schemas/a.db", "/datafiles/a"], ["/datafiles/a"] * 2, ["/datafiles/a"]),
        (["/b", "/a", "/a"], ["/b", "/a", "/a"], ["/b", "/a", "/a"]),
        (["/schemas/schemas/x"], ["/datafiles/schemas/x"], ["/datafiles/schemas/x"]),
        (["/z", "/schemas/b"], ["/z", "/datafiles/b"], ["/datafiles/b", "/z"]),
        (["/a.db.db"], ["/a.db"], ["/a.db.db"]),
        ([], [], []),
    ],
)
def test_url_rewrite(spark, values, every, matched):
    assert urls_after(spark, values, "all") == every
    assert urls_after(spark, values, "matched") == matched
    assert urls_after(spark, values, "all", "cm_hdfs") == values


def test_other_resources_and_missing_ones_stay(spark):
    both = policy()
    both["resources"] = {"path": {"values": ["/schemas/a.db"]}}
    rows = pol.rewrite_policy_urls(frame(spark, both, policy())).collect()
    assert rows[0]["resources"]["path"]["values"] == ["/schemas/a.db"]
    assert rows[1]["resources"] is None


def test_change_log(spark):
    policies = frame(
        spark,
        policy("a", urls=["/schemas/x.db"]),
        policy("b", urls=["/x/y.db"]),
        policy("c", "cm_hdfs", urls=["/schemas/x"]),
        policy("d"),
    )
    rows = [tuple(r) for r in pol.policy_change_log(policies).collect()]
    assert rows == [("a", ["/schemas/x.db"], ["/datafiles/x"])]
    assert pol.policy_change_count(policies).first()[0] == 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        pol.rewrite_policy_urls(frame(spark, policy()), mode="some")


def test_roles_move_into_groups(spark):
    policies = frame(
        spark, policy(items=[item(["b"], ["a", "b"]), item()]), policy(items=None), policy(items=[])
    )
    rows = pol.roles_to_groups_items(policies).collect()
    assert [(i["groups"], i["roles"]) for i in rows[0]["policyItems"]] == [
        (["a", "b"], []),
        ([], []),
    ]
    assert rows[1]["policyItems"] is None and rows[2]["policyItems"] == []
    entry = spark.range(1).select(F.array(F.lit("r")).alias("roles"))
    moved = pol.roles_to_groups(entry).first()
    assert (moved["groups"], moved["roles"]) == (["r"], [])


def fold(policies, grants):
    """The grants one by one, as a person would apply them."""
    result = {p["name"]: json.loads(json.dumps(p)) for p in policies}
    for _, name, group, letters in sorted(grants):
        if name not in result or result[name]["service"] != "cm_hdfs":
            continue
        wanted = list(dict.fromkeys(LETTERS[c] for c in letters if c in LETTERS))
        items = result[name]["policyItems"] = result[name]["policyItems"] or []
        for one in items:
            if group in (one["groups"] or []):
                have = {a["type"] for a in one["accesses"]}
                one["accesses"] += [
                    {"type": w, "isAllowed": True} for w in wanted if w not in have
                ]
                break
        else:
            new = item([group], None, wanted)
            items.append(new)
    return result


@pytest.mark.parametrize("seed", range(5))
def test_grants_equal_a_fold_with_a_hot_policy(spark, seed):
    rng = random.Random(seed)
    groups = [f"g{i}" for i in range(6)]
    policies = [
        policy(
            f"p{i}",
            rng.choice(["cm_hdfs", "cm_hdfs", "cm_hive"]),
            items=rng.choice([None, []])
            if i % 5 == 0
            else [
                item(
                    rng.choice([None, rng.sample(groups, rng.randrange(3))]),
                    None,
                    rng.sample(list(LETTERS.values()), rng.randrange(3)),
                )
                for _ in range(rng.randrange(4))
            ],
            id=i,
        )
        for i in range(20)
    ]
    grants = [
        (
            i,
            "p1" if rng.random() < 0.35 else f"p{rng.randrange(24)}",
            rng.choice(groups),
            "".join(rng.choice("rwxq-") for _ in range(rng.randrange(4))),
        )
        for i in range(300)
    ]
    rows = spark.createDataFrame(
        grants, "row_no BIGINT, policy_name STRING, group_name STRING, permissions STRING"
    ).repartition(5)
    merged = pol.merge_grants(frame(spark, *policies), rows).collect()
    assert len(merged) == len(policies)

    def shape(items):
        if items is None:
            return None
        return [
            (i["groups"], [(a["type"], a["isAllowed"]) for a in i["accesses"]], i["delegateAdmin"])
            for i in items
        ]

    wanted = fold(policies, grants)
    for row in merged:
        assert shape(row["policyItems"]) == shape(wanted[row["name"]]["policyItems"]), row["name"]
    known = {p["name"] for p in policies if p["service"] == "cm_hdfs"}
    left = pol.unmatched_grants(frame(spark, *policies), rows).count()
    assert left == sum(g[1] not in known for g in grants)


def test_grants_on_two_groups_of_one_item(spark):
    target = frame(spark, policy(service="cm_hdfs", items=[item(["a", "b"], None, [])]))
    rows = spark.createDataFrame(
        [(1, "p", "a", "w"), (2, "p", "b", "w"), (3, "p", "n", "r"), (4, "p", "n", "w")],
        "row_no BIGINT, policy_name STRING, group_name STRING, permissions STRING",
    )
    items = pol.merge_grants(target, rows).first()["policyItems"]
    assert [[a["type"] for a in i["accesses"]] for i in items] == [["write"], ["read", "write"]]
    assert (items[1]["groups"], items[1]["users"], items[1]["roles"]) == (["n"], [], None)


def upsert(spark, override):
    incoming = spark.createDataFrame(
        [(1, "s", "new"), (2, "s", "new"), (3, "s", "held"), (4, "s", "no id"), (5, "t", "held")],
        "ord INT, service STRING, name STRING",
    )
    existing = spark.createDataFrame(
        [(2, "s", "held", 11), (1, "s", "held", 10), (3, "s", "no id", None)],
        "ord INT, service STRING, name STRING, id BIGINT",
    )
    plan = pol.plan_policy_upsert(incoming, existing, override).orderBy("ord").collect()
    report = plans.policy_upsert_report(incoming, existing, override, batch=2)
    return [(r["action"], r["target_id"]) for r in plan], report.orderBy("chunk_id").collect()


def test_upsert_plan(spark):
    plan, report = upsert(spark, override=False)
    assert [action for action, _ in plan] == ["create", "fail", "fail", "fail", "create"]
    assert {target for _, target in plan} == {None}
    assert [tuple(r) for r in report] == [(0, 1, 1), (1, 0, 2), (2, 1, 0)]
    plan, _ = upsert(spark, override=True)
    assert [action for action, _ in plan] == ["create", "update", "update", "fail", "create"]
    assert [target for _, target in plan] == [None, None, 10, None, None]


def test_import_outcomes(spark):
    results = spark.createDataFrame(
        [(3, 500), (1, 200), (2, None), (4, 201)], "index INT, status INT"
    )
    roles = pol.import_outcomes(results)
    assert tuple(pol.import_outcome_summary(roles).first()) == (1, 3)
    assert [r["index"] for r in pol.import_failures(roles, 2).collect()] == [2, 3]
    assert pol.import_failures(roles, None).count() == 3
    policies = pol.import_outcomes(results, pol.POLICY_OK)
    assert tuple(pol.import_outcome_summary(policies).first()) == (2, 2)


def test_page_completeness(spark):
    row = pol.page_completeness(spark.range(401), 401).first()
    assert tuple(row) == (401, 401, 3, True)


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


ROLE = {"id": 7, "name": "r1", "users": [{"name": "u", "isAdmin": False}]}


@pytest.mark.parametrize(
    "document, names",
    [
        ({"vList": [ROLE]}, ["r1"]),
        ({"roles": [ROLE, {"name": "r2"}]}, ["r1", "r2"]),
        ([ROLE], ["r1"]),
        ({"vList": [], "roles": [ROLE]}, []),
        ({"roles": [{"name": "a"}], "vList": [ROLE]}, ["r1"]),
        ([], []),
    ],
)
def test_envelopes(spark, tmp_path, document, names):
    roles = sources.scan_documents(spark, put(tmp_path, "roles.json", document))
    assert [r["name"] for r in roles.orderBy("ord").collect()] == names
    assert "id" not in pol.drop_document_id(roles).columns


@pytest.mark.parametrize("text", ['{"other": []}', "not json"])
def test_no_document_list_is_an_error(spark, tmp_path, text):
    with pytest.raises(Exception, match="no document list"):
        sources.scan_documents(spark, put(tmp_path, "x.json", text)).collect()


def test_pages(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    put(tmp_path / "pages", "1.json", '{"vList": [{"name": "a"}, {"name": "b"}]}\n[{"name": "c"}]')
    put(tmp_path / "pages", "2.json", '{"vList": []}\n{}')
    roles = sources.scan_document_pages(spark, str(tmp_path / "pages"))
    assert [r["name"] for r in roles.orderBy("ord").collect()] == ["a", "b", "c"]


def test_policy_list(spark, tmp_path):
    path = put(tmp_path, "p.json", json.dumps([policy("a"), policy("b")], indent=2))
    rows = sources.scan_policy_list(spark, path).orderBy("ord").collect()
    assert [r["name"] for r in rows] == ["a", "b"]
    with pytest.raises(Exception, match="expected a list"):
        sources.scan_policy_list(spark, put(tmp_path, "o.json", "{}")).collect()


def test_policy_map_keeps_the_last_of_a_repeated_key(spark, tmp_path):
    text = '{"k1": {"name": "a"}, "k2": {"name": "b"}, "k1": {"name": "c"}}'
    rows = sources.scan_policy_map(spark, put(tmp_path, "m.json", text)).orderBy("ord").collect()
    assert [r["name"] for r in rows] == ["c", "b"]


def test_grants_csv_goes_by_column_name(spark, tmp_path):
    path = put(tmp_path, "g.csv", "group_name,policy_name,permissions\ng,p,rw\nh,p,x\n")
    rows = sources.scan_grants_csv(spark, path).orderBy("row_no").collect()
    assert [(r["policy_name"], r["group_name"], r["permissions"]) for r in rows] == [
        ("p", "g", "rw"),
        ("p", "h", "x"),
    ]


def test_documents_round_trip(spark, tmp_path):
    policies = frame(spark, *[policy(f"p{i}", id=i) for i in range(5)])
    placed = policies.withColumn("ord", F.col("id"))
    sinks.write_documents_json(placed, str(tmp_path / "lines"))
    lines = "".join(p.read_text() for p in (tmp_path / "lines").glob("*.json")).splitlines()
    assert json.loads(lines[0])["policyItems"] is None and "ord" not in json.loads(lines[0])
    assert sources.scan_policy_list(spark, str(tmp_path / "lines"), lines=True).count() == 5

    sinks.write_documents_json(placed, str(tmp_path / "pages"), envelope="vList", page_size=2)
    pages = [
        json.loads(line)
        for p in (tmp_path / "pages").glob("*.json")
        for line in p.read_text().splitlines()
    ]
    assert sorted([d["name"] for d in p["vList"]] for p in pages) == [
        ["p0", "p1"],
        ["p2", "p3"],
        ["p4"],
    ]


def test_migrations_apply_in_turn(spark):
    policies = frame(spark, policy(urls=["/schemas/a.db"], items=[item(["g"], ["r"])]))
    row = plans.migrate_policies(policies, ["urls_all", "item_roles"]).first()
    assert row["resources"]["url"]["values"] == ["/datafiles/a"]
    assert row["policyItems"][0]["groups"] == ["g", "r"]
    with pytest.raises(ValueError):
        plans.migrate_policies(policies, "rename")


@pytest.mark.parametrize("text", ['[{"name": "a"', '[{"name": "a"}, 5'])
def test_a_broken_list_is_an_error(spark, folder, text):
    Path(folder("broken.json")).write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        sources.scan_policy_list(spark, folder("broken.json")).collect()


def test_grants_reach_one_of_two_services_that_share_a_name(spark):
    item = "array(named_struct('accesses', array(named_struct('type', 'read', 'isAllowed', true)), 'groups', array({})))"
    both = spark.sql(
        f"SELECT 1L AS id, 'x' AS name, 'cm_hdfs' AS service, {item.format(chr(39) + 'g' + chr(39))} AS policyItems"
        f" UNION ALL SELECT 2L, 'x', 'other', {item.format(chr(39) + 'h' + chr(39))}"
    )
    grants = spark.createDataFrame([(1, "x", "g", "w")], "row_no INT, policy_name STRING, group_name STRING, permissions STRING")
    merged = {r["service"]: r["policyItems"] for r in pol.merge_grants(both, grants).collect()}
    assert [a["type"] for a in merged["cm_hdfs"][0]["accesses"]] == ["read", "write"]
    assert [(i["groups"], len(i["accesses"])) for i in merged["other"]] == [(["h"], 1)]


def test_fields_that_no_operator_knows_survive(spark, tmp_path):
    known = {"id": 1, "name": "x", "service": "cm_hive", "policyItems": []}
    rest = {"isEnabled": True, "denyPolicyItems": [{"groups": ["g"]}], "guid": "}, {\"", "validity": {}}
    docs = [{**known, **rest}, {"id": 2, "name": "y"}, {"policyType": 0}, {}]
    path = put(tmp_path, "whole.json", json.dumps(docs))
    scanned = sources.scan_policy_list(spark, path)
    for i, rows in enumerate([scanned, None]):
        if rows is None:
            rows = sources.scan_policy_list(spark, str(tmp_path / "out0"), lines=True)
        sinks.write_documents_json(rows, str(tmp_path / f"out{i}"))
        lines = [
            json.loads(line)
            for part in sorted((tmp_path / f"out{i}").glob("part-*"))
            for line in part.read_text().splitlines()
        ]
        assert sorted(lines, key=str) == sorted(docs, key=str)


def lines_of(folder):
    return [
        json.loads(line)
        for part in sorted(folder.glob("part-*"))
        for line in part.read_text().splitlines()
    ]


WHOLE = {
    "id": 7,
    "name": "x",
    "service": "cm_hive",
    "labels": {"a": [{"b": None}, 2.5]},
    "resources": {
        "url": {"values": ["/schemas/t.db"], "isExcludes": False, "zzz": {"deep": [1]}},
        "path": {"values": [], "more": None},
    },
    "policyItems": [
        {
            "accesses": [{"type": "read", "isAllowed": True, "why": {"by": ["me"]}}],
            "groups": ["g"],
            "roles": ["r"],
            "conditions": [{"type": "t", "values": ["v"], "extra": 1}],
            "validity": {"from": 1},
        },
        {"users": ["u"], "groups": ["h"], "note": None},
    ],
}


def test_nested_fields_survive_edits_from_file_to_file(spark, tmp_path):
    path = put(tmp_path, "whole.json", json.dumps([WHOLE, {"name": None, "resources": None}]))
    policies = sources.scan_policy_list(spark, path)
    migrated = plans.migrate_policies(policies, ["urls_matched", "item_roles"])
    grants = spark.createDataFrame(
        [(1, "x", "g", "rw"), (2, "x", "new", "x")],
        "row_no INT, policy_name STRING, group_name STRING, permissions STRING",
    )
    merged = pol.merge_grants(migrated, grants, service="cm_hive")
    sinks.write_documents_json(pol.drop_document_id(merged), str(tmp_path / "out"))
    wanted = json.loads(json.dumps(WHOLE))
    del wanted["id"]
    wanted["resources"]["url"]["values"] = ["/datafiles/t"]
    first, second = wanted["policyItems"]
    first["groups"], first["roles"], second["roles"] = ["g", "r"], [], []
    first["accesses"].append({"type": "write", "isAllowed": True})
    added = {"accesses": [{"type": "execute", "isAllowed": True}], "groups": ["new"], "users": []}
    wanted["policyItems"].append({**added, "delegateAdmin": False})
    found = lines_of(tmp_path / "out")
    assert sorted(found, key=len) == [{"name": None, "resources": None}, wanted]


@pytest.mark.parametrize("kind", ["vList", "roles", "list", "map", "page"])
def test_roles_and_maps_keep_every_field(spark, tmp_path, kind):
    docs = [
        {"id": 1, "name": "a", "users": [{"name": "u", "isAdmin": True, "since": {"y": [1]}}], "x": {"y": {"z": 1}}},
        {"id": 2, "name": "b", "groups": [{"name": "g", "k": None}], "createdBy": None},
    ]
    special = {"list": docs, "map": {"a": docs[0], "b": docs[1]}, "page": {"vList": docs}}
    text = special.get(kind, {kind: docs})
    path = put(tmp_path, "in.json", json.dumps(text))
    scan = {"map": sources.scan_policy_map, "page": sources.scan_document_pages}.get(kind, sources.scan_documents)
    rows = scan(spark, path, ddl=ROLE_DDL)
    sinks.write_documents_json(rows, str(tmp_path / "lines"))
    assert sorted(lines_of(tmp_path / "lines"), key=lambda d: d["id"]) == docs
    sinks.write_documents_json(rows, str(tmp_path / "pages"), envelope="vList", page_size=1)
    again = sources.scan_document_pages(spark, str(tmp_path / "pages"))
    sinks.write_documents_json(again, str(tmp_path / "again"))
    assert sorted(lines_of(tmp_path / "again"), key=lambda d: d["id"]) == docs


@pytest.mark.parametrize("page", [{"roles": []}, {"id": 1}])
def test_a_page_without_its_list_is_an_error(spark, tmp_path, page):
    path = put(tmp_path, "page.json", json.dumps({"vList": []}) + "\n" + json.dumps(page))
    with pytest.raises(Exception, match="no document list"):
        sources.scan_document_pages(spark, path).collect()
    assert sources.scan_document_pages(spark, put(tmp_path, "e.json", '{"vList": []}')).count() == 0


def test_the_column_of_the_whole_document_is_reserved(spark, tmp_path):
    with pytest.raises(ValueError, match="doc"):
        sources.scan_documents(spark, str(tmp_path), ddl="doc STRING")
