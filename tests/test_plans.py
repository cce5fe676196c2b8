"""Dry-run plans against sequential models; the registered queries are held against SQL in test_queries."""

import random
import sys

from pyspark.sql import functions as F

from lumaloom.functions import media as M
from lumaloom.operators import planning as P
from lumaloom.operators import rules as R


def sequential(plan, existing):
    """The rules for targets, one operation after another over the whole plan."""
    there, taken, out = {t.casefold(): s for t, s in existing}, {}, {}
    for op_id, target, sha, policy, source, operation, replace in plan:
        if target is None:
            out[op_id] = (None, None, None)
            continue
        key, final, status, coalesced = target.casefold(), target, None, False
        own = source is not None and key == source.casefold()
        if key in taken and taken[key] and taken[key] == sha:
            status, coalesced = "already_satisfied", True
        elif own and replace:
            status = "replace_source"
        elif own and operation in ("copy", "move"):
            status = "already_satisfied"
        elif not own and key not in taken and key not in there:
            status = "ready"
        elif not own and key not in taken and there[key] and there[key] == sha:
            status = "already_satisfied"
        elif policy == "skip":
            status = "skipped"
        elif policy != "rename":
            status = "conflict" if key in taken and not own else "overwrite"
        else:
            head, _, tail = target.rpartition(".")
            number = 1
            while f"{head} ({number}).{tail}".casefold() in {*taken, *there}:
                number += 1
            final, status = f"{head} ({number}).{tail}", "renamed"
        taken.setdefault(final.casefold(), sha)
        out[op_id] = (final, status, coalesced)
    return out


def test_targets_like_one_after_another(spark):
    rng = random.Random(11)
    names = ["a.jpg", "A.jpg", "a (1).jpg", "a (2).JPG", "Straße.png", "STRASSE.png", "b.x.jpg", "b.x (1).jpg"]
    plan = []
    for i in range(600):
        target = None if rng.random() < 0.05 else f"{rng.choice(['x', 'y/z', 'X'])}/{rng.choice(names)}"
        source = target if rng.random() < 0.1 else f"s/{i}.jpg"
        plan.append((i, target, rng.choice(["s", "t", "u", None]), rng.choice(["rename", "rename", "skip", "overwrite"]), source, rng.choice(["copy", "move", "compress"]), rng.random() < 0.5))
    existing = [("x/a.jpg", "s"), ("y/z/a (1).jpg", "t"), ("y/z/STRASSE (1).png", None), ("x/b.x (2).jpg", "q")]
    df = spark.createDataFrame(plan, "op_id long, target string, sha256 string, policy string, source string, operation string, replace boolean")
    got = P.resolve_targets(df, spark.createDataFrame(existing, "target string, sha256 string"))
    assert {r["op_id"]: (r["final"], r["status"], r["coalesced"]) for r in got.collect()} == sequential(plan, existing)
    assert got.columns == [*df.columns, "final", "status", "coalesced"]


def test_casefold_is_full_case_folding(spark):
    """Letters of the languages that file names are written in; a few historic letters differ."""
    chars = [chr(c) for c in range(0x20, 0x0600) if chr(c).isprintable()] + ["Straße", "ΟΔΟΣ", "ﬁn", "İ", "ı", "ÅÄÖ"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", M.casefold(F.col("c")).alias("f")).collect()
    # text that Python folds alike is folded alike
    groups = {}
    for r in rows:
        groups.setdefault(r["c"].casefold(), set()).add(r["f"])
    wrong = {k: v for k, v in groups.items() if len(v) > 1}
    assert not wrong, (wrong, sys.version)
    assert {r["c"]: r["f"] for r in rows}["Straße"] == "strasse"


def files(spark, rows):
    schema = "file_id long, asset_id long, relative_path string, extension string, media_type string, role string, size_bytes long, mtime string, sha256 string, in_scope boolean, is_online boolean, selection_state string"
    return spark.createDataFrame(rows, schema)


def plan_for(spark, rows, rules, analysis=(), profiles=(), copies=(), existing=()):
    a = "file_id long, codec string, contract string, runtime string, sha256 string, size_bytes long, mtime string, status string, error string, mode string, hard_blockers array<string>, width int, height int, duration double, fps double, bit_depth int"
    made = "file_id long, output_path string, output_sha256 string"
    return P.dry_run(files(spark, rows), rules, list(profiles), spark.createDataFrame(list(analysis), a), spark.createDataFrame(list(existing), "target string, sha256 string"), spark.createDataFrame(list(copies), made), spark.createDataFrame([], made))


def row(i, path, **kw):
    base = {"asset_id": i, "ext": "." + path.rsplit(".", 1)[1], "media": "image", "role": "original", "size": 1000, "sha": f"h{i}", "state": "undecided"} | kw
    return (i, base["asset_id"], path, base["ext"], base["media"], base["role"], base["size"], "m", base["sha"], True, True, base["state"])


def test_provenance_alone_makes_a_file_managed(spark):
    rules = [{"rule_id": "src", "position": 1, "match": {"origin": "source"}, "action": {"operation": "copy", "destination_dir": "Out"}}]
    got = plan_for(spark, [row(1, "a.jpg"), row(2, "b.jpg"), row(3, "c.jpg"), row(4, "d.jpg", role="managed_jxl")], rules, copies=[(1, "a.jpg", "h1"), (2, "b.jpg", "other"), (3, "old/c.jpg", "h3"), (1, "a.jpg", "h1")])
    assert sorted(r["file_id"] for r in got.collect()) == [2, 3]


def test_blockers_follow_the_record_of_the_content(spark):
    jxl = {"profile_id": "p", "codec": "jpeg-xl", "container": "jxl", "settings": {"quality": 80}}
    rules = [{"rule_id": "c", "position": 1, "match": {}, "action": {"operation": "compress", "profile_id": "p"}}]
    record = lambda i, status="success", error=None, mode="RGB", hard=None, sha=None, runtime="r1": (i, "jpeg-xl", "v1", runtime, sha or f"h{i}", 1000, "m", status, error, mode, hard, 1, 1, None, None, 8)
    rows = [row(1, "a.jpg"), row(2, "b.jpg"), row(3, "c.jpg"), row(4, "d.jpg"), row(5, "e.jpg"), row(6, "f.tif"), row(7, "g.png"), row(8, "h.jpg")]
    analysis = [record(1), record(2, sha="older"), record(3, status="timeout"), record(4, error="broken"), record(5, mode="CMYK"), record(6), record(7, hard=["animation", "depth"]), record(8, runtime="r0")]
    got = {r["file_id"]: r["blockers"] for r in plan_for(spark, rows, rules, analysis, [jxl]).collect()}
    assert got == {1: [], 2: ["not analysed"], 3: ["analysis timed out"], 4: ["broken"], 5: ["not 8-bit RGB or RGBA"], 6: ["format not supported"], 7: ["animation"], 8: ["not analysed"]}


def test_what_waits_for_a_copy_that_is_not_made(spark):
    rules = [
        {"rule_id": "keep", "position": 1, "match": {}, "action": {"operation": "copy", "destination_dir": "Keep", "conflict_policy": "skip"}},
        {"rule_id": "again", "position": 2, "match": {}, "action": {"operation": "copy", "destination_dir": "Again", "depends_on_rule_id": "keep"}},
        {"rule_id": "move", "position": 3, "match": {}, "action": {"operation": "move", "destination_dir": "Moved", "depends_on_rule_id": "again"}},
        {"rule_id": "early", "position": 0, "match": {}, "action": {"operation": "copy", "destination_dir": "Early", "depends_on_rule_id": "move"}},
    ]
    # 1 is copied; 2 finds another file there and is skipped; 3 is there already
    got = plan_for(spark, [row(1, "a.jpg"), row(2, "b.jpg"), row(3, "c.jpg")], rules, existing=[("Keep/b.jpg", "x"), ("Keep/c.jpg", "h3")])
    state = {(r["file_id"], r["rule_id"]): (r["state"], r["waits_for"]) for r in got.collect()}
    assert state == {
        (1, "early"): ("pending", None), (1, "keep"): ("pending", None), (1, "again"): ("pending", "keep"), (1, "move"): ("pending", "again"),
        (2, "early"): ("pending", None), (2, "keep"): ("skipped", None), (2, "again"): ("dependency", "keep"), (2, "move"): ("dependency", "again"),
        (3, "early"): ("pending", None), (3, "keep"): ("satisfied", None), (3, "again"): ("pending", "keep"), (3, "move"): ("pending", "again"),
    }
    run = {(r["file_id"], r["rule_id"]): r for r in P.prepared(got, got.filter("rule_id <> 'keep'").select("plan_position")).collect()}
    assert [k for k, r in sorted(run.items()) if r["missing_copy"]] == [(1, "again"), (2, "again")]
    assert run[2, "move"]["reason"] == "its copy is not made" and run[1, "keep"]["reason"] == "not selected" and run[3, "keep"]["reason"] == "already satisfied"
    order = [k[1] for k, r in sorted(run.items(), key=lambda x: x[1]["execution_position"])]
    assert order == ["early", "keep", "again"] * 3 + ["move"] * 3


def test_targets_of_templates_and_folders(spark):
    def to(action, path="y/IMG.b.CR3", profile=None):
        rule = R.checked({"rule_id": "r", "position": 1, "match": {}, "action": action})
        df = R.prepared_files(spark.createDataFrame([(path, ".cr3", None, False)], "relative_path string, extension string, role string, managed_output boolean"))
        return df.select(R.target_of(rule, profile)).first()[0]

    jxl = {"container": "jxl"}
    assert to({"operation": "copy", "destination_dir": "A/"}) == "A/IMG.b.CR3"
    assert to({"operation": "move", "destination_dir": "A\\B", "preserve_relative_structure": True}) == "A/B/y/IMG.b.CR3"
    assert to({"operation": "compress", "destination_dir": ""}, profile=jxl) == "y/IMG.b.jxl"
    assert to({"operation": "compress", "destination_dir": "Z", "compress_in_place": False}, profile=jxl) == "Z/IMG.b.jxl"
    assert to({"operation": "compress"}, profile=jxl) == "y/IMG.b.jxl" and to({"operation": "compress"}) is None
    assert to({"operation": "copy", "target_template": "{relative_dir}/{stem}_{ext}.{container}"}, profile=jxl) == "y/IMG.b_CR3.jxl"
    assert to({"operation": "copy", "target_template": "{unknown}/x"}) is None and to({"operation": "copy", "target_template": "{"}) is None
    assert to({"operation": "delete", "destination_dir": "A"}) is None


def test_plan_survives_empty_tables_and_digests_follow_it(spark):
    rules = [{"rule_id": "del", "position": 1, "match": {"selection_state": "rejected"}, "action": {"operation": "delete"}}]
    assert plan_for(spark, [], rules).collect() == []
    rows = [row(1, "a.jpg", state="rejected"), row(2, "b.jpg", state="rejected", asset_id=1), row(3, "c.jpg", asset_id=3), row(4, "d.jpg", state="rejected", asset_id=3)]
    plan = plan_for(spark, rows, rules)
    assert [r[0] for r in P.assets_without_survivor(files(spark, rows), plan).collect()] == [1]
    digest = lambda p, r=rules: P.plan_digest(p, r, []).first()["digest"]
    assert digest(plan) == digest(plan_for(spark, rows[::-1], rules)) != digest(plan_for(spark, rows[:3], rules))
    assert digest(plan) != digest(plan, [{**rules[0], "position": 2}])


def test_execution_without_order_carries_only_what_is_kept(spark):
    """Totals need no order, and no column of the plan that they do not read crosses an exchange."""
    rows = [(i, i // 2, f"r{i % 2}", "copy" if i % 2 == 0 else "move", "pending", None if i % 2 == 0 else "r0", ["x" * 50], [], 10, 5, 1, False, False) for i in range(20)]
    plan = spark.createDataFrame(rows, "plan_position long, file_id long, rule_id string, operation string, state string, waits_for string, conflicts array<string>, blockers array<string>, size_bytes long, estimated_bytes long, storage_delta long, replace boolean, preflight boolean")
    picked = plan.filter("plan_position % 3 > 0").select("plan_position")
    keep = ["size_bytes", "estimated_bytes", "storage_delta", "replace", "preflight"]
    narrow = P.chosen_operations(plan, picked, keep)
    assert "conflicts" not in narrow.columns and "blockers" not in narrow.columns
    assert P.execution_totals(narrow).first() == P.execution_totals(P.prepared(plan, picked)).first()
    few, full = P.prepared(plan, picked, []), P.prepared(plan, picked)
    columns = ["plan_position", "execution_position", "execution_state", "missing_copy", "reason"]
    assert sorted(few.select(*columns).collect()) == sorted(full.select(*columns).collect())


def test_columns_that_follow_from_rules_are_the_same_behind_an_exchange(spark):
    import lumaloom.plans.registry  # noqa: F401
    from lumaloom.operators.rules import slim, spelled
    from lumaloom.plans.plan_queries import PLAN_RULES, PROFILES, plan_inputs

    f = plan_inputs(spark, "/root/testdata/sf0.001")[0].withColumn("managed_output", F.lit(False))
    ops = P.match_rules(f, PLAN_RULES, PROFILES)
    again = spelled(slim(ops, PLAN_RULES), PLAN_RULES, PROFILES).select(*ops.columns)
    assert ops.count() > 100 and ops.exceptAll(again).isEmpty()


def test_files_of_an_asset_are_dealt_out_once(spark):
    """The file view meets its assets without an exchange of its wide rows."""
    from lumaloom.plans.catalog import load

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        j = load(spark, "/root/testdata/sf0.001", "file", dealt=True).join(load(spark, "/root/testdata/sf0.001", "asset"), "asset_id")
        assert j._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
