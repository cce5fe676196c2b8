"""Plans over larger tables: what meets what, and what is left out where it is not asked for."""

import itertools

import pytest
from pyspark.sql import functions as F

from lumaloom.operators import planning as P
from lumaloom.operators import rules as R
from lumaloom.plans import join_queries, registry

from .test_plans import files, plan_for, row

ANY = [
    {"rule_id": "src", "position": 1, "match": {"origin": "source"}, "action": {"operation": "copy", "destination_dir": "Out"}},
    {"rule_id": "man", "position": 2, "match": {"origin": "managed", "min_size_bytes": 500}, "action": {"operation": "delete"}},
    {"rule_id": "all", "position": 3, "match": {"extensions": [".jpg"]}, "action": {"operation": "move", "destination_dir": "Moved"}},
]


def claims(spark, rows):
    return spark.createDataFrame(rows, "file_id long, output_path string, output_sha256 string")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_provenance_meets_files_that_a_rule_may_take(spark, no_broadcast):
    """the answers are those of a look-up for every file, and both sides are dealt out once, by the file."""
    roles, shas, sizes = ["original", "managed_jxl", None], ["h", None], [100, 1000]
    rows = [row(i, f"d/{i}.{'jpg' if i % 2 else 'png'}", role=r, sha=s, size=n) for i, (r, s, n) in enumerate(itertools.product(roles, shas, sizes))]
    rows += [row(50 + i, f"d/{50 + i}.jpg", size=n) for i, n in enumerate(sizes * 2)]
    f = files(spark, rows)
    copies = claims(spark, [(i, f"d/{i}.{'jpg' if i % 2 else 'png'}", "h") for i in range(12)] + [(50, "d/50.jpg", "h50"), (50, "d/50.jpg", "h50"), (51, "D/51.jpg", "h51"), (52, None, "h52"), (1, "d/1.jpg", None)])
    others = claims(spark, [(53, "d/53.jpg", "h53"), (50, "d/50.jpg", "h50")])
    got = R.match_rules(f, ANY, provenance=(copies, others))
    proven = {(r[0], r[1], r[2]) for r in copies.union(others).collect()}
    want = set()
    for i, _, path, ext, _, role, size, _, sha, *_ in rows:
        managed = (role or "").startswith("managed") or (sha is not None and (i, path, sha) in proven)
        want |= {(i, "man")} if managed and size >= 500 else set()
        want |= {(i, "src")} if not managed else set()
        want |= {(i, "all")} if ext == ".jpg" else set()
    found = [tuple(r) for r in got.select("file_id", "rule_id").collect()]
    assert len(found) == len(want) and set(found) == want
    assert "managed_output" not in got.columns  # it is not looked up for every file
    assert R.match_rules(R.managed_outputs(f, copies, others), ANY).select(*got.columns).exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file_id") == plan.count("Exchange hashpartitioning(") == 2


def test_execution_order_is_sorted_from_a_written_table(spark, monkeypatch):
    """a sort by ranges reads its input twice; the match is worked out once."""
    from lumaloom.plans import plan_queries, registry

    names, write = [], plan_queries.written
    monkeypatch.setattr(plan_queries, "written", lambda df, name: names.append(name) or write(df, name))
    got = registry.QUERIES["cmp_29_srt_12_execution_order"](spark, "/root/testdata/sf0.001")
    assert names == ["ready"] and sorted(r["place"] for r in got.collect()) == list(range(1, got.count() + 1))


def test_totals_and_survivors_need_no_places(spark, monkeypatch):
    """neither writes targets nor sorts the plan, and both say what the placed plan says."""
    rules = [
        {"rule_id": "keep", "position": 1, "match": {"extensions": [".jpg"]}, "action": {"operation": "copy", "destination_dir": "Keep", "conflict_policy": "skip"}},
        {"rule_id": "again", "position": 2, "match": {}, "action": {"operation": "copy", "destination_dir": "Again", "depends_on_rule_id": "keep"}},
        {"rule_id": "png", "position": 3, "match": {"format": "png"}, "action": {"operation": "compress", "profile_id": "p", "source_disposition": "replace", "conflict_policy": "overwrite"}},
        {"rule_id": "del", "position": 4, "match": {"selection_state": "rejected", "origin": "source"}, "action": {"operation": "delete"}},
    ]
    jxl = [{"profile_id": "p", "codec": "jpeg-xl", "container": "jxl", "settings": {"quality": 80}}]
    rows = [row(i, f"d{i % 2}/{i % 5}.{('jpg', 'png', 'cr3')[i % 3]}", asset_id=i // 3, state=("rejected", "undecided")[i % 4 == 0], sha=f"h{i % 7}") for i in range(40)]
    rows += [row(90, "e/x.heic", asset_id=90, state="rejected"), row(91, "e/y.png", asset_id=90, sha=None)]
    f, nothing = files(spark, rows), claims(spark, [(2, "d0/2.cr3", "h2")])
    a = "file_id long, codec string, contract string, runtime string, sha256 string, size_bytes long, mtime string, status string, error string, mode string, hard_blockers array<string>, width int, height int, duration double, fps double, bit_depth int"
    record = lambda i, sha, mtime="m": (i, "jpeg-xl", "v1", "r1", sha, 1000, mtime, "success", None, "RGB", None, 1, 1, None, None, 8)
    analysis = spark.createDataFrame([*[record(i, f"h{i % 7}") for i in range(0, 40, 2)], record(91, None), record(7, "h0", "older"), record(13, None)], a)
    existing = spark.createDataFrame([("Keep/0.jpg", "h0"), ("Keep/3.jpg", "x")], "target string, sha256 string")
    given = (f, rules, jxl, analysis, existing, nothing, nothing)
    placed = P.dry_run(*given)
    assert {r["file_id"] for r in placed.filter("operation = 'compress' and size(blockers) = 0").collect()} == {i for i in range(0, 40, 2) if i % 3 == 1} | {91}
    totals, left = sorted(P.plan_summary(placed).collect()), sorted(P.assets_without_survivor(f, placed).collect())
    counted = {k: n for k, n in placed.groupBy("file_id", "rule_id").count().select("file_id", "count").groupBy("file_id").sum("count").collect()}

    def never(*_):
        raise AssertionError("written or placed")

    monkeypatch.setattr(P, "written", never)
    monkeypatch.setattr(P, "locate", never)
    loose = P.unordered_plan(*given, keep=["asset_id"])
    assert sorted(P.plan_summary(loose).collect()) == totals and sorted(P.assets_without_survivor(f, loose).collect()) == left
    assert loose.count() == sum(counted.values()) and totals


def test_odd_paths_are_told_by_their_first_fault(spark):
    from .test_operators import one

    seen = {"a/b.jpg": None, "Console/x": None, "a/CON": "device", "a/lpt1.txt": "device", "x/.lumaloom/y": "state folder", ".hidden": None, "a/./b": "malformed", "a//b": "malformed", "": "malformed", " a": "malformed", "a ": "malformed",
            "/a": "absolute", "C:/a": "absolute", "\\a": "absolute", "a/../b": "parent", "a:b": "character", "a\tb": "character", "a./b": "trailing", "a/b.": "trailing", "ä/ö.jpg": None}
    assert {p: one(spark, R.path_problem(F.lit(p)))[0] for p in seen} == seen
    assert one(spark, R.path_problem(F.lit("a/State/b"), "state"))[0] == "state folder" and one(spark, R.path_problem(F.lit(None).cast("string")))[0] is None


def stems(spark, path, raws, rendered):
    """Line items that are RAW and rendered files of one stem in the root folder; the first of each share assets."""
    line = "11L AS l_suppkey, 1D AS l_quantity, 1D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1995-01-01' AS l_shipdate"
    a = spark.range(raws).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "2L AS l_partkey", *line.split(", "))
    b = spark.range(rendered).selectExpr(f"IF(id < 5, id, id + {raws}) AS l_orderkey", "2 AS l_linenumber", "502L AS l_partkey", *line.split(", "))
    a.unionByName(b).write.parquet(f"{path}/lineitem.parquet")
    return {(i * 8 + 1, (j if j < 5 else j + raws) * 8 + 2) for i in range(raws) for j in range(rendered) if i != j or j >= 5}


def test_pairs_of_one_stem_take_part_of_a_byte(spark, tmp_path):
    """F8: every pair once, and a table of them is small though the rendered files of a stem fill a good part of a page."""
    raws, rendered = 150, 6001
    want = stems(spark, tmp_path, raws, rendered)
    registry.QUERIES["jn_13_same_stem"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/pairs").select("raw_id", "rendered_id").toPandas().itertuples(index=False)]
    assert len(got) == len(want) and set(got) == want
    size = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    assert size < len(want) / 3


def test_pairs_do_not_depend_on_blocks(spark, tmp_path, monkeypatch):
    """F8: blocks and tasks of any size hold the same pairs, and each side is dealt out once for the join."""
    want = stems(spark, tmp_path, 13, 22)
    for raws, rendered, task in ((1, 1, 1), (3, 4, 7), (13, 22, 60), (64, 5, 1000)):
        monkeypatch.setattr(join_queries, "RAWS", raws)
        monkeypatch.setattr(join_queries, "RENDERED", rendered)
        monkeypatch.setattr(join_queries, "PAIR_TASK", task)
        df = registry.QUERIES["jn_13_same_stem"](spark, str(tmp_path))
        got = [tuple(r) for r in df.select("raw_id", "rendered_id").collect()]
        assert len(got) == len(want) and set(got) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange ") == 4  # the other two make the files
