"""Versioned derivation over restarts, and one pass with several tables."""

import json
import random

import pandas as pd
import pytest

from lumaloom.streaming import incremental

LISTING = "file_id long, scan long, fingerprint string, payload string"


def derive(component, row):
    payload = row["payload"].iat[0]
    if payload == "bad":
        raise ValueError("bad payload")
    if payload == "other":
        return pd.DataFrame({"status": ["unsupported"], "value": [None]})
    return pd.DataFrame({"status": ["complete"], "value": [f"{component}/{payload}"]})


class Model:
    """The rules, one listing after the other."""

    def __init__(self):
        self.state = {}

    def scan(self, rows, versions):
        out = set()
        for i, scan, print_, payload in rows:
            for c, v in versions.items():
                was = self.state.get((i, c))
                fresh = was and was[0] == v and (was[2] == "unsupported" or (was[2] == "complete" and print_ and was[1] == print_))
                if fresh:
                    continue
                why = "missing" if not was else "version" if was[0] != v else "failed" if was[2] == "failed" else "input"
                status = {"bad": "failed", "other": "unsupported"}.get(payload, "complete")
                self.state[i, c] = (v, print_ or "", status)
                out.add((i, c, scan, v, why, status, f"{c}/{payload}" if status == "complete" else None))
        return out


def run(spark, base, versions, work=derive):
    s = spark.readStream.schema(LISTING).parquet(f"{base}/in")
    incremental.run_available(incremental.derive_versioned(s, versions, work), f"{base}/out", f"{base}/ck")


def test_versions_over_restarts(spark, tmp_path):
    r, model, want, base = random.Random(2), Model(), set(), str(tmp_path)
    for scan, versions in enumerate([{"a": "1", "b": "1"}, {"a": "1", "b": "1"}, {"a": "2", "b": "1"}, {"a": "2", "b": "1", "c": "1"}], 1):
        rows = [(i, scan, r.choice(["x", "y", None]), r.choice(["p", "q", "bad", "other"])) for i in range(60) if r.random() < 0.9]
        spark.createDataFrame(rows + [(None, scan, "x", "p")], LISTING).write.mode("append").parquet(f"{base}/in")
        run(spark, base, versions)
        want |= model.scan(rows, versions)
        got = [(x["file_id"], x["component"], x["scan"], x["version"], x["why"], x["status"], x["value"]) for x in spark.read.parquet(f"{base}/out").collect()]
        assert len(got) == len(want) and set(got) == want
    errors = {x["error"] for x in spark.read.parquet(f"{base}/out").filter("status = 'failed'").collect()}
    assert errors == {"ValueError: bad payload"}


def test_repeats_and_old_scans(spark, tmp_path):
    base = str(tmp_path)
    rows = [(1, 5, "x", "p"), (1, 5, "x", "p"), (1, 6, "y", "q"), (1, 6, None, "r")]
    spark.createDataFrame(rows, LISTING).write.parquet(f"{base}/in")
    run(spark, base, {"a": "1"})
    spark.createDataFrame([(1, 4, "older", "p")], LISTING).write.mode("append").parquet(f"{base}/in")
    run(spark, base, {"a": "1"})
    assert [(x["scan"], x["value"]) for x in spark.read.parquet(f"{base}/out").collect()] == [(6, "a/q")]


def test_cut_short(spark, tmp_path):
    """A worker dies in the middle of a batch: nothing of it is kept, and the next start derives the whole batch once."""
    base = str(tmp_path)
    spark.createDataFrame([(i, 1, "x", "p") for i in range(20)], LISTING).write.parquet(f"{base}/in")
    flag = tmp_path / "broken"
    flag.write_text("")

    def dying(component, row):
        if row["file_id"].iat[0] == 13 and flag.exists():
            raise SystemExit("worker lost")
        return derive(component, row)

    with pytest.raises(Exception):
        run(spark, base, {"a": "1"}, dying)
    flag.unlink()
    run(spark, base, {"a": "1"}, dying)
    run(spark, base, {"a": "1"}, dying)
    assert sorted(x["file_id"] for x in spark.read.parquet(f"{base}/out").collect()) == list(range(20))


def test_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps(list(range(i)))) for i in range(10)], "id long, packed string").repartition(3)
    seen = tmp_path / "decoded"
    seen.mkdir()

    def decode(batch):
        for i in batch["id"]:
            (seen / str(i)).open("x")  # a second decoding of the same row would fail
        return batch["packed"].map(json.loads)

    def sizes(batch, lists):
        return pd.DataFrame({"id": batch["id"], "n": lists.map(len)})

    def items(batch, lists):
        return pd.DataFrame([(i, x) for i, v in zip(batch["id"], lists) for x in v], columns=["id", "x"])

    def none(batch, lists):
        return pd.DataFrame({"id": []})

    out = incremental.fan_out(rows, decode, {"sizes": (sizes, "id long, n long"), "items": (items, "id long, x long"), "none": (none, "id long")}, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in out["sizes"].collect()) == [(i, i) for i in range(10)]
    assert sorted(tuple(r) for r in out["items"].collect()) == [(i, x) for i in range(10) for x in range(i)]
    assert out["none"].collect() == []
    assert len(list(seen.iterdir())) == 10
    plan = out["sizes"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(consumer" in plan and "items" not in plan.split("ReadSchema")[-1]


def test_versioned_batches_are_keyed_state_with_many_rows_a_call(spark, tmp_path):
    """The state as a table gives what the state of single keys gives, over restarts; a row that raises fails alone."""
    import random

    from lumaloom.streaming.incremental import derive_versioned, derive_versioned_batches, run_available

    calls = tmp_path / "calls"
    calls.mkdir()

    def derive(component, rows):
        (calls / f"{random.random()}-{len(rows)}").touch()
        if (rows["mark"] == "bad").any():
            raise ValueError("bad")
        return rows.assign(status=["unsupported" if m == "odd" else "complete" for m in rows["mark"]], value=component + ":" + rows["mark"])[["status", "value"]]

    rng = random.Random(3)
    schema = "file_id long, scan long, fingerprint string, mark string"
    outs = {}
    for scan, versions in ((1, {"a": "1", "b": "1"}), (2, {"a": "1", "b": "2"}), (3, {"a": "1", "b": "2"})):
        rows = [(i, scan - (i % 10 == 3) * 2, rng.choice(["x", "y", "", None]), rng.choice(["bad", "odd", "m", "n"])) for i in rng.sample(range(80), 60)]
        rows += [(None, scan, "x", "m"), (5, None, "x", "m"), (7, scan, "z", "m")]
        rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_available(derive_versioned(stream(), versions, derive), str(tmp_path / "keys"), str(tmp_path / "k"))
        for f in calls.iterdir():
            f.unlink()
        derive_versioned_batches(stream(), versions, derive, str(tmp_path / "tables"), str(tmp_path / "state"), str(tmp_path / "t"))
        outs[scan] = max(int(f.name.rsplit("-", 1)[1]) for f in calls.iterdir())
    columns = ["file_id", "component", "scan", "version", "why", "status", "value", "error"]
    want, got = (sorted(map(tuple, spark.read.parquet(str(tmp_path / n)).select(*columns).collect()), key=repr) for n in ("keys", "tables"))
    assert got == want and len(got) > 120
    assert outs[1] > 5
