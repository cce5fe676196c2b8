"""Mixing against a plain model: targets by the stated rounds, words one after another, places by bisection."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumaloom.llm import mixing as M
from lumaloom.llm.common import Scratch


def plain_targets(sizes, weights, share=1.5, most=2.0):
    full, wanted = set(), share * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest, weight = wanted - sum(most * sizes[i] for i in full), sum(weights[i] for i in free)
        out = [most * s if i in full else rest * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            return out
        full |= above


def queried(spark, tmp_path, rows, schema="doc_id long, text string, source string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return [r.asDict() for r in M.op11_mixing(spark, str(tmp_path)).collect()]


def random_documents(rng, n):
    rows = []
    for i in range(n):
        source = rng.choice(["b", "a", None, "Z", "é", "src", "src", "src"])
        text = rng.choice([None, "", " \t", "w " * rng.randrange(1, 60), "x y z\n", "one"])
        rows.append((None if i % 31 == 0 else i // 2 if i % 7 == 0 else i, text, source))
    return rows


def plain_mix(rows):
    """[(doc_id, size, source_size, target, taken, readings, first)] with the run laid out word by word."""
    size = lambda t: 0 if t is None else len(t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for *_, s in rows)
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    goals = dict(zip(names, plain_targets([total[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    code = lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
    key = lambda i: (code(rows[i][0]), rows[i][0] is not None, rows[i][0] or 0, size(rows[i][1]))
    taken, readings, run = [0] * len(rows), [0] * len(rows), []
    for k, s in enumerate(names):
        a, b = ((4.5, 1.5), (0.5, 1.5), (2.0, 2.0))[k % 3]
        order, at, goal = sorted((i for i in range(len(rows)) if rows[i][2] == s and size(rows[i][1])), key=key), 0, int(goals[s])
        for reading in range(2):
            for i in order:
                length = min(size(rows[i][1]), goal - at)
                if length <= 0:
                    break
                taken[i] += length
                readings[i] += 1
                part, lo, hi = at / goals[s] * (a + b) / 2, 0.0, 1.0
                for _ in range(80):  # invert the integral of the line from a to b
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if a * mid + (b - a) * mid * mid / 2 < part else (lo, mid)
                run.append((round(lo, 9), k, *key(i), reading, i, length))
                at += length
    first, position = {}, 0
    for *_, i, length in sorted(run):
        first.setdefault(i, position)
        position += length
    return [(rows[i][0], size(rows[i][1]), total[rows[i][2]], goals[rows[i][2]], taken[i], readings[i], first.get(i)) for i in range(len(rows))]


def test_against_plain_model(spark, tmp_path):
    rows = random_documents(random.Random(5), 400)
    got = [tuple(r.values()) for r in queried(spark, tmp_path, rows)]
    want = plain_mix(rows)
    exact = lambda rows_: sorted((tuple(r[:3]) + (round(r[3], 6),) + tuple(r[4:]) for r in rows_), key=str)
    assert exact(got) == exact(want)


def test_contract(spark, tmp_path):
    rows = random_documents(random.Random(9), 300)
    got = queried(spark, tmp_path, rows)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) < 1 for (_, target), t in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r["size"] for r in got))
    again = [r.asDict() for r in M.op11_mixing(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_hot_source_and_equal_rows(spark, tmp_path):
    rows = [(1, "a b c", "hot")] * 500 + [(i, "w " * (i % 9), "cold") for i in range(90)]
    got = queried(spark, tmp_path, rows)
    exact = lambda rows_: sorted((tuple(r[:3]) + (round(r[3], 6),) + tuple(r[4:6]) for r in rows_), key=str)
    assert exact(tuple(r.values()) for r in got) == exact(plain_mix(rows))


def test_empty_tables_and_extra_columns(spark, tmp_path):
    assert queried(spark, tmp_path / "none", []) == []
    only = queried(spark, tmp_path / "blank", [(1, "", "a"), (2, None, None)])
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2
    more = queried(spark, tmp_path / "more", [(1, "a b", "s", 7, "x"), (2, "c", "t", 8, "y")], "doc_id long, text string, source string, row long, code string")
    assert sorted((r["doc_id"], r["taken"]) for r in more) == [(1, 3), (2, 1)]


def test_very_long_text_is_read_in_part(spark, tmp_path):
    got = queried(spark, tmp_path, [(1, "w " * 300_000, "a"), (2, "w " * 300_000, "b"), (3, "w", "b")])
    assert {r["doc_id"]: r["taken"] for r in got if r["doc_id"] == 1} == {1: 600_000}
    assert sum(r["taken"] for r in got) == int(1.5 * 600_001)


def test_schedule_with_several_points(spark):
    """A schedule that is off, rises, and is off again: nothing is placed where it is off."""
    sized = spark.createDataFrame([(i, i, "s", 10, f"{i:04d}") for i in range(100)] + [(100 + i, i, "t", 10, f"{i:04d}") for i in range(100)], "row long, doc_id long, source string, size long, code string")
    points = lambda *p: [(float(a), float(w)) for a, w in p]
    schedules = spark.createDataFrame([("s", points((0, 0), (0.4, 0), (0.6, 2), (0.8, 0), (1, 0))), ("t", points((0, 1), (1, 1)))], "source string, points array<struct<at:double,weight:double>>")
    sources, readings = M.curriculum(sized, schedules, Scratch(spark, "points"))
    targets = {r["source"]: r["target"] for r in sources.collect()}
    assert targets["s"] + targets["t"] == pytest.approx(3000) and targets["t"] == pytest.approx(2000)
    s = readings.filter("source = 's'").agg(F.min("at"), F.max("at"), F.percentile_approx("at", 0.5), F.sum("length")).head()
    assert 0.4 <= s[0] < 0.45 and 0.75 < s[1] <= 0.8 and abs(s[2] - 0.6) < 0.02 and s[3] == 1000
    order = [r["position"] for r in readings.orderBy("at", "source").collect()]
    assert order == sorted(order) and order[0] == 0
