import random

import pytest

from pyspark.sql import functions as F

from lumaloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, s, n):
    for _ in range(n):
        i = r.randrange(len(s))
        s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abé ") + s[i:], s[:i] + r.choice("xyz") + s[i + 1 :]])
    return s


def test_distance(spark):
    r = random.Random(4)
    rows = []
    for _ in range(150):
        a = "".join(r.choice("abcé") for _ in range(r.randint(3, 90)))
        rows.append((a, edited(r, a, r.randint(0, 4)) if r.random() < 0.8 else "".join(r.choice("ab") for _ in range(len(a)))))
    rows = [x for x in rows if min(map(len, x)) >= 3]
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        got = df.select("a", "b", L.within_edits(F.col("a"), F.col("b"), k).alias("ok")).collect()
        assert all(x["ok"] == (distance(x["a"], x["b"]) <= k) for x in got)


@pytest.mark.parametrize("edits", [1, 2])
def test_against_brute_force(spark, edits):
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdeé fgh") for _ in range(n)).strip().ljust(8, "q")
    pool = [line(r.randint(8, 60)) for _ in range(25)] + ["short"]
    docs = [(d, "\n".join(edited(r, s, r.choice([0, 0, 1, 2, 3, 5])) if r.random() < 0.5 else s for s in r.choices(pool, k=r.randint(1, 6))), "u") for d in range(50)] + [(50, None, "u"), (51, "", "u"), (52, pool[0], None), (53, pool[0], None)]
    places = [(d, i, s.strip(" ")) for d, t, _ in docs if t is not None for i, s in enumerate(t.split("\n")) if len(s.strip(" ")) >= 8]
    kinds = sorted({s for *_, s in places})
    up = {s: s for s in kinds}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                up[root(a)] = root(b)
    head = {}
    for d, i, s in places:
        head.setdefault(root(s), (d, i))
    want = {}
    for d, t, _ in docs:
        if t is not None:
            gone = {i for e, i, s in places if e == d and head[root(s)] != (d, i)}
            want[d] = "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone)
    df = spark.createDataFrame(docs, "doc_id long, text string, exact string").repartition(3)
    got = {x["doc_id"]: x for x in L.dedup_lines(df, edits, least=8).collect()}
    assert len(got) == len(docs) and got[50]["text"] is None and got[50]["n_lines"] == 0
    assert {d: got[d]["text"] for d in want} == want
    assert sum(x["n_near"] for x in got.values()) > 0 and got[53]["n_exact"] == 1
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_edits_by_default(spark):
    assert L.EDITS == 2
    docs = spark.createDataFrame([(1, "Page 12 of 40 of the yearly report"), (2, "Page 13 of 41 of the yearly report"), (3, "Page 555 of 41 of the yearly report")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in L.dedup_lines(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_ids_and_long_texts(spark):
    """Null and large ids, a repeated id with another text, thousands of lost lines in one text."""
    big = 9007199254740993
    r = random.Random(8)
    footers = ["".join(r.choice("abcdefghij") for _ in range(30)) for _ in range(50)]
    many = "\n".join(footers[i % 50] for i in range(6000))
    rows = [(None, "a line that many documents hold"), (big, "a line that many documents hold\nshort"), (big + 1, "a line that many documents hold"), (3, many), (4, "first and quite long line of four\nthe tail of document four stays"), (4, "first and quite long line of four")]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_exact"] + r["n_near"]), r["text"]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert [k for k, _ in got] == [(False, 3, 6000, 5950), (False, 4, 1, 0), (False, 4, 2, 0), (False, big, 2, 0), (False, big + 1, 1, 1), (True, 0, 1, 0)]
    assert got[0][1] == "\n".join(many.split("\n")[:50]) and got[4][1] == "" and got[5][1] == rows[0][1]


def test_a_family_with_one_common_segment(spark):
    """Lines that share a segment but are far apart leave no pair; the few similar ones are found."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    tail = word(60)
    lines = [f"{word(14)} {word(14)} {tail}" for _ in range(200)]
    lines += [s[:3] + "#" + s[4:] for s in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_near"] for x in L.dedup_lines(docs).collect()}
    assert got == {i: int(i >= 200) for i in range(220)}
