import random
import re

import numpy as np
import pytest

from lumaloom.llm import jaccard_join as J


def brute(rows):
    sets = {}
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, copies=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉÀ") for _ in range(r.randint(1, 6)))
    out = [[word() for _ in range(r.choice([3, 5, 8, 40, 120]))] for _ in range(60)]
    passage = [word() for _ in range(60)]
    for i in range(0, 40):
        out.append(passage + [word() for _ in range(r.randint(0, 20))])
    base = [word() for _ in range(100)]
    for _ in range(copies):
        c = list(base)
        for _ in range(r.randint(0, 4)):
            c[r.randrange(len(c))] = word()
        if r.random() < 0.3:
            c = c[: r.randint(80, 100)]
        out.append(c)
    texts = [" ".join(x) for x in out]
    texts += [texts[0].upper() if texts[0].isascii() else texts[0], texts[1] + "\n", "", None, "  \t", "one two", "One\ttwo", "a b c d e", "a b c d e f"]
    return list(enumerate(texts))


def families(seed):
    """Near copies of one text at all distances, and texts put together from the same passages, mutually far apart but in the same cells."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base, out = [word() for _ in range(90)], []
    for _ in range(150):
        c = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            c[r.randrange(len(c))] = word()
        out.append(c)
    passages = [[word() for _ in range(30)] for _ in range(12)]
    for _ in range(150):
        chosen = r.sample(passages, r.randint(3, 5))
        out.append([w for p in chosen for w in p] + [word() for _ in range(r.randint(0, 6))])
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def check(spark, rows):
    docs = spark.createDataFrame([(i * 3 + 1, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, prefix int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.groups(docs).collect()}
    assert got == brute([(i * 3 + 1, t) for i, t in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "OFTEN", 8)
    check(spark, corpus(seed))


@pytest.mark.parametrize("hot", [8192, 24])
def test_large_regions(spark, monkeypatch, hot):
    """One family in the same cells, all in one task or cut into Voronoi regions over several, and inside tasks."""
    monkeypatch.setattr(J, "OFTEN", 8)
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "LEAF", 16)
    check(spark, families(hot))


def test_cells_that_grow_late(spark, monkeypatch):
    """Common words that only come into the prefixes when the frequent ones have left them: no window gets their cells, and the rows are the same."""
    r = random.Random(6)
    common = [f"c{i}" for i in range(104)]
    rows = [(i, " ".join(common + [f"w{r.randrange(10**9)}" for _ in range(100)])) for i in range(300)]
    rows += [(300 + i, t + " end") for i, t in rows[:5]]
    monkeypatch.setattr(J, "OFTEN", 8)
    monkeypatch.setattr(J, "CELL", 40)
    seen, divided = [], J.divided

    def watched(cells, scratch):
        plain, large = divided(cells, scratch)
        widest = lambda df: df.groupBy("cell").count().agg({"count": "max"}).first()[0]
        listed = widest(cells.filter("not often"))
        seen.append((listed, widest(plain), plain.count() + large.count() == cells.count()))
        return plain, large

    monkeypatch.setattr(J, "divided", watched)
    check(spark, rows)
    assert seen[0][0] > 100 and seen[0][1] <= 40 and seen[0][2]


def test_regions_lose_no_candidate():
    """Voronoi regions with windows find what a comparison of all pairs finds."""
    r = np.random.default_rng(3)
    centres = [r.choice(1 << 40, 100, replace=False) for _ in range(30)]
    sets = []
    for c in centres:
        for _ in range(40):
            keep = c[r.random(100) > 0.08 * r.random()]
            sets.append(np.unique(np.concatenate([keep, r.choice(1 << 40, r.integers(0, 8))])).astype(np.uint64))
    n = np.array([len(x) for x in sets], dtype=float)
    x = J.unfolded([J.folded(s) for s in sets], 9)
    comp, home = np.arange(len(n)), r.random(len(n)) < 0.8
    got = {(min(a, b), max(a, b)) for i, j in J.candidates(x, n, comp, home) for a, b in zip(i.tolist(), j.tolist())}
    both = np.arange(len(n))
    want = {(a, b) for a, b in zip(*(v.tolist() for v in J._meet(x, n, x.sum(1), comp, home, both, both, 80))) if a < b}
    assert got == want and len(want) > 1000
    for a in range(0, len(n), 7):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 180 * common >= 80 * (n[a] + n[b]) and (home[a] or home[b]):
                assert (b, a) in got


def test_ids(spark):
    """Null and large ids, repeated ids with equal and with other texts, very long texts."""
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    big = 9007199254740993
    long_text = " ".join(f"x{i}" for i in range(60_000))
    rows = [(None, a), (big, a + " end"), (big + 1, a), (big + 2, b), (5, b), (5, "one two three"), (None, None), (7, "one two three"), (big + 3, long_text), (big + 4, long_text + " y")]
    got = sorted(J.groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]))
    assert [tuple(r) for r in got] == [(5, 1, 5), (5, 36, 5), (7, 1, 5), (big, 37, big), (big + 1, 36, big), (big + 2, 36, 5), (big + 3, 59996, big + 3), (big + 4, 59997, big + 3), (None, 0, None), (None, 36, None)]


def test_empty(spark):
    assert J.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
