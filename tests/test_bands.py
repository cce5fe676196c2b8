"""Counts and first of band pairs against all pairs, on ties, repeated and missing keys, and values that are no numbers."""

import math
import random

import pytest

from lumaloom.operators import groups as G


def events(seed):
    rng = random.Random(seed)
    odd = [None, math.nan, math.inf, -math.inf]
    rows = [(rng.choice("ab"), rng.choice([0.0, 10.0, 10.5]) + rng.randrange(60) * 7.5, rng.choice([None, *range(40)]), rng.choice(odd) if rng.random() < 0.05 else rng.randrange(400) / 10) for _ in range(260)]
    return [*rows, (None, 1.0, 1, 1.0), ("c", 5.0, 1, 2.0), ("a", None, 1, 2.0)]


def pairs(rows, width):
    out = []
    for k, t, i, v in rows:
        for l, u, j, w in rows:
            if k is None or k != l or t is None or u is None or u - t > width:
                continue
            if u > t or (u == t and i is not None and j is not None and j > i):
                out.append((k, i, j, u - t, None if v is None or w is None else abs(v - w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_of_band_pairs(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, "kind string, t double, k long, v double")
    got = {r["kind"]: (r["pairs"], r["accepted"]) for r in G.band_pair_counts(df, "t", "k", ["kind"], 20.0, "v", 5.0).collect()}
    want = {}
    for kind, _, _, _, diff in pairs(rows, 20.0):
        n, m = want.get(kind, (0, 0))
        want[kind] = (n + 1, m + (diff is not None and diff <= 5.0))
    assert got == want


def order(diff, dt, a, b):
    return (math.isnan(diff), 0.0 if math.isnan(diff) else diff, dt, a is None, a or 0, b is None, b or 0)


@pytest.mark.parametrize("seed, n", [(1, 50), (2, 3), (3, 100_000)])
def test_first_band_pairs(spark, seed, n):
    rows = events(seed)
    df = spark.createDataFrame(rows, "kind string, t double, k long, v double")
    got = [(r["a"], r["b"], r["diff"]) for r in G.nearest_band_pairs(df, "t", "k", ["kind"], 20.0, "v", 5.0, n).collect()]
    found = sorted((p for p in pairs(rows, 20.0) if p[4] is not None and not p[4] <= 5.0), key=lambda p: order(p[4], p[3], p[1], p[2]))
    assert [(a, b, repr(d)) for a, b, d in got] == [(p[1], p[2], repr(p[4])) for p in found[:n]]


def test_copies_form_no_pairs(spark):
    """A million pairs of copies: counted and cut without a pair in memory at once."""
    df = spark.range(3000).selectExpr("'a' AS kind", "cast(id % 2 as double) AS t", "id AS k", "cast(id % 3 * 6 as double) AS v")
    got = G.band_pair_counts(df, "t", "k", ["kind"], 20.0, "v", 5.0).first()
    assert (got["pairs"], got["accepted"]) == (3000 * 2999 // 2, 3 * (1000 * 999 // 2))
    first = G.nearest_band_pairs(df, "t", "k", ["kind"], 20.0, "v", 5.0, 4).collect()
    assert [(r["a"], r["b"], r["diff"]) for r in first] == [(0, 4, 6.0), (0, 10, 6.0), (0, 16, 6.0), (0, 22, 6.0)]
