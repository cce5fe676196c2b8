import numpy as np
import pytest

from lumaloom.llm import ann_search, embedding_dedup


def rows(seed=0, n=500, d=16):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d))
    v[1:n:3] = v[0] + 0.1 * r.normal(size=(len(v[1:n:3]), d))
    for i in range(2, n - 3, 12):
        v[i + 2] = v[i] + 0.15 * r.normal(size=d)
    v[10] = v[20] = v[30]
    out = [(i, [float(x) for x in v[i]], int(i % 2 if i % 3 != 1 else 0)) for i in range(n)]
    return out + [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] * d, 0), (n + 3, [None] * d, 0), (n + 4, out[4][1], None), (n + 5, [1.0], 0)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def good(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates(spark):
    data = rows()
    ok = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in data if good(v) and g is not None]
    m = np.array([v for _, v, _ in ok])
    g = np.array([g for _, _, g in ok])
    hit = (m @ m.T >= 0.93) & (g[:, None] == g[None])
    np.fill_diagonal(hit, False)
    want = {i: 0 for i, _, _ in data} | {ok[i][0]: int(hit[i].sum()) for i in range(len(ok))}
    comp = list(range(len(ok)))
    for i in range(len(ok)):
        stack = [i] if comp[i] == i else []
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(hit[x]):
                if comp[y] > i:
                    comp[y] = i
                    stack.append(y)
    group = {i: i for i, _, _ in data} | {ok[i][0]: ok[comp[i]][0] for i in range(len(ok))}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert set(got) == set(want)
    assert sum(abs(got[i]["n_links"] - want[i]) for i in want) <= 0.01 * sum(want.values())
    assert sum(got[i]["component_id"] != group[i] for i in want) <= 2
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_neighbours(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    got = ann_search.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 20).collect()
    ok = {i: np.array(v) for i, v, _ in data if good(v)}
    hit = n = 0
    for q in [i for i in ok if i % 20 == 0]:
        true = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:20]
        mine = sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - float(ok[q] @ ok[r["vec_id"]])) < 1e-9 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hit += len({i for _, i in true} & {r["vec_id"] for r in mine})
        n += 20
    assert hit >= 0.9 * n
    assert ann_search.nearest_neighbours(spark.createDataFrame([], SCHEMA), df, 20).count() == 0
    few = spark.createDataFrame(data[:5], SCHEMA)
    assert ann_search.nearest_neighbours(few, few, 20).count() == 20


def test_links_between_saturated_lists(spark):
    r = np.random.default_rng(3)
    d, angle = 16, np.arccos(0.94)
    centres = np.zeros((2, d))
    centres[0, 0], centres[1, 0], centres[1, 1] = 1, np.cos(angle), np.sin(angle)
    v = np.repeat(centres, 40, axis=0) + 0.0005 * r.normal(size=(80, d))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 0) for i in range(80)], SCHEMA)
    got = embedding_dedup.near_duplicates(df).collect()
    assert [(x["n_links"], x["component_id"]) for x in got] == [(79, 0)] * 80


def test_audit_guards_the_result(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.normal(size=(40, 16))
    v[1::2] = v[::2] + 0.05 * r.normal(size=(20, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 0) for i in range(40)], SCHEMA)
    work = embedding_dedup.NNDescent.__new__(embedding_dedup.NNDescent)
    work.threshold, work.most = 0.93, 24 << 18
    assert work.tables(0.99) >= 40
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    monkeypatch.setattr(embedding_dedup.NNDescent, "links", lambda self: self.graph.filter("sim > 2").select("id", "near").toDF("a", "b"))
    with pytest.raises(RuntimeError, match="recall 0.0000"):
        embedding_dedup.near_duplicates(df)


def test_rows_of_their_own(spark):
    """Repeated ids (equal, other and unusable vectors), other lengths, a null id, ties."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 2.0, 3.0]
    data = [(1, a, 0), (1, a, 0), (2, b, 0), (2, None, 0), (3, c, 0), (4, c, 0), (5, c, 1), (None, a, 0), (6, b, 0), (6, a, 0)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA).filter("vec_id is not null")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 1, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 2, False), (6, 2, 1, False)]
    odd = [r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect() if r["vec_id"] is None]
    assert [(r["n_links"], r["component_id"]) for r in odd] == [(0, None)]
    ann = ann_search.nearest_neighbours(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(1,), (3,)], "vec_id long"), 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann) == [(1, 1, 6, 1.0), (1, 2, 2, 0.0), (3, 1, 4, 14.0), (3, 2, 5, 14.0)]


def test_graph_walk_finds_near_centroids():
    """The walk alone, without distances to all centroids."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(60, 8)) * 3
    c = (centres[r.integers(0, 60, 3000)] + r.normal(size=(3000, 8))).astype(float)
    graph = ann_search.CentroidGraph(c)
    q = centres[r.integers(0, 60, 100)] + r.normal(size=(100, 8))
    at, dist = graph.nearest(q, 60)
    full = ((q[:, None] - c[None]) ** 2).sum(2)
    assert np.allclose(dist, np.take_along_axis(full, at, 1)) and all(len(set(x)) == 60 for x in at.tolist())
    best = np.argsort(full, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best.tolist(), at.tolist())]) > 0.95
