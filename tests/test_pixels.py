"""Pixel functions against numpy, on random grids of many sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaloom.functions import pixels as X


def kernel(name, x):
    x = np.abs(x)
    if name == "triangle":
        return np.maximum(1 - x, 0)
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)


def taps(size, target, name):
    """For each output place its first input and shares, summed in order: equal weights often meet a half exactly."""
    scale = size / target
    wide, reach = max(scale, 1.0), {"triangle": 1, "lanczos": 3}[name] * max(scale, 1.0)
    for i in range(target):
        centre = (i + 0.5) * scale
        places = range(max(int(np.floor(centre - reach + 0.5)), 0), min(int(np.floor(centre + reach + 0.5)), size))
        w = [float(kernel(name, (j - centre + 0.5) / wide)) for j in places]
        yield places[0], [x / sum(w) for x in w]


def resize(grid, width, height, name="triangle"):
    def along(lines, target):
        parts = list(taps(len(lines[0]), target, name))
        return [[min(max(int(np.floor(sum(v * w for v, w in zip(line[at:], ws)) + 0.5)), 0), 255) for at, ws in parts] for line in lines]

    rows = along(grid.tolist(), width)
    return np.array(along(np.array(rows).T.tolist(), height)).T


def grey(r, g, b):
    return (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16


def features(r, g, b):
    small = resize(grey(r, g, b), 9, 8, "lanczos")
    bits = "".join("1" if small[y, x] > small[y, x + 1] else "0" for y in range(8) for x in range(8))
    luma = resize(grey(r, g, b), 16, 16).ravel() / 255
    spread = luma.std() if luma.min() < luma.max() else np.inf
    hist = [np.bincount(resize(c, 32, 32).ravel() // 32, minlength=8) / 1024 for c in (r, g, b)]
    return f"{int(bits, 2):016x}", (luma - luma.mean()) / spread, np.concatenate(hist)


@pytest.fixture(scope="module")
def pictures(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(30):
        w, h = int(rng.integers(2, 45)), int(rng.integers(2, 45))
        base = rng.integers(0, 256, (3, h, w)) if i % 3 else np.full((3, h, w), 10 * i)
        rows.append((i, w, base))
    df = spark.createDataFrame([(i, w, *[c.ravel().tolist() for c in m]) for i, w, m in rows], "id int, w int, r array<int>, g array<int>, b array<int>")
    return {i: m for i, _, m in rows}, df


def test_visual_features(pictures):
    arrays, df = pictures
    for x in X.visual_features(df, "r", "g", "b", "w").collect():
        dhash, luma, hist = features(*arrays[x["id"]])
        near = lambda a, b: np.allclose(np.array(a), b, atol=2e-6)
        # rounding of one grey step where a weighted sum lies on a half may turn a bit
        assert bin(int(dhash, 16) ^ int(x["dhash"], 16)).count("1") <= 1
        assert near(x["luma"], luma) and near(x["color_hist"], hist) and abs(sum(x["color_hist"]) - 3) < 1e-5


def test_plan_has_no_python(pictures):
    plan = X.visual_features(pictures[1], "r", "g", "b", "w")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_eight_orientations(spark):
    m = np.arange(12).reshape(3, 4)
    want = {1: m, 2: m[:, ::-1], 3: m[::-1, ::-1], 4: m[::-1], 5: m.T, 6: np.rot90(m, -1), 7: m[::-1, ::-1].T, 8: np.rot90(m)}
    df = spark.createDataFrame([(o, m.ravel().tolist(), 4) for o in want], "o int, g array<int>, w int")
    for x in df.select("o", X.oriented(F.col("g"), F.col("w"), F.col("o")).alias("g")).collect():
        assert x["g"] == want[x["o"]].ravel().tolist(), x["o"]


def test_comparison(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *[rng.integers(0, 256, 20).tolist() for _ in range(6)]) for i in range(5)] + [(9, *[[7] * 20] * 6), (10, *[[1] * 20] * 3, *[[1] * 19] * 3)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} array<int>" for c in "abcdef"))
    left, right = [F.col(c) for c in "abc"], [F.col(c) for c in "def"]
    shown, top = X.difference_map(left, right)
    got = {x["id"]: x for x in df.filter("size(a) = size(d)").select("id", X.mean_squared_error(left, right).alias("mse"), shown.alias("map"), top.alias("top")).collect()}
    for i, *grids in rows[:6]:
        m = np.array(grids, dtype=float)
        each = ((m[:3] - m[3:]) ** 2).sum(axis=0) / 3
        assert got[i]["mse"] == pytest.approx(each.mean()) and got[i]["top"] == pytest.approx(each.max())
        assert got[i]["map"] == (np.rint(np.log1p(each) / np.log1p(each.max()) * 255).astype(int).tolist() if each.max() else [0] * 20)
    assert df.filter("id = 10").select(X.mean_squared_error(left, right)).first()[0] is None


def test_identity_features(pictures):
    arrays, df = pictures
    for x in X.identity_features(df, "r", "g", "b", "w").collect():
        small = [resize(c, 32, 32) for c in arrays[x["id"]]]
        assert [x["small_red"], x["small_green"], x["small_blue"]] == [c.ravel().tolist() for c in small]
        g = resize(grey(*small), 9, 8)
        assert sum(a != b for a, b in zip(x["bits"], [int(g[i, j] >= g[i, j + 1]) for i in range(8) for j in range(8)])) <= 1
