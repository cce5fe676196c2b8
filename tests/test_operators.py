"""Operators on small inline tables."""

import datetime
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaloom.functions import media as M
from lumaloom.functions import metrics as X
from lumaloom.functions import times as T
from lumaloom.operators import browse, groups, lod, planning, reconcile, search, selection, snapshots
from lumaloom.sources import listing
from lumaloom.streaming import incremental

FILE = "file_id long, asset_id long, relative_path string, filename string, extension string, role string, is_online boolean, in_scope boolean, quality_score double, width int, height int, size_bytes long"
ASSET = "asset_id long, media_type string, capture_time string, selection_state string, group_id long"


def files(spark, rows):
    full = [(i, a, p, p.split("/")[-1], "." + p.split(".")[-1].lower(), r, on, scope, q, w, h, 10) for i, a, p, r, on, scope, q, w, h in rows]
    return spark.createDataFrame(full, FILE)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_browse_matrix(spark):
    """Every folder choice against the rule itself: a file counts if its own folder is chosen."""
    paths = ["zebra.png", "Trips/Apple.jpg", "Trips/2021/mango.cr3", "Trips/2021/May/kiwi.jpg", "Home/kiwi2.jpg"]
    sizes = [(300, 200), (200, 300), (50, 50), (0, 90), (640, 480)]
    f = files(spark, [(i + 1, i + 1, p, "original", True, True, 0.5 + i / 10, *sizes[i]) for i, p in enumerate(paths)])
    c = browse.browse_catalog(spark.createDataFrame([(i + 1, "image", None, "undecided", 4) for i in range(5)], ASSET), f)
    ids = lambda **k: sorted(r["asset_id"] for r in browse.facets(c, f, **k).collect())
    folders = [p.rpartition("/")[0] for p in paths]
    for chosen in ([], [""], ["Trips"], ["Trips/2021/May", "Home"], sorted(set(folders)), ["nowhere"], None):
        assert ids(folders=chosen) == [i + 1 for i, x in enumerate(folders) if chosen is None or x in chosen]
        assert sorted(r["asset_id"] for r in browse.browse_catalog(spark.createDataFrame([(i + 1, "image", None, "undecided", 4) for i in range(5)], ASSET), f, chosen).collect()) == ids(folders=chosen)
    assert ids(layout="horizontal") == [1, 3, 5] and ids(layout="vertical") == [2]
    assert ids(text="KIWI") == [4, 5]
    assert [r["filename"] for r in browse.ordered(c, "filename", False).collect()] == sorted((p.rpartition("/")[2] for p in paths), key=str.lower)
    assert browse.windows_of_groups(c, c).first()["n_members"] == 5
    with pytest.raises(ValueError):
        browse.facets(c, decision="maybe")


def test_preferred(spark):
    f = files(spark, [(1, 1, "a.cr3", "original", True, True, None, 0, 0), (2, 1, "b.jpg", "camera_jpeg", True, True, 0.4, 10, 5), (3, 1, "A.jpg", "original", True, True, None, 0, 0), (4, 1, "z.jpg", "camera_jpeg", False, True, None, 0, 0), (5, 2, "x.jxl", "original", True, True, None, 1, 1), (6, 2, "y.png", "original", True, True, None, 1, 1)])
    got = {r["asset_id"]: r["file_id"] for r in browse.preferred_file(f).collect()}
    assert got == {1: 2, 2: 6}


def test_paths_and_times(spark):
    p = spark.createDataFrame([("a/b.c/d.tar.gz",), ("x",), ("q/.hidden",)], "p string")
    got = [tuple(r) for r in p.select(M.parent_folder(F.col("p")), M.stem(F.col("p")), M.extension(F.col("p"))).collect()]
    assert got == [("a/b.c", "d.tar", ".gz"), ("", "x", ""), ("q", ".hidden", "")]
    assert spark.range(1).select(M.folder_prefixes(F.lit("a/b"))).first()[0] == ["", "a", "a/b"]
    wall = lambda v: one(spark, T.wall_clock_us(F.lit(v)))[0]
    assert wall("2024-01-02T12:34:56") == wall("2024-01-02T12:34:56+03:00") and wall("bad") is None and wall("2024-01-02") is None
    assert wall("2024-01-02T12:34:56.123000") - wall("2024-01-02T12:34:56") == 123000
    assert one(spark, T.exif_time(F.lit("2024:01:02 03:04:05"), F.lit("12"), F.lit("Z")))[0] == "2024-01-02T03:04:05.12+00:00"


def test_capture_seconds(spark):
    """Against the standard library: instants in UTC, local times by ordinal day, everything else null."""
    def model(v, kind):
        t = datetime.datetime.fromisoformat(v)
        if kind in T.ABSOLUTE:
            return t.timestamp() if t.tzinfo else None
        return t.toordinal() * 86400 + (t - t.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds() if kind == "exif_local_unknown" and not t.tzinfo else None

    values = [f"2023-03-0{d}T0{d}:10:20{f}{z}" for d in (1, 9) for f in ("", ".5") for z in ("", "Z", "+03:00", "-05:30")]
    cases = [(v, k) for v in values for k in (*T.ABSOLUTE, "exif_local_unknown", "file_time")]
    rows = spark.createDataFrame(cases, "v string, k string").select("v", "k", T.capture_seconds(F.col("v"), F.col("k")).alias("s")).collect()
    assert [r["s"] for r in rows] == [model(v, k) for v, k in cases]


def test_metrics(spark):
    lit = lambda *v: F.array(*map(F.lit, v))
    ham, err, few, many, times = one(spark, X.hamming_hex(F.lit("0" * 15 + "7"), F.lit("c" + "0" * 15)), X.rmse(lit(3.0), lit(3.0, 4.0)), X.sample_count(F.lit(0.4), 3, 4, 20), X.sample_count(F.lit(99.0), 3, 4, 20), X.sample_times(F.lit(6.0), F.lit(3)))
    assert (ham, few, many, times) == (5, 4, 20, [1.0, 3.0, 5.0]) and math.isinf(err)
    scores = [0.1, 0.7, 0.3, 0.95, 0.5, 0.2, 0.85, 0.6, 0.4]  # a quarter of nine is three of them
    assert abs(one(spark, X.top_quartile_mean(lit(*scores)))[0] - (0.95 + 0.85 + 0.7) / 3) < 1e-12
    got = [one(spark, *X.video_score(lit(*scores), F.lit(n))) for n in (9, 12, 13)]
    assert [(r[0] is None, r[1]) for r in got] == [(False, False), (False, True), (True, False)]
    assert [one(spark, X.quality_to_distance(F.lit(float(q))))[0] for q in (100, 90, 60, 33, -5)] == [0.0, 0.375, 1.5, 2.5125, 3.75]
    assert [one(spark, X.distance_to_quality(F.lit(d)))[0] for d in (0.0, 1.5, 9.0)] == [100.0, 60.0, 0.0]
    assert one(spark, X.normalized(F.array(F.lit(0.0), F.lit(0.0))))[0] is None
    assert [one(spark, M.valid_gps(F.lit(a), F.lit("5")))[0] for a in ("48.7", "91", None, "x")] == [True, False, False, False]
    y = one(spark, X.mercator_lat(X.mercator_y(F.lit(48.5))))[0]
    assert abs(y - 48.5) < 1e-9


def model_groups(rows, burst, sim):
    """Sequential model of strict grouping over all records at once."""
    out, home, before = [], {}, None
    for a, t, f in rows:
        if f is None:
            before = None
            continue
        mine = None
        if before and t - before[1] <= 0.5 and burst(before[2], f):
            mine = home[before[0]]
        else:
            best = None
            for g in out:
                if all(t - m[1] <= 10 for m in g) and all(sim(m[2], f) is not None for m in g):
                    rank = (-min(sim(m[2], f) for m in g), [m[0] for m in g])
                    if best is None or rank < best[0]:
                        best = (rank, g)
            mine = best[1] if best else None
        if mine is None:
            mine = []
            out.append(mine)
        mine.append((a, t, f))
        home[a] = mine
        before = (a, t, f)
    return {m[0]: min(x[0] for x in g) for g in out for m in g}


def test_strict_groups(spark):
    r = random.Random(5)
    t, rows = 0.0, []
    for i in range(400):
        t += r.choice([0.1, 0.4, 2, 5, 9, 30])
        rows.append((i, "absolute", round(t, 3), None if r.random() < 0.1 else r.random() * 10))
    df = spark.createDataFrame(rows + [(1000, "local", None, 1.0)], "asset_id long, semantics string, t double, f double")
    burst, sim = (lambda a, b: abs(a - b) < 6), (lambda a, b: 1 - abs(a - b) / 10 if abs(a - b) <= 3 else None)
    got = {x["asset_id"]: x["group_key"] for x in groups.strict_groups(df, lambda a, b: burst(a["f"], b["f"]), lambda a, b: sim(a["f"], b["f"]), ["f"]).collect()}
    assert got == model_groups([(a, t, f) for a, _, t, f in rows], burst, sim) | {1000: 1000}


def test_islands_across_ranges(spark):
    """Many small ranges: islands go on over their borders, whatever stream they are in."""
    r = random.Random(9)
    rows, want = [], {}
    for stream in ("absolute", "local", None):
        t, number = 0.0, 0
        for i in range(300):
            step = r.choice([0.0, 1.0, 4.0, 10.0, 10.5, 40.0]) if i else 0.0
            t, number = t + step, number + (step > 10)
            rows.append((len(rows), stream, t))
            want[len(rows) - 1] = number
    rows.append((len(rows), "local", None))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = groups.timeline_islands(spark.createDataFrame(rows, "k long, stream string, t double"), "t", "stream", 10.0, "k")
        assert {x["k"]: x["island"] for x in df.collect()} == want
        empty = groups.timeline_islands(spark.createDataFrame([], "k long, stream string, t double"), "t", "stream", 10.0, "k")
        assert empty.collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def sequential_markers(rows, overlap=0.55):
    anchors, out = [], {}
    for i, x, y, w, h in rows:
        best = None
        for k, (j, ax, ay, aw, ah) in enumerate(anchors):
            smaller = min(w * h, aw * ah)
            a = max(0.0, min(x + w, ax + aw) - max(x, ax)) * max(0.0, min(y + h, ay + ah) - max(y, ay))
            if smaller > 0 and a / smaller >= overlap and (best is None or (-a / smaller, k) < best[0]):
                best = ((-a / smaller, k), j)
        out[i] = best[1] if best else i
        if best is None:
            anchors.append((i, x, y, w, h))
    return out


def test_rectangle_merge(spark):
    r = random.Random(4)
    rows = [(i, r.uniform(-60, 60), r.uniform(-60, 60), r.choice([0.0, 6.0, 14.0]), r.choice([5.0, 10.0])) for i in range(400)]
    rows += [(400 + i, 500.0 + 4 * i, 500.0, 10.0, 10.0) for i in range(12)]  # a chain in which each waits for the one before
    rows += [(500, 900.0, 900.0, 4.0, 4.0), (501, 900.0, 900.0, 4.0, 4.0), (502, 900.0, 900.0, 4.0, 4.0)]
    schema = "id long, x double, y double, w double, h double"
    got = lod.merge_rectangles(spark.createDataFrame(rows, schema), ["id"]).collect()
    assert {g["id"]: g["anchor"] for g in got} == sequential_markers(rows) and len(got) == len(rows)
    alone = [(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 0.0, 1.0), (3, None, 5.0, 1.0, 1.0)]
    assert {tuple(g) for g in lod.merge_rectangles(spark.createDataFrame(alone, schema), ["id"]).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert lod.merge_rectangles(spark.createDataFrame([], schema), ["id"]).collect() == []


def test_components_and_reconcile(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50)], "a long, b long")
    got = {r["node"]: r["component"] for r in reconcile.min_label_components(e).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 100: 50}
    a = spark.createDataFrame([(1, "undecided", 3), (2, "selected", 9), (3, "selected", 1), (4, "rejected", 1)], "asset_id long, selection_state string, created_day int")
    f = spark.createDataFrame([(1, "image", "x"), (2, "image", "x"), (3, "image", "y"), (4, "image", "y")], "asset_id long, media_type string, sha256 string")
    assert {r["asset_id"]: r["survivor"] for r in reconcile.reconcile(a, f).collect()} == {1: 2, 2: 2}


def test_search_and_projection(spark):
    v = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [0.0, 1.0]), (2, 1, [1.0, 0.0]), (3, 0, [0.0, 0.0]), (4, 0, None)], "asset_id long, sample int, vec array<double>")
    got = [tuple(r) for r in search.search(v, np.array([[1.0, 0.0]]), 5).collect()]
    assert got == [(2, 1.0, 1, 0), (1, 0.0, 0, 0)]
    m = search.mean_vectors(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.6, 0.8, 0.0])], "asset_id long, vec array<double>")).first()["vec"]
    assert np.allclose(m, [0.8944, 0.4472, 0], atol=1e-4)
    r = np.random.default_rng(0)
    m = r.normal(size=(50, 5)) * [5, 2, 1, 1, 1]
    p = search.project(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "asset_id long, vec array<double>")).orderBy("asset_id").toPandas()
    _, _, axes = np.linalg.svd(m - m.mean(0), full_matrices=False)
    want = (m - m.mean(0)) @ axes[:2].T
    assert np.allclose(np.abs(p[["x", "y"]].to_numpy()), np.abs(want))
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3)], "asset_id long, vec array<double>")
    for n in (0, 1, 3):
        assert np.isfinite(search.project(same.limit(n)).toPandas()[["x", "y"]].to_numpy(dtype=float)).all()


def test_targets(spark):
    cols = "op_id long, target string, sha256 string, policy string"
    plan = spark.createDataFrame([(1, "out/file.jpg", "s", "rename"), (2, "out/file.jpg", "s", "rename"), (3, "out/FILE.jpg", "t", "rename"), (4, "out/file.jpg", "u", "skip"), (5, "out/old.jpg", "n", "overwrite"), (6, "out/x.jpg", None, "overwrite"), (7, "out/x.jpg", None, "overwrite"), (8, "out/same.jpg", "q", "rename"), (9, "out/file.jpg", "v", "rename")], cols)
    old = spark.createDataFrame([("out/old.jpg", "o"), ("out/same.jpg", "q"), ("out/File (2).jpg", None)], "target string, sha256 string")
    got = {r["op_id"]: (r["final"], r["status"]) for r in planning.resolve_targets(plan, old).collect()}
    assert got == {1: ("out/file.jpg", "ready"), 2: ("out/file.jpg", "already_satisfied"), 3: ("out/FILE (1).jpg", "renamed"), 4: ("out/file.jpg", "skipped"), 5: ("out/old.jpg", "overwrite"), 6: ("out/x.jpg", "ready"), 7: ("out/x.jpg", "conflict"), 8: ("out/same.jpg", "already_satisfied"), 9: ("out/file (3).jpg", "renamed")}
    own = spark.createDataFrame([(1, "a/b.jpg", "s", "skip", "A/b.jpg", "compress", True), (2, "c/d.jpg", "t", "skip", "c/d.jpg", "move", False), (3, "e/f.jpg", "u", "skip", "e/f.jpg", "compress", False)], cols + ", source string, operation string, replace boolean")
    assert {r["op_id"]: r["status"] for r in planning.resolve_targets(own, old).collect()} == {1: "replace_source", 2: "already_satisfied", 3: "skipped"}
    problem = lambda p: one(spark, planning.path_problem(F.lit(p)))[0]
    assert [problem(p) for p in ("/a", "a/../b", "a:b", "a /b", "x/con.txt", "fine/a.jpg")] == ["absolute", "parent", "character", "trailing", "device", None]


def test_snapshots(spark, tmp_path):
    cols = "path string, size long, mtime long, sha string, online boolean"
    old = spark.createDataFrame([("same", 1, 1, "a", True), ("edit", 1, 1, "b", True), ("gone", 1, 1, "c", True), ("orig", 1, 1, "d", True), ("x/locked", 1, 1, "e", True), ("m1", 1, 1, "f", True), ("m2", 1, 1, "f", True)], cols)
    new = spark.createDataFrame([("same", 1, 1, "a", True), ("edit", 2, 1, "b2", True), ("moved", 1, 1, "c", True), ("orig", 1, 1, "d", True), ("copy", 1, 1, "d", True), ("amb", 1, 1, "f", True)], cols)
    got = {r["path"]: r["outcome"] for r in snapshots.diff(old, new, ["x"]).collect()}
    assert got == {"same": "unchanged", "edit": "changed", "moved": "moved", "orig": "unchanged", "copy": "added", "x/locked": "blocked", "m1": "missing", "m2": "missing", "amb": "added"}
    base = f"file://{tmp_path}"
    assert snapshots.active(spark, base, "groups") is None
    for n in (3, 5):
        snapshots.publish(spark.range(n), base, "groups")
        assert snapshots.active(spark, base, "groups").count() == n


def test_listing(spark, tmp_path):
    for name, data in (("a.jpg", b"1"), ("sub/b.MP4", b"22"), ("sub/deep/c.jpg", b"333"), ("notes.txt", b"x"), (".index/z.jpg", b"y")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = listing.discover(spark, str(tmp_path), content=True)
    assert {r["path"]: (r["size"], r["sha"]) for r in found.collect()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.jpg", b"1"), ("sub/b.MP4", b"22"), ("sub/deep/c.jpg", b"333"))}
    totals = {r["folder"]: (r["files"], r["bytes"], dict(r["extensions"])) for r in listing.analyse_folders(found).collect()}
    assert totals[""] == (3, 6, {".jpg": 2, ".mp4": 1}) and totals["sub"][0] == 2


def test_folder_scan(spark, tmp_path):
    """Against a walk, for every number of parts; issues are rows, links and skipped names are not."""
    import os

    r, root = random.Random(3), tmp_path / "library"
    root.mkdir()
    folders = [""]
    for i in range(25):
        parent = r.choice(folders)
        folders.append(f"{parent}/f{i}".lstrip("/"))
        (root / folders[-1]).mkdir()
    for i in range(120):
        (root / r.choice(folders) / f"p{i}{r.choice(['.jpg', '.JXL', '.mp4', '.txt', '.tmp', ''])}").write_bytes(b"x" * i)
    for hidden in (".Index", "f1/.x.part"):
        (root / hidden).mkdir()
        (root / hidden / "in.jpg").write_bytes(b"")
    (root / "again").symlink_to(root / "f1")
    (root / "same.jpg").symlink_to(root / "f1")
    want = {}
    for at, _, names in os.walk(root):
        rel = os.path.relpath(at, root)
        if ".Index" in rel or ".part" in rel:
            continue
        for n in names:
            if n.lower().endswith((".jpg", ".jxl", ".mp4")) and n != "same.jpg":
                want[n if rel == "." else f"{rel}/{n}"] = os.path.getsize(os.path.join(at, n))
    for parts in (1, 2, 9, 64):
        got = listing.scan_tree(spark, str(root), parts=parts).collect()
        assert {x["path"]: x["size"] for x in got} == want and len(got) == len(want) and all(x["issue"] is None for x in got)
    gone = listing.scan_tree(spark, str(tmp_path / "nowhere"))
    assert [(x["path"], x["issue"]) for x in gone.collect()] == [("", "No such file or directory")]
    assert listing.unreadable(gone) == [""]


def test_unreadable_folder(tmp_path, monkeypatch):
    """One folder that can't be opened is one issue, and what lies around it is found."""
    import os

    for name in ("a/x.jpg", "b/y.jpg", "b/c/z.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    plain = os.scandir

    def refusing(at):
        if str(at).endswith("/b"):
            raise PermissionError(13, "Permission denied")
        return plain(at)

    monkeypatch.setattr(listing.os, "scandir", refusing)
    for parts in ("1", "3", "64"):
        reader = listing.FolderTree({"path": str(tmp_path), "parts": parts}).reader(None)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted((r[0], r[3]) for r in rows) == [("a/x.jpg", None), ("b", "Permission denied")]


def test_streaming(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 1, 2, 30, 31)] + [(2, "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "user long, ts string").select("user", F.col("ts").cast("timestamp_ntz").alias("ts")).write.parquet(src)
    s = incremental.event_stream(spark, src, "user long, ts timestamp_ntz", "ts")
    incremental.run_available(incremental.bursts(s, "ts", ["user"], "5 minutes"), out, state)
    assert sorted((r["user"], r["n"]) for r in spark.read.parquet(out).collect()) == [(1, 2), (1, 3)]
    done, ck = f"{tmp_path}/done", f"{tmp_path}/ck"
    raw = spark.readStream.schema("user long, ts timestamp_ntz").parquet(src)
    for _ in range(2):  # the second run finds nothing new
        incremental.derive_incrementally(raw, lambda b: b.select("user", F.hour("ts").alias("hour")), done, ck)
    assert spark.read.parquet(done).count() == 6


def test_selection_and_lod(spark):
    e = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.9, 0.0), (2, 1, [1.0, 0.01], 0.8, 0.0), (3, 1, [0.0, 1.0], 0.1, 0.0)], "id long, session int, vec array<double>, quality double, t double")
    assert {r["id"]: r["cluster"] for r in selection.complete_linkage(e, 0.1, 0.0).collect()} == {1: 1, 2: 1, 3: 3}
    assert [r["id"] for r in selection.diversified(e.withColumn("cluster", F.col("id")), 2, 0.7).orderBy("pick").collect()] == [1, 3]
    assert {r["id"] for r in selection.coverage(e, 2).collect()} >= {3}
    b = spark.createDataFrame([(0, 16), (2, 16)], "bucket long, n long")
    assert {r["bucket"]: r["density"] for r in lod.density(b).collect()} == {0: 7.0, 2: 7.0}
    assert [r["n"] for r in lod.zero_filled(b).orderBy("bucket").collect()] == [16, 0, 16]


def test_best_frame_of_every_label(spark, tmp_path):
    from lumaloom.plans import registry

    rows = [(i, [1.0, float(i)], i) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["agg_14_cmp_12_best_frame"](spark, str(tmp_path)).count() == 1200


def test_rules(spark):
    """Normalised rules, and errors for what is not one."""
    ok = planning.parse_rules(spark, [{"rule_id": "r", "position": 1, "match": {"folder_scope": {"mode": "all_except", "paths": ["B\\C/", "a", "A"]}, "formats": ["JPEG", "png"], "format": "Png", "origin": "external"}, "action": {"operation": "copy"}}]).first()
    assert (ok["scope"], ok["folders"], ok["formats"], ok["origin"], ok["replace"]) == ("except", ["a", "b/c"], ["png"], "source", False)
    for match in ({"folder_scope": "x"}, {"folder_scope": {"mode": "some"}}, {"folder_scope": {"mode": "only", "paths": ["a/../b"]}}, {"origin": "elsewhere"}):
        with pytest.raises(ValueError):
            planning.parse_rules(spark, [{"rule_id": "r", "position": 1, "match": match, "action": {"operation": "copy"}}])
    with pytest.raises(ValueError):
        planning.parse_rules(spark, [{"rule_id": "r", "position": 1, "match": {}, "action": {"operation": "paint"}}])


def test_selection_metrics(spark):
    """Against every assignment of chosen to wanted frames."""
    r = np.random.default_rng(5)
    rows = []
    for session in range(6):
        centre = r.normal(size=(3, 4))
        for i in range(9):
            v = centre[i % 3] + 0.25 * r.normal(size=4)
            rows.append((session * 100 + i, session, i % 3, v.tolist(), float(r.integers(0, 300)), bool(i in (0, 1, 3, 4)), bool(i in (1, 2, 3, 6))))
    df = spark.createDataFrame(rows, "id long, session long, cluster long, vec array<double>, t double, chosen boolean, wanted boolean")
    got = {x["session"]: x for x in selection.selection_metrics(df).collect()}
    for session in range(6):
        own = [x for x in rows if x[1] == session]
        mine, want = [x for x in own if x[5]], [x for x in own if x[6]]
        like = lambda a, b: float(np.dot(a[3], b[3]) / np.linalg.norm(a[3]) / np.linalg.norm(b[3]))
        edge = lambda a, b: a[0] == b[0] or like(a, b) >= 0.9 and abs(a[4] - b[4]) <= 120
        best = max(sum(edge(a, b) for a, b in zip(mine, p)) for p in itertools.permutations(want))
        near = sum(max(like(a, b) for b in mine if b is not a) >= 0.95 for a in mine) / len(mine)
        x = got[session]
        assert (x["k"], x["exact"], x["near"]) == (4, 2, best) and abs(x["repeated"] - near) < 1e-12 and abs(x["covered"] - len({a[2] for a in want} & {a[2] for a in mine}) / len({a[2] for a in want})) < 1e-12
    one_row = selection.average_metrics(selection.selection_metrics(df)).first()
    assert one_row["sessions"] == 6 and one_row["micro_exact"] == 0.5 and abs(one_row["near_overlap"] - sum(x["near"] for x in got.values()) / 24) < 1e-12


def test_greedy_selection(spark):
    """The first pick is the best by the rule alone; a second pick leaves its cluster and its copies."""
    rows = [(1, "s", 0, [1.0, 0.0], 0.9), (2, "s", 0, [1.0, 0.001], 0.89), (3, "s", 1, [0.0, 1.0], 0.3), (4, "s", 2, [0.6, 0.8], 0.2)]
    df = spark.createDataFrame(rows, "id long, session string, cluster long, vec array<double>, quality double")
    order = lambda d: [x["id"] for x in d.orderBy("pick").collect()]
    assert order(selection.diversified(df, 2, 0.55)) == [1, 3]
    assert order(selection.coverage(df, 2, 0.5, "mmr")) == [1, 3] and order(selection.coverage(df, 4, 1.0))[0] == 4


def test_blended_affinity_and_single_column_picks(spark):
    """Two encoders and time decide what is alike; against every order of picks by their definition."""
    r = np.random.default_rng(4)
    rows = [(i, 1, r.normal(size=6).tolist(), r.normal(size=6).tolist(), float(i * 40) if i % 4 else None, float(r.random()), float(r.random())) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, session long, vec array<double>, second array<double>, t double, quality double, sharpness double")
    unit = lambda k: np.array([np.array(x[k]) / np.linalg.norm(x[k]) for x in rows])
    a, b = unit(2) @ unit(2).T, unit(3) @ unit(3).T
    t = np.array([np.nan if x[4] is None else x[4] for x in rows])
    want = (0.65 * np.clip((a - 0.55) / 0.45, 0, 1) + 0.35 * np.clip((b - 0.75) / 0.25, 0, 1)) * (0.65 + 0.35 * np.nan_to_num(np.exp(-np.abs(t[:, None] - t) / 180)))
    np.fill_diagonal(want, 1)
    for strategy in ("coverage", "mmr"):
        got, left, near = [x["id"] for x in selection.coverage(df, 5, 0.6, strategy).orderBy("pick").collect()], set(range(12)), np.zeros(12)
        for i in got:
            gains = np.maximum(want - near, 0) @ (1 / np.maximum(want.sum(0), 1))
            score = 0.4 * np.array([x[5] for x in rows]) + (0.6 * gains / max(gains.max(), 1e-8) - 0.15 * np.clip((near - 0.85) / 0.15, 0, 1) if strategy == "coverage" else 0.6 * (1 - near))
            assert i == max(left, key=lambda j: (score[j], -j))
            left.remove(i)
            near = np.maximum(near, want[i])
    order = lambda by: [x["id"] for x in selection.picks(df, 3, by).orderBy("pick").collect()]
    assert order("laplacian") == sorted(range(12), key=lambda i: -rows[i][6])[:3] and order("time") == [1, 2, 3]


def test_capture_times_like_iso_parsing(spark):
    """Dates, hours and minutes alone are times too; what is no time stays null."""
    from datetime import datetime, timezone

    from lumaloom.functions import times

    values = ["2024-05-06", "2024-05-06T07", "2024-05-06T07:08", "2024-05-06 07:08:09", "2024-05-06T07:08:09.25", "2024-05-06T07:08+02:00", "2024-05-06T07:08:09Z", "2024-05-06T07-05:30", "2024-13-06", "2024-02-30T07:08", "noise", "", None]
    for kind in ("exif_offset", "exif_local_unknown"):
        df = spark.createDataFrame([(v, kind) for v in values], "v string, k string")
        for v, got in df.select("v", times.capture_seconds(F.col("v"), F.col("k"))).collect():
            try:
                t = datetime.fromisoformat(v)
            except (TypeError, ValueError):
                t = None
            if t is None or (t.tzinfo is None) == (kind == "exif_offset"):
                want = None
            else:
                want = t.astimezone(timezone.utc).timestamp() if kind == "exif_offset" else t.toordinal() * 86400 + t.hour * 3600 + t.minute * 60 + t.second + t.microsecond / 1e6
            assert got == want, (v, kind)


def test_preservation(spark):
    df = spark.createDataFrame([({"a": "X", "b": "1", "c": "z", "d": None, "e": " "}, {"a": " x ", "b": "2", "f": "new", "d": "now"})], "s map<string,string>, o map<string,string>")
    got = df.select(M.preservation(F.col("s"), F.col("o")).alias("r")).select("r.*").first()
    assert (got["preserved"], [tuple(c) for c in got["changed"]], got["lost"]) == (["a"], [("b", "1", "2")], ["c"])
    sizes = spark.createDataFrame([(4000, 3000), (3000, 4000), (100, 50), (1, 5000)], "w int, h int").select(*M.capped_size(F.col("w"), F.col("h"), 1920, 1080)).collect()
    assert [tuple(r) for r in sizes] == [(1440, 1080), (1080, 1440), (100, 50), (2, 1920)]


def test_groups_are_told_while_an_island_streams_in():
    """An island of any length is not held: groups leave as soon as nothing can join them, before its last batch is read."""
    import pyarrow as pa

    read = []

    def batches():
        for b in range(50):
            read.append(b)
            ids = list(range(b * 100, b * 100 + 100))
            yield pa.RecordBatch.from_pydict({"semantics": ["s"] * 100, "island": [0] * 100, "t": [float(i) for i in ids], "asset_id": ids, "f": [float(i % 7) for i in ids]})

    near = lambda a, b: 1.0 if a["f"] == b["f"] else None
    stream = groups._grouped(batches(), lambda a, b: False, near, ["f"])
    first = next(stream)
    assert len(read) <= 2 and first[0] == (0, 0)
    rest = [x for part in stream for x in part]
    assert sorted(i for i, _ in first + rest) == list(range(5000))
    assert all(k == i - (7 if i % 14 >= 7 else 0) for i, k in first + rest)


def test_text_is_folded_and_parsed_once(spark):
    """What a row's text says is worked out in one place of the plan, however often it is used."""
    from lumaloom.plans import registry

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([({"a": " X", "b": "Stra\u00dfe", "c": "1", "d": None}, {"a": "x", "b": "STRASSE", "c": "2", "d": "y"}), (None, None)], "s map<string,string>, o map<string,string>")
    told = df.select(M.preservation(F.col("s"), F.col("o")).alias("r"))
    assert plan(told).count("upper(") == 2
    first, none = told.select("r.*").collect()
    assert (first["preserved"], [tuple(c) for c in first["changed"]], first["lost"]) == (["a", "b"], [("c", "1", "2")], []) and none["preserved"] is None
    moments = registry.QUERIES["s_16_best_precision"](spark, "/root/testdata/sf0.001")
    assert plan(moments).count("from_json(") == 1


def test_both_timelines_from_one_pass(spark):
    """The modes together are the modes apart, and the files are grouped once."""
    assets = spark.createDataFrame([(1, "2024-01-01T00:00:00"), (2, None), (3, "2024-01-03T00:00:00")], "asset_id long, capture_time string")
    files = spark.createDataFrame(
        [(10 + k, k % 3 + 1, k % 4 > 0, True, ".jpg", "original", f"a/{k}.jpg", f"2024-02-0{k + 1}T00:00:00", f"2024-01-01T00:00:00.{'25' * (k % 2)}" if k % 2 else "unknown.123456") for k in range(8)],
        "file_id long, asset_id long, in_scope boolean, is_online boolean, extension string, role string, relative_path string, file_created_time string, exif_time string",
    )
    both = browse.timelines(assets, files, ["capture", "file_created"])
    apart = [(m, *r) for m in ("capture", "file_created") for r in browse.timeline_points(assets, files, m).collect()]
    assert sorted(tuple(r) for r in both.collect()) == sorted(apart) and len(apart) > 4
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_views_are_worked_out_once(spark):
    """Estimates and folder plans take each part of a path once; records of other components are no part of an embedding plan."""
    from lumaloom.plans import registry

    plan = lambda q: registry.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("agg_28_embedding_plan").count("Relation [l_orderkey") == 1
    # a name is spelled out once in each pass over the files
    for q in ("agg_19_28_estimate", "cmp_28_src_9_index_plan"):
        text = plan(q)
        assert 1 <= text.count("THEN IMG_") <= text.count("Relation [l_orderkey") * 2
