"""Folder reports, index plans and estimates against models in plain Python."""

import os
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumaloom.operators import estimates as E
from lumaloom.sources.listing import folder_report

FILES = [
    ("a.jpg", 10), ("B.JPG", None), ("notes", 7), ("x/one.cr3", 5), ("x/y/two.png", 4), ("x/y/three.heic", 3), ("x/y/four.heic", 2), ("x/y/five.txt", 9), ("x/y/.hidden", 1),
    ("x/y/six.mp4", 100), ("x/y/Seven.jpg", 6), ("x/y/eight.jpg", 6), ("x/y/nine.jpg", 6), ("x/y/nine.jpg2", 6), ("z/deep/er/p.webp", 1), ("X/other.jpg", 1),
]
CATEGORY = {".jpg": "jpeg", ".cr3": "raw", ".png": "other_image", ".heic": "other_image", ".webp": "other_image", ".mp4": "video"}


def extension(path):
    return os.path.splitext(os.path.basename(path))[1].lower() or "(none)"


def model():
    rows = defaultdict(lambda: {"direct_files": 0, "files": 0, "direct_bytes": 0, "bytes": 0, "recognized_files": 0, "recognized_bytes": 0, "direct_extensions": Counter(), "direct_extension_bytes": Counter(), "extensions": Counter(), "direct_categories": Counter(), "categories": Counter(), "examples": []})
    for path, size in FILES:
        own, ext, size = os.path.dirname(path), extension(path), size or 0
        cat = CATEGORY.get(ext, "other")
        parts = own.split("/") if own else []
        for folder in ["/".join(parts[:i]) for i in range(len(parts) + 1)]:
            r = rows[folder]
            r["files"] += 1
            r["bytes"] += size
            r["extensions"][ext] += 1
            r["categories"][cat] += 1
            if cat != "other":
                r["recognized_files"] += 1
                r["recognized_bytes"] += size
        r = rows[own]
        r["direct_files"] += 1
        r["direct_bytes"] += size
        r["direct_extensions"][ext] += 1
        r["direct_extension_bytes"][ext] += size
        r["direct_categories"][cat] += 1
        if cat != "other":
            r["examples"].append(os.path.basename(path))
    for r in rows.values():
        r["examples"] = sorted(r["examples"], key=str.casefold)[:5]
    return {k: {a: dict(b) if isinstance(b, Counter) else b for a, b in r.items()} for k, r in rows.items()}


def test_folder_report_equals_a_walk(spark):
    listing = spark.createDataFrame(FILES, "path string, size long")
    got = {r["folder"]: {k: v for k, v in r.asDict().items() if k != "folder"} for r in folder_report(listing).collect()}
    assert got == model()
    assert folder_report(listing.limit(0)).count() == 0


def test_folder_plan_takes_the_last_extension_of_a_category(spark):
    report = folder_report(spark.createDataFrame(FILES, "path string, size long"))
    o = E.IndexOptions(folders={"X/Y": False}, videos=False, raw_quality=False, semantic=True)
    reusable = spark.createDataFrame([("x/y/two.png",), ("x/y/six.mp4",), ("gone/a.jpg",)], "path string")
    rows = {r["folder"]: r for r in E.folder_plan(report, reusable, o).collect()}
    for folder, m in model().items():
        r, taken = rows[folder], {e: n for e, n in sorted(m["direct_extensions"].items()) if CATEGORY.get(e, "other") not in ("other", "video")}
        last = {CATEGORY[e]: n for e, n in taken.items()}
        files, images, raw = sum(taken.values()), last.get("jpeg", 0) + last.get("other_image", 0), last.get("raw", 0)
        assert (r["supported_files"], r["supported_bytes"]) == (files, sum(m["direct_extension_bytes"][e] for e in taken))
        assert r["plan_categories"] == last and r["plan_extensions"] == taken and r["selected"] == (folder != "x/y")
        eta = round(1 + files * 0.225 + images * 0.48 + raw * 0.30 + (images + raw) * 0.25, 1)
        assert r["eta_seconds"] == eta and r["reusable_files"] == (folder == "x/y")
        assert r["pending_eta_seconds"] == (round(eta * (files - r["reusable_files"]) / files, 1) if files else 0)
    assert rows["x/y"]["plan_categories"]["other_image"] == 1  # .heic has two


def test_rates_come_from_the_latest_timed_jobs(spark):
    rows = [(i, {"scan.hashing": 1.0}, {"scan.hashing": 2.0}) for i in range(8)] + [(-1, {"scan.hashing": 900.0}, {"scan.hashing": 1.0}), (99, None, {"x": 1.0})]
    rows += [(50, {"metadata.processing": 0.001}, {"metadata.processing": 10.0}), (51, {"reconciliation": 5.0}, {"reconciliation": 0.0})]
    t = spark.createDataFrame(rows, "finished long, seconds map<string,double>, counts map<string,double>")
    r = E.historical_rates(t).first()["rates"]
    assert r["scan_hashing"] == 0.5 and r["metadata_processing"] == 0.14 * 0.45 and r["reconciliation"] == 0.035
    assert E.historical_rates(t.limit(0)).first()["rates"]["thumbnail_video"] == 1.10


def test_an_empty_catalog_has_fixed_costs_only(spark):
    files = spark.createDataFrame([], "file_id long, asset_id long, relative_path string, extension string, media_type string, in_scope boolean, is_online boolean, duration double")
    states = spark.createDataFrame([], "file_id long, component string, status string")
    rates = E.historical_rates(spark.createDataFrame([], "finished long, seconds map<string,double>, counts map<string,double>"))
    r = E.index_seconds(E.indexed_work(files, states, states, E.IndexOptions(semantic=True)), rates).first()
    assert (r["files"], r["scan_seconds"], r["strict_grouping_seconds"], r["estimated_seconds"]) == (0, 1.0, 0.0, 1.8)


def test_time_left_by_step_pace_or_rate(spark):
    jobs = [(1, "running", "scan", 10, 4, 100, None), (2, "running", "scan", 10, 4, 100, -3.0), (3, "pending", "scan", 10, 0, None, float("nan")), (4, "running", "other", 10, 10, 100, None), (5, "complete", "scan", 10, 4, 100, 1.0), (6, "running", "embeddings", None, None, None, None), (7, "running", None, 5, -1, 100, None)]
    df = spark.createDataFrame(jobs, "id long, status string, kind string, total long, completed long, at long, eta double").withColumn("started", F.timestamp_seconds("at"))
    rates = E.historical_rates(spark.createDataFrame([], "finished long, seconds map<string,double>, counts map<string,double>"))
    got = {r["id"]: r["seconds"] for r in E.job_seconds(df, rates, F.timestamp_seconds(F.lit(108))).collect()}
    assert got == {1: 12.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: None, 6: 1.0, 7: 1.0}
