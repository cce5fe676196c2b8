"""Asset summaries and details in the cases that tell the rules apart."""

from lumaloom.operators import summaries as V

FILE = "file_id long, asset_id long, relative_path string, filename string, extension string, media_type string, role string, in_scope boolean, is_online boolean, quality_score double, width int, height int, size_bytes long, sha256 string, mtime long, duration double, codec string, quality_record string"


def file(key, asset, path, scope=True, online=True, score=None, size=(0, 0), codec=None, role="original", record=None):
    ext = "." + path.rsplit(".", 1)[1]
    return (key, asset, path, path.rsplit("/", 1)[-1], ext.lower(), "video" if ext == ".mp4" else "image", role, scope, online, score, *size, 10, "h", 0, None, codec, record)


def frames(spark, rows):
    files = spark.createDataFrame(rows, FILE)
    assets = spark.createDataFrame([(a, "image", None, None, "undecided", 7 if a == 1 else None) for a in range(1, 8)], "asset_id long, media_type string, capture_time string, capture_time_kind string, selection_state string, group_id long")
    states = spark.createDataFrame(
        [(1, "thumbnail", "complete", "t/1"), (2, "metadata", "failed", None), (3, "thumbnail", "complete", ""), (5, "quality", "running", None), (8, "metadata", "unsupported", None), (9, "thumbnail", "complete", "t/9")], "file_id long, component string, status string, output_path string"
    ).selectExpr("file_id", "component", "'v' AS version", "status", "'i' AS input_fingerprint", "output_path", "'o' AS output_fingerprint")
    decisions = spark.createDataFrame([(1, True, False)], "asset_id long, representative boolean, recommended boolean")
    groups = spark.createDataFrame([(7, 3)], "group_id long, members long")
    return assets, files, states, decisions, groups


ROWS = [
    file(1, 1, "a/raw.cr3", score=0.9, size=(9, 9), codec="raw"), file(2, 1, "a/out.jpg", scope=False, score=0.8, size=(4, 3)),  # only the RAW file is in scope
    file(3, 2, "b/x.jpg", online=False), file(4, 2, "b/y.jpg", scope=False, online=True, score=0.5),  # in scope and offline
    file(5, 3, "c/p.jpg", score=None), file(6, 3, "c/q.dng", score=0.7, record='{"quality_source": "raw_embedded_preview"}'),  # the RAW score does not stand in
    file(7, 4, "d/only.dng", scope=False, score=0.6, record='{"quality_source": "raw_embedded_preview"}'), file(8, 4, "d/two.dng", scope=False, online=False, score=0.95),  # all RAW, none in scope
    file(9, 5, "e/z.jxl", codec="jpeg-xl", size=(0, 5)), file(10, 5, "e/z.mp4", online=False, codec="h264", size=(2, 2)),
]


def test_summaries(spark):
    rows = {r["asset_id"]: r for r in V.asset_summaries(*frames(spark, ROWS), run_id="r").collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    one = rows[1]
    assert (one["filename"], one["thumbnail_file_id"], one["display_kind"], one["quality_score"], one["issues"]) == ("raw.cr3", 1, "preview", 0.9, [])
    assert (one["physical_count"], one["strict_group_member_count"], one["is_representative"], one["auto_recommended"], one["width"]) == (2, 3, True, False, 9)
    two = rows[2]
    assert (two["is_online"], two["original_file_id"], two["display_file_id"], two["quality_score"], two["thumbnail_file_id"], two["issues"], two["display_kind"]) == (True, None, None, None, None, ["offline"], None)
    assert (rows[3]["quality_score"], rows[3]["quality_source"], rows[3]["issues"]) == (None, None, ["processing"])
    assert (rows[4]["quality_score"], rows[4]["quality_source"], rows[4]["issues"], rows[4]["display_kind"]) == (0.6, "RAW embedded preview", ["unsupported"], "preview")
    assert (rows[5]["codec"], rows[5]["display_kind"], rows[5]["width"], rows[5]["strict_group_member_count"]) == ("jpeg-xl", "preview", 2, None)


def test_summaries_of_nothing(spark):
    a, f, s, d, g = frames(spark, ROWS)
    assert V.asset_summaries(a, f.limit(0), s, d, g).count() == 0 and V.asset_summaries(a, f, s.limit(0), d.limit(0), g.limit(0)).count() == 5


def test_details_put_the_preferred_file_first(spark):
    a, f, s, _, _ = frames(spark, ROWS)
    relations = spark.createDataFrame([(4, "raw_jpeg"), (4, "exact_duplicate"), (4, "raw_jpeg")], "file_id long, kind string")
    made = spark.createDataFrame([(9, "jpeg-xl", None)], "file_id long, codec string, profile string")
    places = spark.createDataFrame([(2, "10", "20"), (1, "none", "20"), (3, "95", "1"), (4, "5", "6"), (7, "-90", "180"), (8, "1", "1")], "file_id long, latitude string, longitude string")
    rows = {r["asset_id"]: r for r in V.asset_details(a, f, s, relations, made, places).collect()}
    assert [x["file_id"] for x in rows[2]["files"]] == [3, 4] and rows[2]["files"][1]["relationships"] == ["exact_duplicate", "raw_jpeg"]
    assert rows[2]["files"][1]["label"] == "Exact duplicate" and rows[5]["files"][0]["label"] == "JPEG XL derivative · managed profile" and rows[1]["files"][0]["label"] == "RAW source"
    assert rows[1]["location"] is None and rows[2]["location"] is None  # files out of scope do not stand in
    assert tuple(rows[4]["location"]) == (-90.0, 180.0) and rows[1]["files"][0]["components"]["thumbnail"]["status"] == "complete" and rows[1]["files"][0]["components"]["metadata"]["status"] is None


def test_details_exchange_rows_once(spark):
    """files meet their asset as rows with what is wanted of them, not as lists of structs and keys that repeat their texts."""
    a, f, s, _, _ = frames(spark, ROWS)
    relations = spark.createDataFrame([(4, "exact_duplicate")], "file_id long, kind string")
    made = spark.createDataFrame([(9, "jpeg-xl", None)], "file_id long, codec string, profile string")
    places = spark.createDataFrame([(7, "-90", "180")], "file_id long, latitude string, longitude string")
    full, few = (V.asset_details(a, f, s, relations, made, places, c) for c in (None, ["relative_path", "role"]))
    plan = few._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)
    assert any("collect_list" in line for line in plan[:at]) and not any("collect_list" in line or "min_by" in line for line in plan[at:])
    assert not any("sha256" in line for line in plan[: at + 2])
    short, whole = ({r["asset_id"]: r for r in df.collect()} for df in (few, full))
    assert short.keys() == whole.keys() == {1, 2, 3, 4, 5}
    for k, r in short.items():
        assert r["location"] == whole[k]["location"] and len(r["files"]) == len(whole[k]["files"])
        for x, y in zip(r["files"], whole[k]["files"]):
            assert x.asDict() == {n: y[n] for n in ("file_id", "relative_path", "role", "label", "original", "thumbnail", "components")}


def test_summaries_of_assets_with_many_files(spark, monkeypatch):
    """files meet their asset as plain rows; those of an asset with many files are aggregated in parts first, to the same rows."""
    given = frames(spark, ROWS)
    plan = V.asset_summaries(*given)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)
    assert "min(" in "".join(plan[:at]) and "min(" not in plan[at + 1]
    want = {r["asset_id"]: r for r in V.asset_summaries(*given).collect()}
    assert len(want) == 5
    for hot in (0, 1):
        monkeypatch.setattr(V, "HOT", hot)
        rows = V.asset_summaries(*given).collect()
        assert len(rows) == 5 and {r["asset_id"]: r for r in rows} == want
