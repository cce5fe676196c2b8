"""Metadata, quality and timeline builders against plain Python."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lumaloom.functions import media as M
from lumaloom.functions import metrics as X
from lumaloom.functions import times as T
from lumaloom.operators import groups as G
from lumaloom.operators import lod as L
from lumaloom.operators import selection as Sel


def test_exif_moment_takes_the_first_date_with_its_own_parts(spark):
    cases = [
        ({"DateTimeOriginal": "2024:01:02 03:04:05", "SubSecTimeOriginal": " 12x ", "OffsetTimeOriginal": "+02:00", "DateTime": "2020:01:01 00:00:00"}, ("2024-01-02T03:04:05.120000+02:00", "exif_offset", 10_000)),
        ({"DateTimeDigitized": "2024:01:02 03:04:05", "SubSecTimeDigitized": "0", "OffsetTimeOriginal": "Z"}, ("2024-01-02T03:04:05+00:00", "exif_offset", 100_000)),
        ({"DateTime": "2024:01:02 03:04:05", "SubSecTime": "1234567", "OffsetTime": ""}, ("2024-01-02T03:04:05.123456", "exif_local_unknown", 1)),
        ({"DateTime": "soon", "OffsetTime": "+01:00"}, ("soon", "exif_local_unknown", 1_000_000)),
        ({"SubSecTime": "5"}, None), ({}, None), (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, exif map<string,string>")
    got = {r["i"]: r["m"] and tuple(r["m"]) for r in df.select("i", T.exif_moment(F.col("exif")).alias("m")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_gps_position(spark):
    schema = "GPSLatitude array<string>, GPSLatitudeRef string, GPSLongitude array<string>, GPSLongitudeRef string, GPSAltitude string, GPSAltitudeRef string, GPSImgDirection string, GPSDateStamp string, GPSTimeStamp array<string>"
    rows = [
        (["10/1", "30/1", "3600/100"], "S", ["1", "0", "0"], "e", "50/2", "1", "90", "2024:05:06", ["1/1", "2", "3.50"]),
        (["10", "1/0", "0"], "N", ["1", "2"], "W", "x", None, "1/0", "2024:05:06", ["1", "2", "0"]),
        (None, None, None, None, None, None, None, None, ["1", "2", "3"]),
    ]
    got = [tuple(r["g"]) for r in spark.createDataFrame(rows, schema).select(M.gps_position(F.struct("*")).alias("g")).collect()]
    assert got[0] == (pytest.approx(-(10 + 0.5 + 36 / 3600)), 1.0, -25.0, 90.0, "2024:05:06T01:02:03.5")
    assert got[1] == (None, None, None, None, "2024:05:06T01:02:00") and got[2] == (None,) * 5


def test_camera_identity_needs_one_name(spark):
    rows = [(1, " Lumen", "X"), (1, "LUMEN ", "x"), (1, None, " "), (2, "a", "x"), (2, "a", "y"), (3, None, None), (4, "", "M")]
    g = spark.createDataFrame(rows, "id int, make string, model string").groupBy("id").agg(M.camera_identity(F.col("make"), F.col("model")).alias("c"))
    assert {r["id"]: r["c"] and tuple(r["c"]) for r in g.collect()} == {1: ("lumen", "x"), 2: None, 3: None, 4: ("", "m")}


def test_technical_quality_equals_the_formula(spark):
    rng = random.Random(3)
    rows = [tuple(rng.uniform(-1, top) for top in (40.0, 0.3, 0.3, 90.0, 30.0)) for _ in range(300)] + [(28.0, 0.0, 0.0, 64.0, 0.0), (None, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "f double, u double, o double, c double, n double")
    got = df.select(X.technical_quality(*map(F.col, "fuocn")).alias("q")).collect()
    unit = lambda x: min(1.0, max(0.0, x))
    for (f, u, o, c, n), r in zip(rows[:-1], got[:-1], strict=True):
        want = [round(unit((f - 2) / 26), 6), round(1 - unit((u + o) / 0.2), 6), round(unit((c - 8) / 56), 6), round(1 - unit(n / 18), 6)]
        assert list(r["q"])[:4] == pytest.approx(want, abs=1e-9)
        assert r["q"]["score"] == pytest.approx(0.35 * want[0] + 0.3 * want[1] + 0.2 * want[2] + 0.15 * want[3], abs=6e-7)
    assert got[-2]["q"]["score"] == 1.0 and got[-1]["q"]["focus"] is None and got[-1]["q"]["score"] is None


def test_bucket_bounds_follow_the_calendar(spark):
    times = [datetime(2023, 12, 31, 23, 59, 59, 999999, UTC), datetime(2024, 2, 29, tzinfo=UTC), datetime(1969, 11, 5, 1, tzinfo=UTC)]
    us = [int(t.timestamp()) * 1_000_000 + t.microsecond for t in times]
    df = spark.createDataFrame([(u, i) for u in us for i in (40_000_000, 31_536_000, 7_776_000, 2_592_000, 604_800)], "us long, i long")
    start, end = L.bucket_bounds(F.col("us"), F.col("i") * 1_000_000)
    stamp = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000
    for r in df.select("us", "i", start.alias("a"), end.alias("b")).collect():
        t = times[us.index(r["us"])]
        months = next((m for least, m in ((31_536_000, 12), (7_776_000, 3), (2_592_000, 1)) if r["i"] >= least), None)
        if months:
            first = (t.month - 1) // months * months
            assert (r["a"], r["b"]) == (stamp(t.year, first + 1, 1), stamp(t.year + (first + months) // 12, (first + months) % 12 + 1, 1))
        else:
            step = r["i"] * 1_000_000
            assert (r["a"], r["b"]) == (r["us"] // step * step, r["us"] // step * step + step)


def test_view_states(spark):
    some, none = spark.createDataFrame([(1,)], "asset_id long"), spark.createDataFrame([], "asset_id long")
    state = lambda *a, **k: tuple(L.view_state(*a, **k).first())
    assert state("geo", some, some) == ("geo", 1, 1, True, None)
    assert state("geo", some, none)[4] == L.EMPTY["geo"] and state("geo", none, none)[4] == L.NOTHING
    assert state("timeline", some, none, "geo")[4] == L.EMPTY["capture"] and state("timeline", some, none, "file_created")[4] == L.EMPTY["file_created"]
    assert state("vector", none, none)[4] == L.EMPTY["vector"] and state("vector", some, None, reason="why") == ("vector", 1, 0, False, "why")
    with pytest.raises(ValueError):
        L.view_state("map", some, some)


def test_representatives_by_meaning_of_time(spark):
    rows = [
        (1, 1, 0.5, "2024-01-01T00:00:00", "exif_local_unknown"), (1, 2, 0.5, "2025-01-01T00:00:00Z", "exif_offset"), (1, 3, 0.5, "2000-01-01", "exif_offset"), (1, 4, None, "1990-01-01T00:00:00Z", "exif_offset"),
        (2, 5, None, None, None), (2, 6, None, "2024-01-01T00:00:00", "exif_local_unknown"), (3, 8, 0.9, None, None), (3, 7, 0.9, None, None), (None, 9, 1.0, None, None),
    ]
    items = spark.createDataFrame(rows, "group_id long, asset_id long, quality double, capture_time string, capture_time_kind string")
    assert {r["group_id"]: r["asset_id"] for r in G.representatives(items).collect()} == {1: 2, 2: 6, 3: 7}
    assert {r["group_id"]: r["asset_id"] for r in G.representatives(items.drop("capture_time_kind")).collect()} == {1: 3, 2: 6, 3: 7}


def test_recommendation_statistics(spark):
    rows = [(1, 1, True), (1, 2, True), (1, 3, False), (2, 4, True), (3, 5, False), (4, 6, True), (4, 7, True), (4, 8, True)]
    d = spark.createDataFrame(rows, "group_id long, asset_id long, recommended boolean")
    assert tuple(Sel.recommendation_stats(d).first()) == (8, 6, 2, 1, 1, 1, 1, 1) and tuple(Sel.recommendation_stats(d.limit(0)).first()) == (0,) * 8
    a = spark.createDataFrame([(1, "selected"), (2, None), (3, "undecided")], "asset_id long, selection_state string")
    assert tuple(Sel.recommendation_counts(d, a).first()) == (8, 6, 1, 0, 1)
