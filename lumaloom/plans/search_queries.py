"""Vector search, projection, maps and timelines (SRT-5..7/13, AGG-14/16, CMP-12..25, CMP-30, WIN-10, UDF, SRC-8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import pixels as X
from ..operators import lod as L
from ..operators import search as S
from ..operators.scratch import written
from .browse_queries import PREF
from .catalog import load
from .registry import query

UNIT = "(SELECT vec_id, label, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
COS = "list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (v.n * q.n)"


def frames(spark, d, asset="vec_id"):
    return load(spark, d, "embeddings").select(F.expr(asset).alias("asset_id"), F.col("vec_id").alias("sample"), F.col("embedding").alias("vec"))


def query_vectors(spark, d, *ids):
    """A handful of stated vectors: the query side of a search."""
    rows = load(spark, d, "embeddings").filter(F.col("vec_id").isin(*ids)).orderBy("vec_id").select("embedding").collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


@query("srt_5_6_exact_top_k", f"SELECT v.vec_id AS asset_id, round({COS}, 6) AS similarity FROM {UNIT} v, {UNIT} q WHERE q.vec_id = 7 ORDER BY {COS} DESC, v.vec_id LIMIT 50", views=False)
def srt_5(spark, d):
    return S.search(frames(spark, d), query_vectors(spark, d, 7), 50).select("asset_id", F.round("similarity", 6).alias("similarity"))


@query("agg_14_cmp_12_best_frame", f"SELECT v.label AS asset_id, round(max({COS}), 6) AS similarity, max_by(v.vec_id, {COS}) AS sample FROM {UNIT} v, {UNIT} q WHERE q.vec_id = 11 GROUP BY v.label", views=False)
def agg_14(spark, d):
    return S.search(frames(spark, d, "label"), query_vectors(spark, d, 11), None).select("asset_id", F.round("similarity", 6).alias("similarity"), "sample")


@query("cmp_12_filtered_search", f"SELECT v.vec_id AS asset_id, round({COS}, 6) AS similarity FROM {UNIT} v, {UNIT} q WHERE q.vec_id = 3 AND v.vec_id % 3 = 0 ORDER BY {COS} DESC, v.vec_id LIMIT 20", views=False)
def cmp_12(spark, d):
    allowed = load(spark, d, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").alias("asset_id"))
    return S.search(frames(spark, d), query_vectors(spark, d, 3), 20, allowed).select("asset_id", F.round("similarity", 6).alias("similarity"))


@query("cmp_13_query_by_example", f"WITH s AS (SELECT v.vec_id, max({COS}) AS similarity, CAST(CASE WHEN max_by(q.vec_id, {COS}) = 5 THEN 0 WHEN max_by(q.vec_id, {COS}) = 6 THEN 1 ELSE 2 END AS INT) AS source FROM {UNIT} v, {UNIT} q WHERE q.vec_id IN (5, 6, 8) AND v.vec_id NOT IN (5, 6, 8) GROUP BY v.vec_id) SELECT vec_id AS asset_id, round(similarity, 6) AS similarity, source FROM s ORDER BY s.similarity DESC, vec_id LIMIT 30", views=False)
def cmp_13(spark, d):
    """Best of the source's frames against every candidate, the source itself left out."""
    v = frames(spark, d).filter("asset_id not in (5, 6, 8)")
    return S.search(v, query_vectors(spark, d, 5, 6, 8), 30).select("asset_id", F.round("similarity", 6).alias("similarity"), "source")


@query("srt_7_strong_matches", f"WITH s AS (SELECT v.vec_id, {COS} AS c FROM {UNIT} v, {UNIT} q WHERE q.vec_id = 0 AND v.vec_id <> 0) SELECT count_if(c >= 0.3) AS strong, least(count_if(c >= 0.3), 24) AS first_page FROM s", views=False)
def srt_7(spark, d):
    s = S.search(frames(spark, d), query_vectors(spark, d, 0), None, exclude=0)
    n = F.count_if(F.col("similarity") >= 0.3)
    return s.agg(n.alias("strong"), F.least(n, F.lit(24)).alias("first_page"))


@query("agg_16_mean_vectors", "WITH u AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings), e AS (SELECT label, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS i FROM u), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT m.label AS asset_id, round(max(CASE WHEN i = 1 THEN m / n END), 6) AS first, round(max(CASE WHEN i = 64 THEN m / n END), 6) AS last FROM m JOIN n ON m.label = n.label GROUP BY m.label", views=False)
def agg_16(spark, d):
    m = S.mean_vectors(frames(spark, d, "label"))
    return m.select("asset_id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", -1), 6).alias("last"))


@query("cmp_14_projection")
def cmp_14(spark, d):
    """Principal axes; compared with numpy in the tests."""
    return S.project(frames(spark, d))


@query("cmp_15_projection_currency", """WITH c AS (SELECT 'same' AS change, 'r1' AS run, vec_id FROM embeddings UNION ALL SELECT 'fewer', 'r1', vec_id FROM embeddings WHERE vec_id <> 1 UNION ALL SELECT 'other id', 'r1', CASE WHEN vec_id = 1 THEN -1 ELSE vec_id END FROM embeddings UNION ALL SELECT 'other run', 'r2', vec_id FROM embeddings),
 g AS (SELECT change, run, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(CAST(vec_id AS STRING)), 1, 10) AS BIGINT)) AS STRING) AS digest FROM c GROUP BY ALL) SELECT g.change, g.n, g.digest, g.run = 'r1' AND g.n = s.n AND g.digest = s.digest AS current FROM g, (SELECT * FROM g WHERE change = 'same') s""", views=False)
def cmp_15(spark, d):
    """A stored projection against the same set, one id fewer, another id and another run."""
    ids = frames(spark, d).select("asset_id")
    n, digest = S.set_digest(ids)
    stored, out = {"run_id": "r1", "n": n, "digest": digest}, []
    swapped = ids.select(F.when(F.col("asset_id") == 1, -1).otherwise(F.col("asset_id")).alias("asset_id"))
    for change, run, some in (("same", "r1", ids), ("fewer", "r1", ids.filter("asset_id <> 1")), ("other id", "r1", swapped), ("other run", "r2", ids)):
        out.append((change, *S.set_digest(some), S.is_current(stored, run, some)))
    return spark.createDataFrame(out, "change string, n long, digest string, current boolean")


GEO = "(SELECT file_id AS id, asset_id, CASE WHEN file_id % 23 = 0 THEN 91.0 ELSE (file_id % 1700) / 10.0 - 85 END AS lat, (file_id % 3600) / 10.0 - 180 AS lon, quality_score AS quality, relative_path, in_scope, is_online, extension, role, file_id FROM file WHERE in_scope)"


def geo(spark, d):
    f = F.col("file_id")
    return load(spark, d, "file").filter("in_scope").select(f.alias("id"), "asset_id", F.when(f % 23 == 0, 91.0).otherwise((f % 1700) / F.lit(10.0) - 85).alias("lat"), ((f % 3600) / F.lit(10.0) - 180).alias("lon"), F.col("quality_score").alias("quality"), "relative_path", "in_scope", "is_online", "extension", "role", "file_id")


@query("cmp_16_geo_points", f"SELECT asset_id, lat AS latitude, lon AS longitude FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS k FROM {GEO} WHERE lat BETWEEN -90 AND 90) WHERE k = 1 /* FROM file */")
def cmp_16(spark, d):
    """The most preferred file with a valid place; a preferred file without one gives way."""
    g = geo(spark, d).filter(M.valid_gps(F.col("lat"), F.col("lon")))
    key = M.preference(F.col("in_scope"), F.col("is_online"), F.col("extension"), F.col("role"), F.col("relative_path"), F.col("file_id"))
    return g.groupBy("asset_id").agg(F.min_by(F.struct("lat", "lon"), key).alias("p")).select("asset_id", F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"))


@query("src_8_has_gps", f"SELECT count(*) > 0 AS has_gps FROM {GEO} WHERE lat BETWEEN -90 AND 90 /* FROM file */")
def src_8(spark, d):
    """Stops at the first hit."""
    return spark.createDataFrame([(not geo(spark, d).filter("lat between -90 and 90").limit(1).isEmpty(),)], "has_gps boolean")


@query("cmp_17_srt_13_timeline_points", f"""WITH t AS (SELECT f.*, a.capture_time, strftime(f.mtime, '%Y-%m-%dT%H:%M:%S') AS created, CASE WHEN f.file_id % 6 = 0 THEN a.capture_time || '.250' WHEN f.file_id % 6 = 1 THEN a.capture_time || '.5' WHEN f.file_id % 6 = 2 THEN 'unknown.123456' END AS exif FROM file f JOIN asset a ON f.asset_id = a.asset_id WHERE f.in_scope),
 c AS (SELECT asset_id, created FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS k FROM t) WHERE k = 1), e AS (SELECT asset_id, exif FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY length(exif) DESC, {PREF}) AS k FROM t WHERE exif LIKE '2%' OR exif LIKE '1%') WHERE k = 1),
 p AS (SELECT 'capture' AS mode, a.asset_id, coalesce(e.exif, a.capture_time) AS v FROM asset a LEFT JOIN e ON a.asset_id = e.asset_id UNION ALL SELECT 'file_created', asset_id, created FROM c)
 SELECT mode, asset_id, epoch_us(TRY_CAST(v AS TIMESTAMP)) AS time_us, CAST(CASE WHEN v LIKE '%.250' THEN 1000 WHEN v LIKE '%.5' THEN 100000 ELSE 1000000 END AS BIGINT) AS precision_us FROM p WHERE v IS NOT NULL""")
def cmp_17(spark, d):
    """Both time modes; files record the capture time again with more digits, or something unreadable."""
    from ..operators.browse import timelines
    from ..operators.scratch import written

    assets = load(spark, d, "asset").select("asset_id", "capture_time")
    f, again = F.col("file_id"), F.col("recorded")
    exif = F.when(f % 6 == 0, F.concat(again, F.lit(".250"))).when(f % 6 == 1, F.concat(again, F.lit(".5"))).when(f % 6 == 2, "unknown.123456")
    files = load(spark, d, "file").join(assets.withColumnRenamed("capture_time", "recorded"), "asset_id").withColumn("exif_time", exif).withColumn("file_created_time", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss"))
    # written once: a sort by ranges reads its input twice
    return written(timelines(assets, files, ["capture", "file_created"]), "points").orderBy("time_us", "asset_id")


@query("cmp_18_capabilities", f"""WITH g AS (SELECT count(DISTINCT asset_id) AS n FROM {GEO} WHERE lat BETWEEN -90 AND 90), a AS (SELECT count(*) AS n, count(capture_time) AS t FROM asset), v AS (SELECT count(*) AS n FROM vector JOIN asset ON vector.file_id = asset.asset_id)
 SELECT 'geo' AS view, a.n AS filtered_asset_count, g.n AS represented_point_count, TRUE AS available, CASE WHEN a.n = 0 THEN 'No assets match these filters.' WHEN g.n = 0 THEN 'No filtered assets have valid GPS coordinates.' END AS empty_reason FROM a, g
 UNION ALL SELECT 'timeline', n, t, TRUE, CASE WHEN n = 0 THEN 'No assets match these filters.' WHEN t = 0 THEN 'No filtered assets have a usable capture time.' END FROM a UNION ALL SELECT 'vector', a.n, v.n, TRUE, CASE WHEN v.n = 0 THEN 'No filtered assets have a projected semantic vector.' END FROM a, v
 UNION ALL SELECT 'timeline', 0, 0, TRUE, 'No assets match these filters.' UNION ALL SELECT 'vector', n, 0, FALSE, 'no projection' FROM a /* FROM file */""")
def cmp_18(spark, d):
    """The state of each view over all assets, over none, and without a projection."""
    a, geo_points = load(spark, d, "asset"), geo(spark, d).filter(M.valid_gps(F.col("lat"), F.col("lon"))).select("asset_id").distinct()
    times = a.filter("capture_time is not null")
    vectors = load(spark, d, "vector").join(a, F.col("file_id") == F.col("asset_id"), "left_semi")
    nothing = a.filter("asset_id is null")
    states = [L.view_state("geo", a, geo_points), L.view_state("timeline", a, times), L.view_state("vector", a, vectors), L.view_state("timeline", nothing, nothing), L.view_state("vector", a, None, reason="no projection")]
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out


@query("cmp_19_timeline", """WITH p AS (SELECT job_id AS id, epoch_us(stamp) AS us, CASE WHEN job_id % 7 <> 0 THEN seconds END AS quality, epoch_us(CAST(date_trunc('month', stamp) AS TIMESTAMP)) AS start_us, epoch_us(CAST(date_trunc('month', stamp) + INTERVAL 1 MONTH AS TIMESTAMP)) AS end_us FROM job),
 b AS (SELECT start_us, end_us, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT start_us, id AS representative FROM p QUALIFY row_number() OVER (PARTITION BY start_us ORDER BY quality DESC NULLS LAST, id) = 1) SELECT p.start_us, b.end_us, b.n, r.representative, p.id, p.us FROM p JOIN b USING (start_us) JOIN r USING (start_us)""")
def cmp_19_timeline(spark, d):
    """Every point with its bucket of a month, that bucket's count and representative."""
    buckets, members = L.timeline(points(spark, d), 2_592_000_000_000)
    return members.join(F.broadcast(buckets), "start_us").select("start_us", "end_us", "n", "representative", "id", "us")


def points(spark, d):
    return load(spark, d, "job").select(F.col("job_id").alias("id"), F.unix_micros(F.col("stamp").cast("timestamp")).alias("us"), F.when(F.col("job_id") % 7 != 0, F.col("seconds")).alias("quality"))


BUCKETS = "b AS (SELECT CAST(floor(epoch_us(stamp) / 21600000000.0) AS BIGINT) AS bucket, job_id AS id, CASE WHEN job_id % 7 <> 0 THEN seconds END AS quality FROM job)"


@query("cmp_19_str_3_time_buckets", f"WITH {BUCKETS} SELECT bucket, count(*) AS n, max(CASE WHEN k = 1 THEN id END) AS representative FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY quality DESC NULLS LAST, id) AS k FROM b) GROUP BY bucket /* FROM job */")
def cmp_19(spark, d):
    return L.time_buckets(points(spark, d), "us", 21_600_000_000)


@query("cmp_20_zero_filled", "WITH b AS (SELECT CAST(floor(epoch_us(stamp) / 600000000.0) AS BIGINT) AS bucket, count(*) AS n FROM job WHERE kind = 'error' GROUP BY 1), s AS (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM b) SELECT s.bucket, coalesce(b.n, 0) AS n FROM s LEFT JOIN b ON s.bucket = b.bucket")
def cmp_20(spark, d):
    j = load(spark, d, "job").filter("kind = 'error'").select(F.floor(F.unix_micros(F.col("stamp").cast("timestamp")) / 600_000_000).cast("long").alias("bucket"))
    return L.zero_filled(j.groupBy("bucket").agg(F.count("*").alias("n")))


@query("win_10_density", "WITH b AS (SELECT CAST(floor(epoch_us(stamp) / 3600000000.0) AS BIGINT) AS bucket, count(*) AS n FROM job GROUP BY 1) SELECT x.bucket, max(x.n) AS n, sum(y.n * CASE abs(x.bucket - y.bucket) WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 1 END) / 16 AS density FROM b x JOIN b y ON abs(x.bucket - y.bucket) <= 2 GROUP BY x.bucket")
def win_10(spark, d):
    j = load(spark, d, "job").select(F.floor(F.unix_micros(F.col("stamp").cast("timestamp")) / 3_600_000_000).cast("long").alias("bucket"))
    return L.density(j.groupBy("bucket").agg(F.count("*").alias("n")))


def world(spark, d):
    from ..functions.metrics import mercator_x, mercator_y

    return geo(spark, d).filter("lat between -90 and 90").withColumn("x", mercator_x(F.col("lon"))).withColumn("y", mercator_y(F.col("lat")))


WORLD = f"w AS (SELECT id, quality, (lon + 180) / 360 AS x, (1 - ln(tan(pi() / 4 + radians(least(greatest(lat, -85.0), 85.0)) / 2)) / pi()) / 2 AS y FROM {GEO} WHERE lat BETWEEN -90 AND 90)"
CELLS = "c AS (SELECT CAST(floor(x / (0.5 / 16)) AS BIGINT) AS cx, CAST(floor(y / (0.5 / 16)) AS BIGINT) AS cy, * FROM w)"


@query("cmp_21_geo_cells", f"WITH {WORLD}, {CELLS} SELECT cx, cy, count(*) AS n, round(avg(x), 9) AS mx, round(avg(y), 9) AS my FROM c GROUP BY cx, cy /* FROM file */")
def cmp_21(spark, d):
    return L.cells(world(spark, d), "x", "y", 0.5, 4).select("cx", "cy", "n", F.round("mx", 9).alias("mx"), F.round("my", 9).alias("my"))


@query("cmp_22_vector_cells", "WITH w AS (SELECT vec_id AS id, label * 1.0 AS quality, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c AS (SELECT CAST(floor(x / 0.125) AS BIGINT) AS cx, CAST(floor(y / 0.125) AS BIGINT) AS cy, id, quality FROM w) SELECT cx, cy, count(*) AS n, max(CASE WHEN k = 1 THEN id END) AS representative FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY quality DESC, id) AS k FROM c) GROUP BY cx, cy", views=False)
def cmp_22(spark, d):
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("quality"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return L.cells(v, "x", "y", 1.0, 3).select("cx", "cy", "n", "representative")


@query("cmp_23_viewport", f"WITH {WORLD}, {CELLS} SELECT cx, cy, count(*) AS n FROM c WHERE cx BETWEEN 11 AND 20 AND cy BETWEEN 8 AND 25 GROUP BY cx, cy /* FROM file */")
def cmp_23(spark, d):
    c = L.cells(world(spark, d), "x", "y", 0.5, 4)
    return L.visible(c, (0.4, 0.3, 0.6, 0.75), 0.5 / 16, 0.03125).select("cx", "cy", "n")


@query("cmp_24_rectangle_merge")
def cmp_24(spark, d):
    """Order-dependent, over all cells; compared with a sequential model in the tests."""
    c = L.cells(world(spark, d), "x", "y", 0.5, 4)
    boxes = c.select((F.col("cx") * 100_000 + F.col("cy")).alias("id"), (F.col("mx") * 1000).alias("x"), (F.col("my") * 1000).alias("y"), F.lit(60.0).alias("w"), F.lit(40.0).alias("h"), "n", "cx", "cy")
    boxes = written(boxes, "boxes")
    found = L.merge_rectangles(boxes, ["cx", "cy"]).join(boxes.select("id", "n"), "id")
    return found.groupBy(F.col("anchor").alias("marker")).agg(F.count("*").alias("members"), F.sum("n").alias("n"))


@query("cmp_25_density_raster", "WITH p AS (SELECT CAST(floor((CAST(embedding[1] AS DOUBLE) + 1) / 2 * 512) AS INT) AS px, CAST(floor((CAST(embedding[2] AS DOUBLE) + 1) / 2 * 512) AS INT) AS py FROM embeddings), o AS (SELECT unnest(range(-3, 4)) AS i), s AS (SELECT px + a.i AS px, py + b.i AS py, exp(-(a.i * a.i + b.i * b.i) / 5.0) AS v FROM p, o a, o b) SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(sum(v), 9) AS v FROM s WHERE px BETWEEN 0 AND 511 AND py BETWEEN 0 AND 511 GROUP BY ALL", views=False)
def cmp_25(spark, d):
    v = load(spark, d, "embeddings").select(((F.col("embedding")[0].cast("double") + 1) / 2).alias("x"), ((F.col("embedding")[1].cast("double") + 1) / 2).alias("y"))
    return L.splat(v, "x", "y").select("px", "py", F.round("v", 9).alias("v"))


def pictures(spark, d):
    """Vectors as pictures of 8 x 8: brightness by component, green and blue by other orders of the same ones."""
    shade = lambda e: F.least(F.greatest(F.floor(e.cast("double") * 400 + 128), F.lit(0)), F.lit(255)).cast("int")
    v = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", shade).alias("red"))
    turned = lambda k: F.transform("red", lambda x, i: F.element_at("red", ((i * k + 3) % 64 + 1).cast("int")))
    return v.select("vec_id", "label", "red", turned(7).alias("green"), turned(13).alias("blue"), F.lit(8).alias("width"))


_PICTURES = """p0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 400 + 128), 0), 255) AS INT)) AS red FROM embeddings),
 p AS (SELECT *, list_transform(range(0, 64), lambda i: red[(i * 7 + 3) % 64 + 1]) AS green, list_transform(range(0, 64), lambda i: red[(i * 13 + 3) % 64 + 1]) AS blue FROM p0)"""
_GAP = "list_transform(range(1, 65), lambda i: CAST(power({0}.red[i] - {1}.red[i], 2) + power({0}.green[i] - {1}.green[i], 2) + power({0}.blue[i] - {1}.blue[i], 2) AS BIGINT))".format


@query("cmp_30_pixel_difference", f"""WITH {_PICTURES}, h AS (SELECT label, min(vec_id) AS head FROM p GROUP BY label), g AS (SELECT p.vec_id, q.vec_id AS head, {_GAP('p', 'q')} AS s FROM p JOIN h ON p.label = h.label JOIN p q ON q.vec_id = h.head)
 SELECT vec_id, head, CAST(list_sum(s) AS DOUBLE) / 192 AS mse, list_max(s) / 3.0::DOUBLE AS maximum, CAST(CASE WHEN list_max(s) > 0 THEN list_sum(list_transform(s, lambda x: round_even(ln(1 + x / 3.0::DOUBLE) / ln(1 + list_max(s) / 3.0::DOUBLE) * 255, 0))) ELSE 0 END AS BIGINT) AS shade FROM g""", views=False)
def cmp_30(spark, d):
    """Every picture against the first of its label: mean square, largest, and how much of the difference map is lit."""
    p = pictures(spark, d)
    heads = p.groupBy("label").agg(F.min_by(F.struct("vec_id", "red", "green", "blue"), "vec_id").alias("h"))
    j = X.held(p.join(heads, "label"), {"__map": X.difference_map([F.col(c) for c in ("red", "green", "blue")], [F.col(f"h.{c}") for c in ("red", "green", "blue")])[0]})
    sides = [F.col(c) for c in ("red", "green", "blue")], [F.col(f"h.{c}") for c in ("red", "green", "blue")]
    lit = F.aggregate("__map", F.lit(0).cast("long"), lambda a, x: a + x)
    return j.select("vec_id", F.col("h.vec_id").alias("head"), X.mean_squared_error(*sides).alias("mse"), X.difference_map(*sides)[1].alias("maximum"), lit.alias("shade"))


@query("cmp_30_orientations", f"WITH {_PICTURES} SELECT vec_id, CAST(o AS INT) AS orientation, list_transform(range(0, 64), lambda i: red[CASE o WHEN 1 THEN i WHEN 2 THEN i - i % 8 + 7 - i % 8 WHEN 3 THEN 63 - i WHEN 4 THEN (7 - i // 8) * 8 + i % 8 WHEN 5 THEN (i % 8) * 8 + i // 8 WHEN 6 THEN (7 - i % 8) * 8 + i // 8 WHEN 7 THEN (7 - i % 8) * 8 + 7 - i // 8 ELSE (i % 8) * 8 + 7 - i // 8 END + 1])::VARCHAR AS pixels FROM p, (SELECT vec_id % 8 + 1 AS o, vec_id AS v FROM p0) q WHERE q.v = p.vec_id", views=False)
def cmp_30_orientations(spark, d):
    """Pictures turned upright; their ids say how they were held."""
    p = pictures(spark, d).withColumn("orientation", (F.col("vec_id") % 8 + 1).cast("int"))
    return p.select("vec_id", "orientation", F.col("red").alias("red"), "width").select("vec_id", "orientation", X.oriented(F.col("red"), F.col("width"), F.col("orientation")).cast("string").alias("pixels"))


@query("cmp_31_visual_features")
def cmp_31(spark, d):
    """Gradient hash, standardised brightness and colour shares of every picture; held against numpy in the tests."""
    return X.visual_features(pictures(spark, d), "red", "green", "blue", "width").select("vec_id", "dhash", "luma", "color_hist")


@query("udf_1_2_providers")
def udf_1(spark, d):
    """Embedding and quality providers as vectorised functions; the built-in ones are deterministic stand-ins."""
    from ..functions.providers import embedder, quality_of

    f = load(spark, d, "file")
    return f.select("file_id", embedder("hash-8")("relative_path").alias("vec"), quality_of("stat")("size_bytes").alias("quality"))
