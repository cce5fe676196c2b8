"""Temporal and visual groups, reconciliation, recommendations (JN-10/11, AGG-22/24, WIN-4..8, SRT-8, CMP-7..11, RSH)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as X
from ..operators import groups as G
from ..operators import selection as Sel
from ..operators.reconcile import min_label_components, reconcile
from .browse_queries import CATALOG, catalog_of
from .catalog import load
from .registry import query

SEC = "epoch_us(stamp) / 1e6"


def timed(spark, d):
    return load(spark, d, "job").withColumn("t", F.unix_micros(F.col("stamp").cast("timestamp")) / 1e6)


@query("jn_10_agg_24_band_pairs", f"WITH e AS (SELECT job_id, file_id, kind, {SEC} AS t, seconds FROM job) SELECT a.kind, count(*) AS pairs, count_if(abs(a.seconds - b.seconds) <= 5) AS accepted FROM e a JOIN e b ON a.kind = b.kind AND (b.t > a.t OR (b.t = a.t AND b.job_id > a.job_id)) AND b.t - a.t <= 600 GROUP BY a.kind")
def jn_10(spark, d):
    return G.band_pair_counts(timed(spark, d), "t", "job_id", ["kind"], 600.0, "seconds", 5.0)


@query("jn_11_adjacent_pairs", f"SELECT job_id, next_id FROM (SELECT job_id, {SEC} AS t, lead(job_id) OVER w AS next_id, lead({SEC}) OVER w AS u FROM job WINDOW w AS (PARTITION BY file_id ORDER BY stamp, job_id)) WHERE u - t <= 300")
def jn_11(spark, d):
    w = Window.partitionBy("file_id").orderBy("stamp", "job_id")
    e = timed(spark, d).select("job_id", "t", F.lead("job_id").over(w).alias("next_id"), F.lead("t").over(w).alias("u"))
    return e.filter(F.col("u") - F.col("t") <= 300).select("job_id", "next_id")


@query("win_8_str_2_sessions", f"WITH e AS (SELECT file_id, job_id, {SEC} AS t FROM job), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY file_id ORDER BY t, job_id) <= 7200 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY t, job_id ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT file_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(job_id) AS first_id FROM s GROUP BY ALL")
def win_8(spark, d):
    return G.islands(timed(spark, d), "t", ["file_id"], 7200, ["job_id"]).groupBy("file_id", "island").agg(F.count("*").alias("n"), F.min("job_id").alias("first_id"))


@query("agg_22_member_statistics", "SELECT a.asset_id, min(abs(a.asset_id - b.asset_id)) AS nearest, max(abs(date_diff('day', CAST(a.created_day AS DATE), CAST(b.created_day AS DATE)))) AS most_days FROM asset a JOIN asset b ON a.group_id = b.group_id AND a.asset_id <> b.asset_id GROUP BY a.asset_id")
def agg_22(spark, d):
    """Nearest neighbour and largest time difference of each member: the extremes of its group and the rows beside it, no pairs."""
    m = load(spark, d, "asset").filter("group_id is not null").select("group_id", "asset_id", F.col("created_day").cast("date").alias("day"))
    g = m.groupBy("group_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("n")).filter("n > 1")
    w = Window.partitionBy("group_id").orderBy("asset_id")
    beside = F.least(F.col("asset_id") - F.lag("asset_id").over(w), F.lead("asset_id").over(w) - F.col("asset_id"))
    return m.withColumn("nearest", beside).join(g, "group_id").select("asset_id", "nearest", F.greatest(F.datediff("day", "lo"), F.datediff("hi", "day")).cast("long").alias("most_days"))


_TIME = "CASE WHEN capture_time IS NULL OR capture_time_kind = 'exif_offset' THEN NULL ELSE capture_time END"


@query("win_4_representatives", f"WITH {CATALOG}, k AS (SELECT cat.*, {_TIME} AS usable FROM cat JOIN (SELECT asset_id, capture_time_kind FROM asset) USING (asset_id)) SELECT group_id, asset_id FROM k WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY quality DESC NULLS LAST, usable NULLS LAST, asset_id) = 1")
def win_4(spark, d):
    """Ties by what a time means: instants, local times, none; here no instant has the offset that it needs."""
    kinds = load(spark, d, "asset").select("asset_id", "capture_time_kind")
    return G.representatives(catalog_of(spark, d).join(kinds, "asset_id")).select("group_id", "asset_id")


REC = "(SELECT group_id, asset_id, quality, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC NULLS LAST, capture_time NULLS LAST, asset_id) AS k FROM cat WHERE group_id IS NOT NULL)"


@query("win_5_cmp_10_recommendations", f"WITH {CATALOG} SELECT group_id, asset_id, k = 1 AND coalesce(quality, 0) >= 0.7 AS recommended, CASE WHEN k > 1 THEN 'not_representative' WHEN coalesce(quality, 0) >= 0.7 THEN 'representative' ELSE 'below_recommendation_quality' END AS reason FROM {REC}")
def win_5(spark, d):
    return Sel.recommend(catalog_of(spark, d), 0.7)


@query("cmp_11_set_1_read_recommendations", f"WITH {CATALOG} SELECT asset_id FROM {REC} WHERE k = 1 AND quality >= 0.9 UNION SELECT asset_id FROM cat WHERE media_type = 'video' AND quality >= 0.9")
def cmp_11(spark, d):
    c = catalog_of(spark, d)
    return G.representatives(c).filter("quality >= 0.9").select("asset_id").union(c.filter("media_type = 'video' and quality >= 0.9").select("asset_id")).distinct()


@query("win_6_survivors", "SELECT sha256, asset_id AS survivor FROM (SELECT f.sha256, a.asset_id, row_number() OVER (PARTITION BY f.sha256 ORDER BY CASE WHEN a.selection_state = 'undecided' THEN 1 ELSE 0 END, a.created_day, a.asset_id) AS k FROM file f JOIN asset a ON f.asset_id = a.asset_id) WHERE k = 1")
def win_6(spark, d):
    j = load(spark, d, "file").join(load(spark, d, "asset").select("asset_id", "selection_state", "created_day"), "asset_id")
    key = F.struct(F.when(F.col("selection_state") == "undecided", 1).otherwise(0), "created_day", "asset_id")
    return j.groupBy("sha256").agg(F.min_by("asset_id", key).alias("survivor"))


@query("win_7_percentile_rank", "SELECT file_id, job_id, (rank() OVER (PARTITION BY file_id ORDER BY seconds) + (count(*) OVER (PARTITION BY file_id, seconds) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY file_id) AS p FROM job")
def win_7(spark, d):
    j = load(spark, d, "job")
    return j.select("file_id", "job_id", G.percentile_rank(j, ["file_id"], "seconds").alias("p"))


@query("srt_8_borderline_pairs", f"WITH e AS (SELECT job_id, kind, {SEC} AS t, seconds FROM job), p AS (SELECT a.kind, a.job_id AS a, b.job_id AS b, b.t - a.t AS dt, abs(a.seconds - b.seconds) AS diff FROM e a JOIN e b ON a.kind = b.kind AND (b.t > a.t OR (b.t = a.t AND b.job_id > a.job_id)) AND b.t - a.t <= 600) SELECT a, b, diff FROM p WHERE diff > 5 ORDER BY diff, dt, a, b LIMIT 50")
def srt_8(spark, d):
    return G.nearest_band_pairs(timed(spark, d), "t", "job_id", ["kind"], 600.0, "seconds", 5.0, 50)


@query("cmp_7_strict_groups")
def cmp_7(spark, d):
    """Order-dependent; compared with a sequential model in the tests."""
    r = timed(spark, d).select(F.col("job_id").alias("asset_id"), F.lit("absolute").alias("semantics"), "t", F.when(F.col("job_id") % 17 != 0, F.col("seconds")).alias("f"))
    near = lambda a, b: 1 - abs(a["f"] - b["f"]) / 100 if abs(a["f"] - b["f"]) <= 8 else None
    return G.strict_groups(r, lambda a, b: abs(a["f"] - b["f"]) < 50, near, ["f"])


EDGES = "(SELECT DISTINCT least(a.asset_id, b.asset_id) AS a, greatest(a.asset_id, b.asset_id) AS b FROM file a JOIN file b ON a.sha256 = b.sha256 AND a.size_bytes = b.size_bytes AND a.asset_id <> b.asset_id)"


@query("cmp_9_components", f"""WITH RECURSIVE e AS {EDGES}, both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.seen = w.a)
 SELECT node, min(seen) AS component FROM r GROUP BY node /* FROM file */""")
def cmp_9(spark, d):
    f = load(spark, d, "file").select("asset_id", "sha256", "size_bytes")
    # each asset with the smallest of its content: as connected as all pairs, and as many edges as assets
    low = f.groupBy("sha256", "size_bytes").agg(F.min("asset_id").alias("a"))
    e = f.join(low, ["sha256", "size_bytes"]).select("a", F.col("asset_id").alias("b")).filter("a < b").distinct()
    return min_label_components(e)


@query("cmp_8_reconcile")
def cmp_8(spark, d):
    """Families by content, unless decisions oppose; iterative, checked in the tests."""
    return reconcile(load(spark, d, "asset"), load(spark, d, "file"))


def staged(spark, d):
    """Reconciliation in stages: three neighbouring assets share a stem, content is told apart by size as well, pictures are shared by six assets."""
    from ..functions import pixels as X
    from ..operators.reconcile import reconcile_stages
    from ..operators.scratch import written
    from .search_queries import pictures

    a = F.col("asset_id")
    maker = F.when(F.col("width") % 3 == 0, F.concat(F.lit(" Maker"), F.floor(F.col("height") / 700).cast("string")))
    shown = written(X.identity_features(pictures(spark, d), "red", "green", "blue", "width").select(F.col("vec_id").alias("picture"), "small_red", "small_green", "small_blue", "bits"), "pictures")
    files = load(spark, d, "file").select(
        "file_id", "asset_id", F.concat(F.lit("P_"), F.floor(a / 3).cast("string"), "extension").alias("filename"), "extension", "media_type", "role",
        F.concat("sha256", F.lit("-"), (F.col("size_bytes") % 97).cast("string")).alias("sha256"), "width", "height", maker.alias("make"), F.lit(None).cast("string").alias("model"), F.floor(a / 6).alias("picture"))
    assets = load(spark, d, "asset").select("asset_id", "selection_state", F.col("created_day").cast("string").alias("created_at"), "capture_time", "capture_time_kind")
    return reconcile_stages(assets, written(files, "files"), pictures=shown)


@query("cmp_8_stages")
def cmp_8_stages(spark, d):
    """What becomes of every asset, relations and conflicts, in one table; the stages are held against a sequential model in the tests."""
    found = staged(spark, d)
    survivors = found["assets"].select(F.lit("survivor").alias("kind"), F.col("asset_id").alias("left_asset"), F.col("survivor").alias("right_asset"), F.lit(None).cast("string").alias("stem"), F.col("capture_time").alias("rule"))
    return survivors.unionByName(found["relations"]).unionByName(found["conflicts"].withColumn("rule", F.lit(None).cast("string")))


@query("cmp_8_raw_jpeg_pairs", """WITH a AS (SELECT asset_id, selection_state, asset_id % 4 = 1 AS abs, CASE WHEN asset_id % 3 <> 0 THEN asset_id % 13 END AS s, CASE WHEN asset_id % 5 <> 0 THEN asset_id % 5 // 3 END AS cam FROM asset),
 g AS (SELECT asset_id // 2 AS k, min(CASE WHEN is_raw THEN asset_id END) AS r0, max(CASE WHEN is_raw THEN asset_id END) AS r1, min(CASE WHEN NOT is_raw THEN asset_id END) AS j0, max(CASE WHEN NOT is_raw THEN asset_id END) AS j1
   FROM file WHERE media_type = 'image' AND role NOT LIKE 'managed%' AND role NOT LIKE 'derived%' AND extension <> '.jxl' GROUP BY 1),
 e AS (SELECT g.*, a.s IS NOT NULL AND b.s IS NOT NULL AS timed, a.cam IS NOT NULL AND b.cam IS NOT NULL AS cams, a.abs <> b.abs AS other, a.cam <> b.cam AS differ, abs(a.s - b.s) > 5 AS far, (a.selection_state = 'selected' AND b.selection_state = 'rejected') OR (a.selection_state = 'rejected' AND b.selection_state = 'selected') AS opposed
   FROM g JOIN a ON a.asset_id = g.r0 JOIN a b ON b.asset_id = g.j0 WHERE r0 IS NOT NULL AND j0 IS NOT NULL),
 o AS (SELECT *, CASE WHEN r0 <> r1 OR j0 <> j1 THEN 'ambiguous' WHEN r0 = j0 THEN 'already_reconciled' WHEN (timed AND far) OR (timed AND other AND NOT cams) OR (cams AND differ) THEN NULL WHEN opposed THEN 'decision_conflict' ELSE 'paired' END AS outcome FROM e)
 SELECT 'p_' || CAST(k AS STRING) AS stem, CASE WHEN r0 = r1 THEN r0 END AS raw_asset, CASE WHEN j0 = j1 THEN j0 END AS rendered_asset, outcome,
  CASE WHEN outcome IN ('paired', 'decision_conflict') THEN CASE WHEN timed AND other THEN 'same_stem+capture_time_mixed_semantics+camera' WHEN timed AND cams THEN 'same_stem+capture_time+camera' WHEN timed THEN 'same_stem+capture_time' WHEN cams THEN 'same_stem+camera' ELSE 'unique_same_stem_no_conflict' END END AS rule FROM o WHERE outcome IS NOT NULL""")
def cmp_8_pairs(spark, d):
    """Two neighbouring assets share a stem; times, offsets and cameras agree or not."""
    from ..operators.reconcile import stem_pairs

    a = F.col("asset_id")
    absolute = a % 4 == 1
    time = F.when(a % 3 != 0, F.concat(F.lit("2024-05-06T07:08:"), F.lpad((a % 13).cast("string"), 2, "0"), F.when(absolute, "+00:00").otherwise("")))
    assets = load(spark, d, "asset").select("asset_id", "selection_state", time.alias("capture_time"), F.when(absolute, "exif_offset").otherwise("exif_local_unknown").alias("capture_time_kind"), F.when(a % 5 != 0, F.concat(F.lit(" Maker"), F.floor(a % 5 / 3).cast("string"), F.lit(" "))).alias("camera"))
    files = load(spark, d, "file").withColumn("filename", F.concat(F.lit("P_"), F.floor(a / 2).cast("string"), "extension"))
    return stem_pairs(assets, files)


@query("cmp_8_blocked_families", "SELECT f.media_type, f.sha256, count(DISTINCT f.asset_id) AS assets FROM file f JOIN asset a ON f.asset_id = a.asset_id GROUP BY f.media_type, f.sha256 HAVING count(DISTINCT f.asset_id) > 1 AND bool_or(a.selection_state = 'selected') AND bool_or(a.selection_state = 'rejected')")
def cmp_8_blocked(spark, d):
    j = load(spark, d, "file").join(load(spark, d, "asset").select("asset_id", "selection_state"), "asset_id")
    s = F.col("selection_state")
    g = j.groupBy("media_type", "sha256").agg(F.count_distinct("asset_id").alias("assets"), F.bool_or(s == "selected").alias("x"), F.bool_or(s == "rejected").alias("y"))
    return g.filter("assets > 1 and x and y").drop("x", "y")


RANK = "((rank() OVER (PARTITION BY asset_id ORDER BY {0}) + (count(*) OVER (PARTITION BY asset_id, {0}) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY asset_id))".format


@query("rsh_1_quality_blend", f"""WITH f AS (SELECT file_id, asset_id, size_bytes AS focus, size_bytes % 1000 AS focus_center, width AS detail, height AS contrast, (file_id % 10) / 10.0 AS black, (file_id % 4) / 4.0 AS white FROM file)
 SELECT file_id, greatest(least(0.65 * (0.7 * {RANK("focus")} + 0.3 * {RANK("focus_center")}) + 0.20 * {RANK("detail")} + 0.15 * {RANK("contrast")} - 0.25 * (0.35 * black + white), 1.0), 0.0) AS technical FROM f""")
def rsh_1(spark, d):
    """Technical quality of every file among the files of its asset."""
    f = F.col("file_id")
    frames = load(spark, d, "file").select("file_id", "asset_id", F.col("size_bytes").alias("focus"), (F.col("size_bytes") % 1000).alias("focus_center"), F.col("width").alias("detail"), F.col("height").alias("contrast"), (f % 10 / 10.0).alias("black"), (f % 4 / 4.0).alias("white"))
    return frames.select("file_id", Sel.technical_quality(frames, ["asset_id"]).alias("technical"))


def sessions(spark, d):
    """Vectors as frames: a label is cut into sessions where vec_id leaves a gap of a hundred."""
    v = F.col("vec_id")
    session, cluster = F.concat_ws("/", F.col("label").cast("string"), F.floor(v / 100).cast("string")), (v % 7).cast("long")
    return load(spark, d, "embeddings").select(v.alias("id"), session.alias("session"), cluster.alias("cluster"), F.col("embedding").alias("vec"), (v * 3.0).alias("t"), (v % 100 / 100.0).alias("quality"), (v % 3 == 0).alias("chosen"), (v % 2 == 0).alias("wanted"))


@query("rsh_2_linkage")
def rsh_2(spark, d):
    return Sel.complete_linkage(sessions(spark, d), 0.75, 0.05)


@query("rsh_3_diversified_selection")
def rsh_3(spark, d):
    return Sel.diversified(sessions(spark, d), 5, 0.55)


@query("rsh_4_coverage_selection")
def rsh_4(spark, d):
    both = [Sel.coverage(sessions(spark, d), 5, 0.5, x).withColumn("strategy", F.lit(x)) for x in ("coverage", "mmr")]
    return both[0].unionByName(both[1])


@query("rsh_5_selectors", """WITH r AS (SELECT asset_id, file_id, row_number() OVER (PARTITION BY asset_id ORDER BY size_bytes DESC, file_id) AS q, row_number() OVER (PARTITION BY asset_id ORDER BY mtime, file_id) - 1 AS p, count(*) OVER (PARTITION BY asset_id) AS n FROM file),
 u AS (SELECT asset_id, unnest(range(0, CAST(least(3, n) AS BIGINT))) AS i, n FROM (SELECT DISTINCT asset_id, n FROM r))
 SELECT 'quality' AS method, file_id, CAST(q AS INT) AS pick FROM r WHERE q <= 3 UNION ALL SELECT 'uniform', r.file_id, CAST(u.i + 1 AS INT) FROM u JOIN r ON r.asset_id = u.asset_id AND r.p = floor(CASE WHEN least(3, u.n) > 1 THEN u.i * (u.n - 1) / (least(3, u.n) - 1.0) ELSE 0 END + 1e-9)""")
def rsh_5(spark, d):
    """Three files of each asset by size, and evenly by time."""
    items = load(spark, d, "file").select(F.col("file_id").alias("id"), F.col("asset_id").alias("session"), F.col("mtime").alias("t"), F.col("size_bytes").alias("quality"))
    out = [Sel.picks(items, 3, m).select(F.lit(m).alias("method"), F.col("id").alias("file_id"), "pick") for m in ("quality", "uniform")]
    return out[0].unionByName(out[1])


@query("rsh_6_selection_metrics")
def rsh_6_metrics(spark, d):
    """Matching and averages; compared with an exhaustive matching in the tests."""
    return Sel.average_metrics(Sel.selection_metrics(sessions(spark, d)))


@query("rsh_6_overlap_metrics", "WITH c AS (SELECT file_id AS s, job_id FROM job WHERE job_id % 3 = 0), h AS (SELECT file_id AS s, job_id FROM job WHERE job_id % 2 = 0), m AS (SELECT c.s, count(*) AS chosen, count(h.job_id) AS both_sets FROM c LEFT JOIN h ON c.s = h.s AND c.job_id = h.job_id GROUP BY c.s) SELECT avg(both_sets / chosen) AS macro, sum(both_sets) / sum(chosen) AS micro FROM m")
def rsh_6(spark, d):
    j = load(spark, d, "job").select(F.col("file_id").alias("s"), "job_id")
    h = j.filter("job_id % 2 = 0").select("job_id", F.lit(1).alias("hit"))
    m = j.filter("job_id % 3 = 0").join(h, "job_id", "left").groupBy("s").agg(F.count("*").alias("chosen"), F.count("hit").alias("both"))
    return m.agg(F.avg(F.col("both") / F.col("chosen")).alias("macro"), (F.sum("both") / F.sum("chosen")).alias("micro"))


@query("s_4_7_grouping_metrics_of_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id - a.vec_id BETWEEN 1 AND 20", views=False)
def pair_metrics(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", "embedding").withColumn("t", F.col("vec_id").cast("double"))
    p = G.band_pairs(e, "t", "vec_id", ["label"], 20.0)
    v = e.select(F.col("vec_id").alias("k1"), F.col("embedding").alias("v1"))
    p = p.join(v, "k1").join(v.select(F.col("k1").alias("k2"), F.col("v1").alias("v2")), "k2")
    return p.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.round(X.dot(F.col("v1"), F.col("v2")), 6).alias("similarity"))
