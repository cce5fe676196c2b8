"""Summaries, roll-ups and estimates (AGG-4..30)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import metrics as X
from ..operators import estimates as E
from . import browse_queries as B
from .catalog import load, settled
from .registry import query


@query("agg_4_workspace_summary", "SELECT count(DISTINCT asset_id) AS assets, count(*) AS files, count_if(is_online) AS online, count_if(NOT in_scope) AS out_of_scope, CAST(max(mtime) AS TIMESTAMP) AS newest, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file")
def agg_4(spark, d):
    return load(spark, d, "file").agg(F.count_distinct("asset_id").alias("assets"), F.count("*").alias("files"), F.count_if("is_online").alias("online"), F.count_if(~F.col("in_scope")).alias("out_of_scope"), F.max("mtime").alias("newest"), F.sum("size_bytes").alias("bytes"))


@query("agg_5_folder_counts", "SELECT folder, count(*) AS files, count_if(media_type <> 'video') AS images, count_if(media_type = 'video') AS videos, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS bytes FROM file GROUP BY folder UNION ALL SELECT '', 0, 0, 0, 0 WHERE NOT EXISTS (SELECT 1 FROM file WHERE folder = '')")
def agg_5(spark, d):
    """Direct counts; the root always has a row."""
    f = load(spark, d, "file").select(M.parent_folder(F.col("relative_path")).alias("folder"), "media_type", "size_bytes", F.lit(1).alias("one"))
    root = spark.range(1).select(F.lit("").alias("folder"), F.lit(None).cast("string").alias("media_type"), F.lit(0).cast("long").alias("size_bytes"), F.lit(0).alias("one"))
    video = F.col("media_type") == "video"
    return f.unionByName(root).groupBy("folder").agg(F.sum("one").cast("long").alias("files"), F.count_if(~video).alias("images"), F.count_if(video).alias("videos"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("long").alias("bytes"))


ANCESTORS = "(SELECT f.file_id, f.size_bytes, f.extension, array_to_string(list_slice(string_split(f.folder, '/'), 1, i), '/') AS prefix FROM file f, LATERAL (SELECT unnest(range(0, CASE WHEN f.folder = '' THEN 1 ELSE len(string_split(f.folder, '/')) + 1 END)) AS i))"


@query("agg_6_folder_rollup_set", f"SELECT DISTINCT prefix AS folder FROM {ANCESTORS}")
def agg_6(spark, d):
    folders = load(spark, d, "file").select(M.parent_folder(F.col("relative_path")).alias("f")).distinct()
    return folders.select(F.explode(M.folder_prefixes(F.col("f"))).alias("folder")).distinct()


@query("agg_7_recursive_rollup", f"SELECT prefix AS folder, extension, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {ANCESTORS} GROUP BY 1, 2")
def agg_7(spark, d):
    """Counts by folder and extension first, then up the tree: the explode works on folders, not files."""
    direct = load(spark, d, "file").groupBy(M.parent_folder(F.col("relative_path")).alias("f"), "extension").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return direct.select(F.explode(M.folder_prefixes(F.col("f"))).alias("folder"), "extension", "n", "b").groupBy("folder", "extension").agg(F.sum("n").cast("long").alias("files"), F.sum("b").cast("long").alias("bytes"))


@query("agg_8_recommendation_counts", f"WITH {B.CATALOG}, {B.RECOMMENDED} SELECT (SELECT count(*) FROM rec) AS assets, (SELECT count_if(recommended) FROM rec) AS recommended, count_if(selection_state = 'selected') AS selected, count_if(selection_state = 'rejected') AS rejected, count_if(selection_state = 'undecided') AS undecided FROM asset")
def agg_8(spark, d):
    """Assets with a recommendation run's decision, those recommended, and all assets by what the user decided."""
    from ..operators.selection import recommendation_counts

    return recommendation_counts(B.decisions_of(spark, d), load(spark, d, "asset"))


@query("agg_9_distinct_paths", "SELECT asset_id, string_agg(DISTINCT relative_path, ',' ORDER BY relative_path) AS paths FROM file GROUP BY asset_id")
def agg_9(spark, d):
    return load(spark, d, "file").groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("relative_path")), ",").alias("paths"))


@query("agg_10_sample_counts", "SELECT file_id, kind, count(*) AS n FROM job WHERE status = 'complete' GROUP BY file_id, kind")
def agg_10(spark, d):
    return load(spark, d, "job").filter("status = 'complete'").groupBy("file_id", "kind").agg(F.count("*").alias("n"))


@query("agg_11_status_counts", "SELECT kind, count_if(status = 'complete') AS complete, count_if(status = 'failed') AS failed, count_if(status = 'running') AS running, count_if(status = 'pending') AS pending, CASE WHEN sum(CASE WHEN status = 'complete' THEN seconds END) > 0 THEN count_if(status = 'pending') * (sum(CASE WHEN status = 'complete' THEN seconds END) / count_if(status = 'complete')) END AS eta FROM job GROUP BY kind")
def agg_11(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    done = F.sum(F.when(F.col("status") == "complete", F.col("seconds")))
    return load(spark, d, "job").groupBy("kind").agg(*[n(s).alias(s) for s in ("complete", "failed", "running", "pending")], F.when(done > 0, n("pending") * (done / n("complete"))).alias("eta"))


@query("agg_12_plan_summary", """SELECT role AS operation, count(*) AS candidates, CAST(sum(size_bytes) AS BIGINT) AS candidate_bytes, count_if(is_online) AS potential, CAST(coalesce(sum(CASE WHEN is_online THEN size_bytes END), 0) AS BIGINT) AS potential_bytes,
 count_if(is_online AND in_scope) AS ready, CAST(coalesce(sum(CASE WHEN is_online AND in_scope AND role = 'managed_jxl' THEN size_bytes - CAST(floor(size_bytes * 0.5) AS BIGINT) END), 0) AS BIGINT) AS bytes_saved FROM file GROUP BY role""")
def agg_12(spark, d):
    on, ready = F.col("is_online"), F.col("is_online") & F.col("in_scope")
    saved = F.when(ready & (F.col("role") == "managed_jxl"), F.col("size_bytes") - F.floor(F.col("size_bytes") * F.lit(0.5)).cast("long"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return load(spark, d, "file").groupBy(F.col("role").alias("operation")).agg(F.count("*").alias("candidates"), total("size_bytes").alias("candidate_bytes"), F.count_if(on).alias("potential"), total(F.when(on, F.col("size_bytes"))).alias("potential_bytes"), F.count_if(ready).alias("ready"), total(saved).alias("bytes_saved"))


@query("agg_12_survivors", "SELECT count(*) AS without_survivor FROM (SELECT asset_id FROM file GROUP BY asset_id HAVING bool_or(is_online) AND NOT bool_or(is_online AND role <> 'original'))")
def agg_12_survivors(spark, d):
    """Assets that lose their last online file when all originals go."""
    g = load(spark, d, "file").groupBy("asset_id").agg(F.bool_or("is_online").alias("any"), F.bool_or(F.col("is_online") & (F.col("role") != "original")).alias("left"))
    return g.filter("any and not left").agg(F.count("*").alias("without_survivor"))


@query("agg_13_blockers", "WITH b AS (SELECT role AS profile, component_status AS reason, filename, min(file_id) AS stamp FROM file WHERE NOT is_online GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile, reason ORDER BY stamp) AS k FROM b), n AS (SELECT role AS profile, component_status AS reason, count(*) AS n FROM file WHERE NOT is_online GROUP BY ALL) SELECT n.profile, n.reason, n.n, string_agg(r.filename, ',' ORDER BY r.k) AS examples FROM n JOIN r ON n.profile = r.profile AND n.reason = r.reason WHERE r.k <= 5 GROUP BY ALL")
def agg_13(spark, d):
    """Count and the first five distinct names; names are pre-aggregated, so no list grows with the rows."""
    from pyspark.sql import Window

    f = load(spark, d, "file").filter("not is_online").select(F.col("role").alias("profile"), F.col("component_status").alias("reason"), "filename", "file_id")
    names = f.groupBy("profile", "reason", "filename").agg(F.min("file_id").alias("stamp"), F.count("*").alias("n"))
    ranked = names.withColumn("k", F.row_number().over(Window.partitionBy("profile", "reason").orderBy("stamp")))
    g = ranked.groupBy("profile", "reason").agg(F.sum("n").cast("long").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "filename")))).alias("x"))
    return g.select("profile", "reason", "n", F.array_join(F.transform("x", lambda y: y["filename"]), ",").alias("examples"))


@query("agg_15_top_quartile", """WITH r AS (SELECT file_id, seconds, row_number() OVER (PARTITION BY file_id ORDER BY seconds DESC) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM job),
 s AS (SELECT file_id, n, n + file_id % 4 AS requested, avg(CASE WHEN k <= ceil(n * 0.25) THEN seconds END) AS top FROM r GROUP BY file_id, n)
 SELECT file_id, CASE WHEN n >= ceil(requested * 0.75) THEN round(top, 9) END AS score, n >= ceil(requested * 0.75) AND n < requested AS partial FROM s""")
def agg_15(spark, d):
    """Too few successful samples give no score; some files asked for up to three more than they got."""
    g = load(spark, d, "job").groupBy("file_id").agg(F.collect_list("seconds").alias("s"))
    score, partial = X.video_score(F.col("s"), F.size("s") + F.col("file_id") % 4)
    return g.select("file_id", F.round(score, 9).alias("score"), partial.alias("partial"))


#: Seconds for each item where no timing is known.
FALLBACK_RATES = {"view": 0.25, "click": 60.0, "error": 0.3, "purchase": 0.28, "other": 1.1}


@query("agg_17_historical_rate", """WITH last AS (SELECT kind, CASE WHEN job_id % 5 <> 0 THEN seconds ELSE 0 END AS seconds, CASE WHEN job_id % 5 <> 0 THEN 1 ELSE 0 END AS n FROM job WHERE status = 'complete' ORDER BY stamp DESC, job_id DESC LIMIT 8), s AS (SELECT kind, sum(seconds) AS seconds, sum(n) AS n FROM last GROUP BY kind),
 f(kind, fallback) AS (VALUES ('view', 0.25), ('click', 60.0), ('error', 0.3), ('purchase', 0.28), ('other', 1.1)) SELECT f.kind, CASE WHEN s.n > 0 AND s.seconds > 0 THEN greatest(s.seconds / s.n, CAST(f.fallback AS DOUBLE) * 0.45) ELSE CAST(f.fallback AS DOUBLE) END AS rate FROM f LEFT JOIN s USING (kind)""")
def agg_17(spark, d):
    """Over the last eight timed jobs of all kinds; never under 0.45 of the fallback, which stands in where nothing was timed."""
    timed = F.col("job_id") % 5 != 0
    last = load(spark, d, "job").filter("status = 'complete'").orderBy(F.desc("stamp"), F.desc("job_id")).limit(8)
    sums = last.groupBy("kind").agg(F.sum(F.when(timed, F.col("seconds")).otherwise(0.0)).alias("s"), F.count_if(timed).alias("n"))
    known = spark.createDataFrame(list(FALLBACK_RATES.items()), "kind string, fallback double").join(sums, "kind", "left")
    return known.select("kind", F.when((F.col("n") > 0) & (F.col("s") > 0), F.greatest(F.col("s") / F.col("n"), F.col("fallback") * 0.45)).otherwise(F.col("fallback")).alias("rate"))


@query("agg_18_indexed_work", """WITH a AS (SELECT asset_id, CASE WHEN bool_or(extension = '.mp4') THEN 'video' WHEN bool_or(extension NOT IN ('.cr3', '.dng')) THEN 'rendered' ELSE 'raw' END AS kind, count_if(component_status <> 'complete') AS pending,
 CAST(coalesce(sum(CASE WHEN extension = '.mp4' THEN least(greatest(ceil(duration * 2.0), 2), 32) END), 0) AS BIGINT) AS samples FROM file WHERE in_scope GROUP BY asset_id) SELECT kind, count(*) AS assets, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(samples) AS BIGINT) AS samples FROM a GROUP BY kind""")
def agg_18(spark, d):
    ext = F.col("extension")
    n = F.when(ext == ".mp4", X.sample_count(F.col("duration"), 2.0, 2, 32))
    a = load(spark, d, "file").filter("in_scope").groupBy("asset_id").agg(
        F.when(F.bool_or(ext == ".mp4"), "video").when(F.bool_or(~M.is_raw(ext)), "rendered").otherwise("raw").alias("kind"), F.count_if(F.col("component_status") != "complete").alias("pending"), F.coalesce(F.sum(n), F.lit(0)).alias("samples")
    )
    return a.groupBy("kind").agg(F.count("*").alias("assets"), F.sum("pending").cast("long").alias("pending"), F.sum("samples").cast("long").alias("samples"))


#: What the indexed run of the test catalog covers.
INDEX = E.IndexOptions(folders={"YEAR2": False, "Year1/Trip3": False}, raw=True, raw_quality=False, video_quality=True, semantic=True, semantic_videos=True)
#: Rates that the kinds of jobs are timed for.
TIMED = {"view": "metadata.processing", "click": "thumbnail.image", "purchase": "quality.image", "signup": "embedding.image", "error": "scan.hashing"}


def rates_of(spark, d):
    """Rates from the latest complete jobs; each timed one step."""
    name = F.create_map(*[F.lit(x) for pair in TIMED.items() for x in pair])[F.col("kind")]
    j = load(spark, d, "job").filter("status = 'complete'")
    return E.historical_rates(j.select("stamp", "job_id", F.create_map(name, "seconds").alias("seconds"), F.create_map(name, F.get_json_object("props", "$.k").cast("double")).alias("counts")))


def _rate(name):
    kinds = [k for k, n in TIMED.items() if n == name]
    usual = f"CAST({E.RATES[name]} AS DOUBLE)"
    return f"(SELECT coalesce(max(CASE WHEN n > 0 AND s > 0 THEN greatest(s / n, {usual} * 0.45) END), {usual}) FROM timed WHERE kind = '{kinds[0]}')" if kinds else usual


TIMED_SQL = "timed AS (SELECT kind, sum(seconds) AS s, sum(n) AS n FROM (SELECT kind, seconds, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n FROM job WHERE status = 'complete' ORDER BY stamp DESC, job_id DESC LIMIT 8) GROUP BY kind)"
RAW_IN = "extension IN ('.cr3', '.dng')"
CHOSEN = "lower(folder) NOT IN ('year2', 'year1/trip3')"
WORK_SQL = f"""st AS (SELECT file_id, max(CASE WHEN component = 'metadata' THEN status END) AS m, max(CASE WHEN component = 'thumbnail' THEN status END) AS t, max(CASE WHEN component = 'quality' THEN status END) AS q, max(CASE WHEN component = 'embedding:image' THEN status END) AS e FROM component_state GROUP BY file_id),
 r AS (SELECT file.*, coalesce(m, '') = 'complete' AS md, coalesce(t, '') IN ('complete', 'not_requested') AS td, coalesce(q, '') = 'complete' AS qd, coalesce(e, '') = 'complete' AS ed, v.file_id IS NOT NULL AS fd, CASE WHEN duration IS NULL THEN 8 ELSE CAST(least(greatest(ceil(duration * 2.0), 2), 32) AS BIGINT) END AS n,
   CASE WHEN media_type = 'video' THEN 'video' WHEN {RAW_IN} THEN 'raw' ELSE 'image' END AS kind FROM file LEFT JOIN st USING (file_id) LEFT JOIN vector v ON v.file_id = file.file_id WHERE in_scope AND is_online AND {CHOSEN}),
 a AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE kind WHEN 'video' THEN 0 WHEN 'image' THEN 1 ELSE 2 END, relative_path, file_id) AS k FROM r), f AS (SELECT * FROM a WHERE k = 1),
 fc AS (SELECT count(*) AS files, count_if(md AND td) AS reusable, count_if(NOT md) AS metadata, count_if(media_type <> 'video' AND NOT fd) AS grouping_images FROM r),
 w AS (SELECT fc.*, x.* FROM fc, (SELECT count_if(kind = 'video' AND NOT td) AS thumbnails_video, count_if(kind = 'image' AND NOT td) AS thumbnails_image, count_if(kind = 'raw' AND NOT td) AS thumbnails_raw, count_if(kind = 'video' AND NOT qd) AS quality_video, count_if(kind = 'image' AND NOT qd) AS quality_image, 0 AS quality_raw,
   CAST(coalesce(sum(n) FILTER (kind = 'video' AND NOT qd), 0) AS BIGINT) AS quality_samples, CAST(coalesce(sum(n) FILTER (kind = 'video' AND NOT ed), 0) AS BIGINT) AS semantic_samples, CAST(coalesce(sum(n) FILTER (kind = 'video' AND NOT (qd AND ed)), 0) AS BIGINT) AS decode_samples, count_if(kind = 'video' AND NOT (qd AND ed)) AS decode_assets,
   count_if(kind <> 'video' AND NOT ed) AS semantic_images, count(*) AS projection_assets, count(*) AS recommendation_assets, coalesce(bool_and(kind <> 'video' OR duration IS NOT NULL), TRUE) AS durations_known FROM f) x)"""
STEPS = {
    "scan": f"1.0 + metadata * {_rate('scan.discovery')}",
    "hashing": f"metadata * {_rate('scan.hashing')}",
    "metadata": f"metadata * {_rate('metadata.processing')}",
    "thumbnails": f"thumbnails_image * {_rate('thumbnail.image')} + thumbnails_raw * {_rate('thumbnail.raw')} + thumbnails_video * {_rate('thumbnail.video')}",
    "reconciliation": f"0.8 + metadata * {_rate('reconciliation')}",
    "rendered_quality": f"quality_image * {_rate('quality.image')}",
    "raw_quality": f"quality_raw * {_rate('quality.raw')}",
    "video_quality": f"decode_assets * CAST(0.6 AS DOUBLE) + decode_samples * {_rate('video.extraction_total')} + quality_samples * {_rate('quality.video_sample')}",
    "embedding_initialization": "CASE WHEN semantic_images + semantic_samples > 0 THEN 8.0 ELSE 0.0 END",
    "image_embeddings": f"semantic_images * {_rate('embedding.image')}",
    "video_embeddings": f"semantic_samples * {_rate('embedding.video_sample')}",
    "semantic_projection": f"CASE WHEN projection_assets > 0 THEN 0.5 + projection_assets * {_rate('semantic_projection.rate_sample')} ELSE 0.0 END",
    "visual_features": f"grouping_images * {_rate('features.total')}",
    "strict_grouping": f"CASE WHEN grouping_images > 0 THEN 0.8 + grouping_images * {_rate('strict_grouping.rate_sample')} ELSE 0.0 END",
    "recommendations": f"CASE WHEN recommendation_assets > 0 THEN 0.3 + recommendation_assets * {_rate('recommendations.asset')} ELSE 0.0 END",
    "semantic_search": "0.0",
}


@query("agg_19_28_estimate", f"WITH {TIMED_SQL}, {WORK_SQL}, z AS (SELECT *, {', '.join(f'CAST({x} AS DOUBLE) AS {k}_s' for k, x in STEPS.items())} FROM w) SELECT * EXCLUDE ({', '.join(f'{k}_s' for k in STEPS)}), {', '.join(f'round_even({k}_s, 1) AS {k}_seconds' for k in STEPS)}, round_even({' + '.join(f'{k}_s' for k in STEPS)}, 1) AS estimated_seconds FROM z")
def agg_19(spark, d):
    """What is left to do in the catalog by its component records, and the time of all sixteen steps at the rates of the latest jobs."""
    files = settled(load(spark, d, "file"), "file_id", "asset_id", "in_scope", "is_online", "relative_path", "extension", "media_type", "duration")
    work = E.indexed_work(files, load(spark, d, "component_state"), load(spark, d, "vector"), INDEX)
    return E.index_seconds(work, rates_of(spark, d))


@query("agg_28_embedding_plan", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN {RAW_IN} THEN 1 ELSE 0 END, CASE WHEN in_scope THEN 0 ELSE 1 END, CASE WHEN role = 'camera_jpeg' THEN 0 ELSE 1 END,
   CASE WHEN extension = '.jxl' AND NOT (role LIKE 'managed%' OR role LIKE 'derived%') THEN 1 ELSE 0 END, lower(relative_path), relative_path, file_id) AS k FROM file WHERE is_online AND {CHOSEN}),
 s AS (SELECT file_id, max(input_fingerprint) AS rec FROM component_state WHERE component = 'embedding:image' AND status = 'complete' AND version = 'e1' GROUP BY file_id), fr AS (SELECT file_id, count(*) AS frames FROM job WHERE status = 'complete' GROUP BY file_id),
 o AS (SELECT media_type, coalesce(duration, 0) > 0 AS known, CASE WHEN media_type <> 'video' THEN 1 WHEN coalesce(duration, 0) > 0 THEN CAST(least(greatest(ceil(duration * 2.0), 2), 32) AS BIGINT) ELSE 0 END AS units, md5(CAST(p.file_id AS STRING)) AS mark, rec, v.input_fingerprint AS vec, frames FROM p LEFT JOIN s USING (file_id) LEFT JOIN vector v ON v.file_id = p.file_id LEFT JOIN fr ON fr.file_id = p.file_id WHERE k = 1),
 t AS (SELECT CAST(coalesce(sum(units) FILTER (media_type <> 'video'), 0) AS BIGINT) AS images, CAST(coalesce(sum(units) FILTER (media_type = 'video'), 0) AS BIGINT) AS video_samples, CAST(coalesce(sum(units) FILTER (rec = mark AND CASE WHEN media_type = 'video' THEN frames = units ELSE vec = mark END), 0) AS BIGINT) AS cached, count_if(media_type = 'video' AND NOT known) AS unknown_videos FROM o)
 SELECT *, images + video_samples - cached AS pending, (images + video_samples - cached) * 768 * 2 AS storage_bytes, round_even(CASE WHEN images + video_samples > cached THEN 8.0 ELSE 0.0 END + images * CAST(0.25 AS DOUBLE) + video_samples * CAST(0.3 AS DOUBLE), 1) AS seconds FROM t""")
def agg_28(spark, d):
    """Vectors that the catalog's assets need, those at hand, and what the others take."""
    files = settled(load(spark, d, "file"), "file_id", "asset_id", "in_scope", "is_online", "relative_path", "extension", "role", "media_type", "duration")
    files = files.withColumn("input_fingerprint", F.md5(F.col("file_id").cast("string").cast("binary")))
    frames = load(spark, d, "job").filter("status = 'complete'").groupBy("file_id").agg(F.count("*").alias("n"))
    # each component by itself: what can't hold the one that is asked for drops out of the plan
    states = reduce(DataFrame.unionByName, [load(spark, d, n) for n in ("state_metadata", "state_thumbnail", "state_quality", "state_embedding")])
    return E.embedding_plan(files, states, load(spark, d, "vector"), frames, INDEX, "e1", 768)


@query("agg_20_duplicate_counts", "WITH fam AS (SELECT media_type, sha256, count(*) AS n, count(DISTINCT asset_id) AS a FROM file GROUP BY ALL) SELECT media_type, count(*) AS families, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, count_if(a > 1) AS across_assets FROM fam WHERE n > 1 GROUP BY media_type")
def agg_20(spark, d):
    fam = load(spark, d, "file").groupBy("media_type", "sha256").agg(F.count("*").alias("n"), F.count_distinct("asset_id").alias("a")).filter("n > 1")
    return fam.groupBy("media_type").agg(F.count("*").alias("families"), F.sum(F.col("n") - 1).cast("long").alias("duplicate_files"), F.count_if(F.col("a") > 1).alias("across_assets"))


@query("agg_21_group_statistics", "SELECT n AS size, count(*) AS groups, min(span) AS least_span, max(span) AS most_span FROM (SELECT group_id, count(*) AS n, date_diff('day', CAST(min(created_day) AS DATE), CAST(max(created_day) AS DATE)) AS span FROM asset WHERE group_id IS NOT NULL GROUP BY group_id) GROUP BY n")
def agg_21(spark, d):
    g = load(spark, d, "asset").filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("size"), F.datediff(F.max("created_day").cast("date"), F.min("created_day").cast("date")).cast("long").alias("span"))
    return g.groupBy("size").agg(F.count("*").alias("groups"), F.min("span").alias("least_span"), F.max("span").alias("most_span"))


@query("agg_23_recommendation_stats", f"""WITH {B.CATALOG}, {B.RECOMMENDED}, g AS (SELECT group_id, count(*) AS n, count_if(recommended) AS r FROM rec JOIN cat USING (asset_id) GROUP BY group_id)
 SELECT CAST(sum(n) AS BIGINT) AS assets, CAST(sum(r) AS BIGINT) AS recommended, count_if(n > 1 AND r > 0) AS multi_recommending, count_if(n = 1 AND r > 0) AS singleton_recommending, count_if(r = 1) AS with_one, count_if(r = 2) AS with_two, count_if(r = 3) AS with_three, count_if(r = 0) AS without FROM g""")
def agg_23(spark, d):
    """How a recommendation run went, by group."""
    from ..operators.selection import recommendation_stats

    return recommendation_stats(B.decisions_of(spark, d))


@query("agg_25_set_fingerprint", "SELECT group_id, sha256(string_agg(CAST(asset_id AS STRING), chr(10) ORDER BY CAST(asset_id AS STRING))) AS fingerprint FROM asset GROUP BY group_id")
def agg_25(spark, d):
    """Order-independent; it is defined on the sorted list of a set's ids, here of every group."""
    return load(spark, d, "asset").groupBy("group_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("asset_id").cast("string"))), "\n"), 256).alias("fingerprint"))


@query("agg_26_snapshot_fingerprint", """WITH r AS (SELECT file_id, sha256(concat_ws('|', CAST(file_id AS STRING), relative_path, CAST(size_bytes AS STRING), sha256)) AS h FROM file), b AS (SELECT file_id // 10000 AS block, count(*) AS n, sha256(string_agg(h, '' ORDER BY file_id)) AS h FROM r GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY block)) AS fingerprint FROM b""")
def agg_26(spark, d):
    from ..operators.snapshots import fingerprint

    return fingerprint(load(spark, d, "file"), "file_id", ["file_id", "relative_path", "size_bytes", "sha256"])


@query("agg_27_camera_identity", """WITH m AS (SELECT asset_id, lower(trim(CASE WHEN json_valid(text) THEN json_extract_string(text, '$.exif.Make') ELSE '' END)) AS make, lower(trim(CASE WHEN json_valid(text) THEN json_extract_string(text, '$.exif.Model') ELSE '' END)) AS model FROM file LEFT JOIN metadata USING (file_id)),
 c AS (SELECT asset_id, CASE WHEN coalesce(make, '') <> '' OR coalesce(model, '') <> '' THEN coalesce(make, '') || '|' || coalesce(model, '') END AS camera FROM m) SELECT asset_id, CASE WHEN count(DISTINCT camera) = 1 THEN max(camera) END AS camera FROM c GROUP BY asset_id""")
def agg_27(spark, d):
    """The camera of an asset, if its files name exactly one."""
    exif = F.from_json("text", "exif map<string,string>")["exif"]
    names = load(spark, d, "metadata").select("file_id", F.try_element_at(exif, F.lit("Make")).alias("make"), F.try_element_at(exif, F.lit("Model")).alias("model"))
    g = load(spark, d, "file").select("asset_id", "file_id").join(names, "file_id", "left").groupBy("asset_id").agg(M.camera_identity(F.col("make"), F.col("model")).alias("c"))
    return g.select("asset_id", F.concat("c.make", F.lit("|"), "c.model").alias("camera"))


@query("agg_29_timings", "SELECT kind, count(*) AS n, round(sum(seconds), 6) AS seconds FROM job GROUP BY kind")
def agg_29(spark, d):
    return load(spark, d, "job").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"))


@query("agg_30_offline_media", "SELECT count_if(media_type = 'image') AS images, count_if(media_type = 'video') AS videos FROM file WHERE NOT is_online")
def agg_30(spark, d):
    t = F.col("media_type")
    return load(spark, d, "file").filter("not is_online").agg(F.count_if(t == "image").alias("images"), F.count_if(t == "video").alias("videos"))
