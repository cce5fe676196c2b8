"""Catalog browse, facets, order and pages (CMP-1..6, PRJ, FLT, SRT, AGG-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..operators import browse as B
from ..operators import summaries as V
from .catalog import load
from .registry import query

RAW_SQL = "(lower(extension) IN ('.cr2','.cr3','.nef','.arw','.dng','.raf','.rw2'))"
#: Order of preference of files, as ORDER BY.
PREF = f"""CASE WHEN in_scope THEN 0 ELSE 1 END, CASE WHEN is_online THEN 0 ELSE 1 END, CASE WHEN NOT {RAW_SQL} THEN 0 ELSE 1 END,
 CASE WHEN role = 'camera_jpeg' THEN 0 ELSE 1 END, CASE WHEN extension = '.jxl' AND NOT (role LIKE 'managed%' OR role LIKE 'derived%') THEN 1 ELSE 0 END, lower(relative_path), relative_path, file_id"""

CATALOG = f"""pref AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS rn,
   row_number() OVER (PARTITION BY asset_id, width > 0 AND height > 0 ORDER BY {PREF}) AS rd FROM file),
 summ AS (SELECT asset_id, max(CASE WHEN rn = 1 THEN file_id END) AS preferred_file_id, max(CASE WHEN rn = 1 THEN relative_path END) AS preferred_path, max(CASE WHEN rn = 1 THEN filename END) AS filename,
   max(CASE WHEN rd = 1 AND width > 0 AND height > 0 THEN width END) AS width, max(CASE WHEN rd = 1 AND width > 0 AND height > 0 THEN height END) AS height,
   CASE WHEN bool_or(in_scope AND NOT {RAW_SQL}) THEN max(CASE WHEN in_scope AND NOT {RAW_SQL} THEN quality_score END) ELSE max(CASE WHEN in_scope THEN quality_score END) END AS quality,
   count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM pref GROUP BY asset_id HAVING bool_or(in_scope)),
 cat AS (SELECT a.asset_id, a.media_type, a.capture_time, a.selection_state, a.group_id, s.preferred_file_id, s.preferred_path, s.filename, s.width, s.height, s.quality, s.n_files, s.bytes FROM asset a JOIN summ s ON a.asset_id = s.asset_id)"""
VIEWS_HINT = " /* FROM file JOIN asset */ "


def catalog_of(spark: SparkSession, d: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    return B.browse_catalog(load(spark, d, "asset"), load(spark, d, "file", given))


@query("cmp_1_browse_catalog", f"WITH {CATALOG} SELECT * FROM cat")
def cmp_1(spark, d):
    return catalog_of(spark, d)


@query("agg_3_preferred_representation", f"SELECT asset_id, file_id, relative_path, role FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS rn FROM file) WHERE rn = 1")
def agg_3(spark, d):
    return B.preferred_file(load(spark, d, "file")).select("asset_id", "file_id", "relative_path", "role")


@query("agg_3_cmp_32_preferred_with_component", f"SELECT asset_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN in_scope THEN 0 ELSE 1 END, CASE WHEN is_online THEN 0 ELSE 1 END, CASE WHEN component_status = 'complete' THEN 0 ELSE 1 END, {PREF}) AS rn FROM file WHERE in_scope AND is_online) WHERE rn = 1")
def cmp_32(spark, d):
    return B.preferred_file(load(spark, d, "file").filter("in_scope and is_online"), F.col("component_status") == "complete").select("asset_id", "file_id")


@query("cmp_2_faceted_browse", f"WITH {CATALOG} SELECT asset_id, filename, quality FROM cat WHERE asset_id IN (SELECT asset_id FROM file WHERE in_scope AND folder IN ('', 'Year1')) AND media_type = 'image' AND selection_state = 'selected' AND width >= height AND lower(filename) LIKE '%img%'")
def cmp_2(spark, d):
    catalog = B.browse_catalog(load(spark, d, "asset"), load(spark, d, "file"), ["", "Year1"])
    found = B.facets(catalog, media_type="image", decision="selected", layout="horizontal", text="IMG")
    return found.select("asset_id", "filename", "quality")


@query("srt_1_4_page", f"WITH {CATALOG} SELECT asset_id, capture_time FROM cat ORDER BY capture_time DESC NULLS LAST, asset_id LIMIT 60 OFFSET 120")
def srt_1_4(spark, d):
    return B.page(B.ordered(catalog_of(spark, d)), 3, 60).select("asset_id", "capture_time")


@query("srt_1_quality_order", f"WITH {CATALOG} SELECT asset_id, quality FROM cat ORDER BY quality ASC NULLS LAST, asset_id LIMIT 100")
def srt_1_quality(spark, d):
    return B.page(B.ordered(catalog_of(spark, d), "quality", False), 1, 100).select("asset_id", "quality")


@query("srt_2_browser_sort", f"WITH {CATALOG} SELECT asset_id, filename, row_number() OVER (ORDER BY lower(filename) DESC, capture_time DESC NULLS LAST, asset_id) AS place FROM cat QUALIFY place <= 200")
def srt_2(spark, d):
    """The base order breaks ties even when the sort is reversed."""
    order = [F.lower("filename").desc(), F.col("capture_time").desc_nulls_last(), "asset_id"]
    top = catalog_of(spark, d).orderBy(*order).limit(200)
    return top.select("asset_id", "filename", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("flt_10_srt_3_similarity_or_name", f"""WITH {CATALOG}, s AS (SELECT asset_id, filename, (asset_id % 97) / 97.0 AS raw, asset_id % 2 AS has FROM cat),
 m AS (SELECT asset_id, filename LIKE '%img_1%' OR lower(filename) LIKE '%img_1%' AS filename_match, CASE WHEN has = 0 THEN raw END AS similarity FROM s)
 SELECT asset_id, filename_match, similarity FROM m WHERE filename_match OR similarity >= 0.9 ORDER BY filename_match DESC, coalesce(similarity, -2) DESC, asset_id LIMIT 150""")
def flt_10(spark, d):
    c = catalog_of(spark, d)
    scores = c.filter("asset_id % 2 = 0").select("asset_id", ((F.col("asset_id") % 97) / F.lit(97.0)).alias("similarity"))
    m = c.join(scores, "asset_id", "left").select("asset_id", F.lower("filename").contains("img_1").alias("filename_match"), "similarity")
    return m.filter(F.col("filename_match") | (F.col("similarity") >= 0.9)).orderBy(F.desc("filename_match"), F.coalesce("similarity", F.lit(-2.0)).desc(), "asset_id").limit(150)


@query("cmp_3_group_windows", f"WITH {CATALOG} SELECT group_id, count(*) AS n_members, min(asset_id) AS first_asset, max(asset_id) AS last_asset, max(quality) AS best_quality FROM cat WHERE group_id IS NOT NULL AND selection_state = 'selected' GROUP BY group_id HAVING count(*) >= 2")
def cmp_3(spark, d):
    c = catalog_of(spark, d)
    return B.windows_of_groups(B.facets(c, decision="selected"), c)


@query("cmp_3_requalified_groups", f"WITH {CATALOG} SELECT group_id, count(*) AS n_members, min(asset_id) AS first_asset, max(asset_id) AS last_asset, max(quality) AS best_quality FROM cat WHERE group_id IN (SELECT group_id FROM cat WHERE quality >= 0.9 AND group_id IS NOT NULL) GROUP BY group_id HAVING count(*) >= 2")
def cmp_3_re(spark, d):
    c = catalog_of(spark, d)
    return B.windows_of_groups(c.filter("quality >= 0.9"), c, qualify=True)


@query("cmp_4_asset_list", f"WITH {CATALOG} SELECT asset_id, media_type, quality FROM cat WHERE asset_id IN (SELECT asset_id FROM file WHERE in_scope AND (lower(relative_path) LIKE 'year2/%')) AND asset_id IN (SELECT asset_id FROM file WHERE media_type = 'video') ORDER BY quality DESC NULLS LAST, asset_id LIMIT 180")
def cmp_4(spark, d):
    files = load(spark, d, "file")
    c = catalog_of(spark, d).join(files.filter(F.col("in_scope") & M.in_folder(F.col("relative_path"), "Year2")).select("asset_id"), "asset_id", "left_semi")
    c = c.join(files.filter("media_type = 'video'").select("asset_id"), "asset_id", "left_semi")
    return B.page(B.ordered(c, "quality"), 1, 180).select("asset_id", "media_type", "quality")


@query("cmp_5_jn_6_group_list", f"""WITH {CATALOG} SELECT group_id, count(*) AS n_members, max(quality) AS quality FROM cat WHERE group_id IS NOT NULL
 AND EXISTS (SELECT 1 FROM asset a JOIN file f ON a.asset_id = f.asset_id WHERE a.group_id = cat.group_id AND f.in_scope AND f.is_online AND f.folder = 'Year1')
 GROUP BY group_id ORDER BY quality DESC NULLS LAST, group_id LIMIT 60""")
def cmp_5(spark, d):
    c, a, f = catalog_of(spark, d), load(spark, d, "asset"), load(spark, d, "file")
    inside = f.filter("in_scope and is_online and folder = 'Year1'").join(a, "asset_id").select("group_id")
    g = c.filter("group_id is not null").join(inside, "group_id", "left_semi").groupBy("group_id").agg(F.count("*").cast("long").alias("n_members"), F.max("quality").alias("quality"))
    return B.page(g.orderBy(F.col("quality").desc_nulls_last(), "group_id"), 1, 60)


@query("cmp_6_video_singletons", "SELECT asset_id AS group_id, 1 AS n_members FROM asset WHERE media_type = 'video' AND asset_id IN (SELECT asset_id FROM file WHERE in_scope AND is_online)")
def cmp_6(spark, d):
    online = load(spark, d, "file").filter("in_scope and is_online").select("asset_id")
    return load(spark, d, "asset").filter("media_type = 'video'").join(online, "asset_id", "left_semi").select(F.col("asset_id").alias("group_id"), F.lit(1).alias("n_members"))


@query("win_1_locate_group", "SELECT group_id, place, CAST(floor((place - 1) / 10) + 1 AS BIGINT) AS page FROM (SELECT group_id, row_number() OVER (ORDER BY n DESC, group_id) AS place FROM (SELECT group_id, count(*) AS n FROM asset WHERE group_id IS NOT NULL GROUP BY group_id)) WHERE group_id IN (10, 100, 101)")
def win_1(spark, d):
    g = load(spark, d, "asset").filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))
    p = B.locate(g, [F.desc("n"), F.col("group_id")], 10)
    return p.filter("group_id in (10, 100, 101)").select("group_id", (F.col("position") + 1).alias("place"), "page")


@query("win_2_group_ordinals", "SELECT group_id, row_number() OVER (ORDER BY first_time NULLS LAST, group_id) AS ordinal FROM (SELECT group_id, min(capture_time) AS first_time FROM asset WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(*) >= 2)")
def win_2(spark, d):
    g = load(spark, d, "asset").filter("group_id is not null").groupBy("group_id").agg(F.min("capture_time").alias("first_time"), F.count("*").alias("n")).filter("n >= 2")
    return B.locate(g, [F.col("first_time").asc_nulls_last(), F.col("group_id")], 10).select("group_id", (F.col("position") + 1).alias("ordinal"))


@query("win_12_locate_assets", "SELECT asset_id, position, CAST(floor(position / 60) * 60 AS BIGINT) AS page_offset FROM (SELECT asset_id, row_number() OVER (ORDER BY capture_time DESC NULLS LAST, asset_id) - 1 AS position FROM asset)")
def win_12(spark, d):
    p = B.locate(load(spark, d, "asset"), [F.col("capture_time").desc_nulls_last(), F.col("asset_id")], 60)
    return p.select("asset_id", "position", ((F.col("page") - 1) * 60).alias("page_offset"))


def states_sql(*names):
    return "st AS (SELECT file_id, " + ", ".join(f"max(CASE WHEN component = '{c}' THEN {v} END) AS {c[0]}_{v}" for c, v in names) + " FROM file_state GROUP BY file_id)"


RECOMMENDED = "rec AS (SELECT asset_id, k = 1 AS representative, k = 1 AND coalesce(quality, 0) >= 0.7 AS recommended FROM (SELECT asset_id, quality, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC NULLS LAST, capture_time NULLS LAST, asset_id) AS k FROM cat WHERE group_id IS NOT NULL))"
CODEC = "CASE extension WHEN '.mp4' THEN 'h264' WHEN '.jxl' THEN 'jpeg-xl' END"
EMBEDDED = """CASE WHEN is_raw AND size_bytes % 3 = 0 THEN '{"quality_source": "raw_embedded_preview"}' END"""


def decisions_of(spark, d, given=None):
    """Representatives and recommendations of the catalog's groups."""
    from ..operators.selection import recommend

    return recommend(catalog_of(spark, d, given), 0.7).select("group_id", "asset_id", (F.col("reason") != "not_representative").alias("representative"), "recommended")


@query("prj_1_asset_summary", f"""WITH {CATALOG}, {RECOMMENDED}, {states_sql(("metadata", "status"), ("thumbnail", "status"), ("quality", "status"), ("thumbnail", "output_path"))},
 f0 AS (SELECT file.*, {CODEC} AS codec, media_type = 'image' AND is_raw AS rw, bool_or(in_scope) OVER (PARTITION BY asset_id) AS scoped, m_status, t_status, q_status, coalesce(t_status = 'complete' AND t_output_path <> '', FALSE) AS thumb FROM file LEFT JOIN st USING (file_id)),
 f AS (SELECT *, NOT rw OR NOT bool_or(NOT rw) OVER (PARTITION BY asset_id) AS counts FROM f0 WHERE in_scope OR NOT scoped),
 r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS kp, row_number() OVER (PARTITION BY asset_id, is_online ORDER BY {PREF}) AS ko, row_number() OVER (PARTITION BY asset_id, is_online AND NOT rw ORDER BY {PREF}) AS kd, row_number() OVER (PARTITION BY asset_id, thumb ORDER BY {PREF}) AS kt, row_number() OVER (PARTITION BY asset_id, coalesce(width > 0 AND height > 0, FALSE) ORDER BY {PREF}) AS kz,
   row_number() OVER (PARTITION BY asset_id, counts AND quality_score IS NOT NULL ORDER BY CASE WHEN is_online THEN 0 ELSE 1 END, relative_path, file_id) AS kq FROM f),
 g AS (SELECT asset_id, max(codec) FILTER (ko = 1 AND is_online) AS oc, max(codec) FILTER (kp = 1) AS pc, max(filename) FILTER (kp = 1) AS filename, max(relative_path) FILTER (kp = 1) AS relative_path, max(file_id) FILTER (kp = 1) AS preferred_physical_id, max(file_id) FILTER (ko = 1 AND is_online) AS original_file_id,
   max(file_id) FILTER (kd = 1 AND is_online AND NOT rw) AS df, max(CASE WHEN extension = '.jxl' AND thumb THEN 'preview' ELSE 'original' END) FILTER (kd = 1 AND is_online AND NOT rw) AS dk, max(CASE WHEN rw OR (extension = '.jxl' AND thumb) THEN 'preview' ELSE 'original' END) FILTER (ko = 1 AND is_online) AS od,
   max(file_id) FILTER (kt = 1 AND thumb) AS thumbnail_file_id, max(width) FILTER (kz = 1 AND width > 0 AND height > 0) AS width, max(height) FILTER (kz = 1 AND width > 0 AND height > 0) AS height, max(quality_score) FILTER (kq = 1 AND counts AND quality_score IS NOT NULL) AS quality_score,
   max(CASE WHEN is_raw AND size_bytes % 3 = 0 THEN 'RAW embedded preview' WHEN media_type = 'video' THEN 'sampled video frames' ELSE 'rendered image' END) FILTER (kq = 1 AND counts AND quality_score IS NOT NULL) AS quality_source,
   concat_ws(',', CASE WHEN NOT bool_or(is_online) THEN 'offline' END, CASE WHEN bool_or(counts AND (coalesce(m_status, '') IN ('pending', 'running') OR coalesce(t_status, '') IN ('pending', 'running') OR coalesce(q_status, '') IN ('pending', 'running'))) THEN 'processing' END,
    CASE WHEN bool_or(counts AND 'unsupported' IN (coalesce(m_status, ''), coalesce(t_status, ''), coalesce(q_status, ''))) THEN 'unsupported' END, CASE WHEN bool_or(counts AND 'failed' IN (coalesce(m_status, ''), coalesce(t_status, ''), coalesce(q_status, ''))) THEN 'failed' END) AS issues FROM r GROUP BY asset_id),
 n AS (SELECT asset_id, count(*) AS physical_count, count_if(is_online) AS online_count FROM file GROUP BY asset_id), gr AS (SELECT group_id, count(*) AS members FROM asset GROUP BY group_id)
 SELECT a.asset_id, a.media_type, CASE WHEN original_file_id IS NULL THEN pc ELSE coalesce(oc, pc) END AS codec, capture_time, capture_time_kind, filename, relative_path, online_count > 0 AS is_online, physical_count, online_count, thumbnail_file_id, original_file_id, coalesce(df, original_file_id) AS display_file_id, coalesce(dk, od) AS display_kind, quality_score, quality_source, issues,
  coalesce(representative, FALSE) AS is_representative, a.group_id AS current_group_id, coalesce(recommended, FALSE) AS auto_recommended, selection_state AS user_decision, 'run-1' AS recommendation_run_id, preferred_physical_id, members AS strict_group_member_count, width, height
 FROM asset a JOIN g USING (asset_id) JOIN n USING (asset_id) LEFT JOIN rec USING (asset_id) LEFT JOIN gr ON gr.group_id = a.group_id""")
def prj_1(spark, d):
    """Every asset's summary in full."""
    assets = load(spark, d, "asset")
    from ..operators.scratch import written

    given = {"file": written(load(spark, d, "file"), "files")}
    files = given["file"].withColumns({"codec": F.expr(CODEC), "quality_record": F.expr(EMBEDDED)})
    groups = assets.filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("members"))
    out = V.asset_summaries(assets, files, load(spark, d, "file_state", given), decisions_of(spark, d, given), groups, "run-1")
    return out.withColumn("issues", F.array_join("issues", ","))


@query("prj_2_effective_dimensions", f"SELECT asset_id, width, height FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS rn FROM file WHERE width > 0 AND height > 0) WHERE rn = 1")
def prj_2(spark, d):
    return B.preferred_file(load(spark, d, "file").filter("width > 0 and height > 0")).select("asset_id", "width", "height")


@query("prj_3_issue_tags", f"""WITH s AS (SELECT file_id, asset_id, is_online, in_scope, {RAW_SQL} AS raw, component_status AS m, CASE file_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'complete' END AS t, CASE file_id % 7 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'pending' ELSE 'complete' END AS q FROM file),
 a AS (SELECT *, in_scope OR NOT bool_or(in_scope) OVER (PARTITION BY asset_id) AS active FROM s), r AS (SELECT *, active AND (NOT raw OR NOT bool_or(active AND NOT raw) OVER (PARTITION BY asset_id)) AS counted FROM a)
 SELECT asset_id, concat_ws(',', CASE WHEN NOT bool_or(active AND is_online) THEN 'offline' END, CASE WHEN bool_or(counted AND (m IN ('pending', 'running') OR t IN ('pending', 'running') OR q IN ('pending', 'running'))) THEN 'processing' END,
 CASE WHEN bool_or(counted AND (m = 'unsupported' OR t = 'unsupported' OR q = 'unsupported')) THEN 'unsupported' END, CASE WHEN bool_or(counted AND (m = 'failed' OR t = 'failed' OR q = 'failed')) THEN 'failed' END) AS issues FROM r GROUP BY asset_id""")
def prj_3(spark, d):
    """Issues of an asset from the three component states of its files.

    Files in scope count, all if none is; RAW files do not where there is another.
    Offline: none of them is online.  One aggregate keeps what each case needs.
    """
    f = F.col("file_id")
    s = F.array("component_status", F.when(f % 5 == 0, "running").when(f % 5 == 1, "failed").otherwise("complete"), F.when(f % 7 == 0, "unsupported").when(f % 7 == 1, "pending").otherwise("complete"))
    has = {"processing": F.arrays_overlap(s, F.array(F.lit("pending"), F.lit("running"))), "unsupported": F.array_contains(s, "unsupported"), "failed": F.array_contains(s, "failed")}
    raw, scope = M.is_raw(F.col("extension")), F.col("in_scope")
    cases = {"scope_other": scope & ~raw, "scope": scope, "other": ~raw, "all": F.lit(True)}
    g = load(spark, d, "file").groupBy("asset_id").agg(
        F.bool_or(scope).alias("scoped"), *[F.bool_or(c).alias(f"any_{k}") for k, c in cases.items()], F.bool_or(scope & F.col("is_online")).alias("online_scope"), F.bool_or("is_online").alias("online_all"),
        *[F.bool_or(c & x).alias(f"{n}_{k}") for n, x in has.items() for k, c in cases.items()],
    )
    pick = lambda n: F.when(F.col("scoped"), F.when(F.col("any_scope_other"), F.col(f"{n}_scope_other")).otherwise(F.col(f"{n}_scope"))).otherwise(F.when(F.col("any_other"), F.col(f"{n}_other")).otherwise(F.col(f"{n}_all")))
    offline = ~F.when(F.col("scoped"), F.col("online_scope")).otherwise(F.col("online_all"))
    return g.select("asset_id", F.concat_ws(",", F.when(offline, "offline"), *[F.when(pick(n), n) for n in has]).alias("issues"))


@query("prj_4_quality_source", "SELECT file_id, CASE WHEN quality_score IS NULL THEN NULL WHEN is_raw AND file_id % 4 <> 0 THEN 'RAW embedded preview' WHEN media_type = 'video' THEN 'sampled video frames' ELSE 'rendered image' END AS label FROM file")
def prj_4(spark, d):
    """Where a score comes from, by the scorer's own record, else by the kind of media; nothing without a score."""
    f = F.col("file_id")
    record = F.when(F.col("is_raw"), F.when(f % 4 == 0, "{broken").otherwise('{"quality_source": "raw_embedded_preview"}'))
    return load(spark, d, "file").select("file_id", M.quality_source(F.col("quality_score"), record, F.col("media_type")).alias("label"))


@query("prj_5_representation_label", """WITH p AS (SELECT file_id, CASE WHEN is_raw AND role = 'original' THEN 'camera_raw' ELSE role END AS role, sha256, asset_id FROM file), n AS (SELECT sha256, count(*) AS n FROM file GROUP BY sha256)
 SELECT file_id, CASE WHEN role = 'managed_jxl' THEN CASE file_id % 3 WHEN 0 THEN 'JPEG XL derivative · Archive' WHEN 1 THEN 'AV1 derivative · managed profile' ELSE 'Managed derivative · Web' END WHEN role = 'camera_raw' THEN 'RAW source' WHEN role = 'camera_jpeg' THEN 'Camera JPEG'
 WHEN n.n > 1 AND file_id % 2 = 0 THEN 'Exact duplicate' WHEN file_id % 6 = 1 THEN 'RAW/JPEG pair' ELSE 'Physical file' END AS label FROM p JOIN n USING (sha256)""")
def prj_5(spark, d):
    """Managed derivative, then role, then the first relationship in order of its label."""
    f = F.col("file_id")
    size = load(spark, d, "file").groupBy("sha256").agg(F.count("*").alias("n"))
    files = load(spark, d, "file").join(size, "sha256").withColumn("role", F.when(F.col("is_raw") & (F.col("role") == "original"), "camera_raw").otherwise(F.col("role")))
    managed = F.when(F.col("role") == "managed_jxl", f)
    codec = F.when(f % 3 == 0, "jpeg-xl").when(f % 3 == 1, "av1")
    profile = F.when(f % 3 == 0, "Archive").when(f % 3 == 2, "Web")
    related = F.array_compact(F.array(F.when(f % 6 == 1, "raw_jpeg"), F.when((F.col("n") > 1) & (f % 2 == 0), "exact_duplicate")))
    return files.select("file_id", M.representation_label(managed, codec, profile, F.col("role"), related).alias("label"))


@query("prj_6_derivative_payload", "SELECT file_id, s AS source_bytes, size_bytes AS output_bytes, CASE WHEN s <> 0 THEN round_even(CAST(size_bytes AS DOUBLE) / s * 100, 1) END AS output_percent_of_source FROM (SELECT file_id, size_bytes, CASE file_id % 3 WHEN 0 THEN size_bytes * 2 + file_id WHEN 1 THEN size_bytes * 3 + 1 END AS s FROM file WHERE role = 'managed_jxl')")
def prj_6(spark, d):
    """The source's size from the stored contract: at its top, else inside ``source``."""
    f, size = F.col("file_id"), F.col("size_bytes")
    text = F.when(f % 3 == 0, F.format_string('{"source_size_bytes": %d}', size * 2 + f)).when(f % 3 == 1, F.format_string('{"source": {"size_bytes": %d}}', size * 3 + 1)).otherwise("{broken")
    c = F.from_json(text, "source_size_bytes long, source struct<size_bytes: long>")
    files = load(spark, d, "file").filter("role = 'managed_jxl'").select("file_id", size.alias("output_bytes"), F.coalesce(F.nullif(c["source_size_bytes"], F.lit(0)), c["source"]["size_bytes"]).alias("source_bytes"))
    return files.select("file_id", "source_bytes", "output_bytes", F.when(F.col("source_bytes") != 0, F.bround(F.col("output_bytes") / F.col("source_bytes") * 100, 1)).alias("output_percent_of_source"))


@query("prj_7_asset_detail", f"""WITH {states_sql(("metadata", "status"), ("thumbnail", "status"), ("quality", "status"), ("thumbnail", "output_path"), ("metadata", "version"))}, dup AS (SELECT sha256 FROM file GROUP BY sha256 HAVING count(*) > 1),
 x AS (SELECT file_id, CASE WHEN size_bytes % 23 <> 0 AND size_bytes % 200 - 100 BETWEEN -90 AND 90 THEN size_bytes % 200 - 100 END AS lat, size_bytes % 300 - 150 AS lon FROM (SELECT file_id FROM metadata) JOIN file USING (file_id)),
 f AS (SELECT file.*, row_number() OVER (PARTITION BY asset_id ORDER BY {PREF}) AS rn, bool_or(in_scope) OVER (PARTITION BY asset_id) AS scoped, lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon, m_status, t_status, q_status, m_version, coalesce(t_status = 'complete' AND t_output_path <> '', FALSE) AND in_scope AS thumb, d.sha256 IS NOT NULL AS twin, v.file_id IS NOT NULL AS managed
   FROM file LEFT JOIN st USING (file_id) LEFT JOIN dup d ON d.sha256 = file.sha256 LEFT JOIN managed_derivative v ON v.file_id = file.file_id LEFT JOIN x ON x.file_id = file.file_id),
 l AS (SELECT *, row_number() OVER (PARTITION BY asset_id, lat IS NOT NULL AND (in_scope OR NOT scoped) ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, CASE WHEN is_online THEN 0 ELSE 1 END, relative_path, file_id) AS kl FROM f)
 SELECT asset_id, CAST(max(lat) FILTER (kl = 1 AND lat IS NOT NULL AND (in_scope OR NOT scoped)) AS DOUBLE) AS latitude, CAST(max(lon) FILTER (kl = 1 AND lat IS NOT NULL AND (in_scope OR NOT scoped)) AS DOUBLE) AS longitude,
  string_agg(concat_ws('|', CAST(file_id AS STRING), relative_path, role, CASE WHEN managed THEN 'JPEG XL derivative · ' || role WHEN is_raw AND role = 'original' THEN 'RAW source' WHEN role = 'camera_jpeg' THEN 'Camera JPEG' WHEN twin THEN 'Exact duplicate' ELSE 'Physical file' END, CAST(size_bytes AS STRING), CASE WHEN is_online AND in_scope THEN 'o' ELSE '-' END || CASE WHEN thumb THEN 't' ELSE '-' END, coalesce(m_status, '?') || m_version, coalesce(t_status, '?'), coalesce(q_status, '?')), ','
   ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, CASE WHEN is_online THEN 0 ELSE 1 END, relative_path, file_id) AS files FROM l GROUP BY asset_id""")
def prj_7(spark, d):
    """Every asset with its files as structs, spelled out here as text."""
    from ..operators.scratch import written

    given = {"file": written(load(spark, d, "file"), "files")}
    f = given["file"]
    twins = f.join(f.groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1"), "sha256", "left_semi").select("file_id", F.lit("exact_duplicate").alias("kind"))
    managed = load(spark, d, "managed_derivative", given).join(f.select("file_id", "role"), "file_id").select("file_id", F.lit("jpeg-xl").alias("codec"), F.col("role").alias("profile"))
    gps = load(spark, d, "metadata", given).select("file_id", F.get_json_object("text", "$.gps.latitude").alias("latitude"), F.get_json_object("text", "$.gps.longitude").alias("longitude"))
    out = V.asset_details(load(spark, d, "asset"), f, load(spark, d, "file_state", given), twins, managed, gps, ["relative_path", "role", "size_bytes"])
    known = lambda c: F.coalesce(c, F.lit("?"))
    flag = lambda c, t: F.when(c, t).otherwise("-")
    text = lambda x: F.concat_ws("|", x["file_id"].cast("string"), x["relative_path"], x["role"], x["label"], x["size_bytes"].cast("string"), F.concat(flag(x["original"], "o"), flag(x["thumbnail"], "t")), F.concat(known(x["components"]["metadata"]["status"]), x["components"]["metadata"]["version"]), known(x["components"]["thumbnail"]["status"]), known(x["components"]["quality"]["status"]))
    return out.select("asset_id", F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"), F.array_join(F.transform("files", text), ",").alias("files"))


@query("prj_8_component_pivot", "SELECT file_id, max(CASE WHEN kind = 'view' THEN status END) AS metadata_status, max(CASE WHEN kind = 'click' THEN status END) AS thumbnail_status, max(CASE WHEN kind = 'error' THEN status END) AS quality_status FROM job GROUP BY file_id")
def prj_8(spark, d):
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("status")))
    return load(spark, d, "job").groupBy("file_id").agg(pick("view").alias("metadata_status"), pick("click").alias("thumbnail_status"), pick("error").alias("quality_status"))


#: Extensions that the test tables lack, dealt to some of the files.
MORE_EXTENSIONS = [".webm", ".tif", ".webp", ".MTS", ".avif", ".JPEG", ".raf", ".txt"]


@query("prj_9_12_media_classes", f"""WITH p AS (SELECT file_id, role, file_id % 11 = 4 AS provenance, CASE WHEN file_id % 3 = 0 THEN extension ELSE {MORE_EXTENSIONS}[1 + CAST(file_id % 8 AS INT)] END AS x FROM file), e AS (SELECT *, lower(x) AS e FROM p)
 SELECT file_id, CASE WHEN e IN ('.jpg', '.jpeg') THEN 'jpeg' WHEN e IN ('.cr3', '.dng', '.raf') THEN 'raw' WHEN e IN ('.mp4', '.webm') THEN 'video' WHEN e IN ('.mts', '.tif', '.txt') THEN 'other' ELSE 'other_image' END AS category,
 CASE WHEN e IN ('.mp4', '.webm') THEN 'video' WHEN e IN ('.cr3', '.dng', '.raf') THEN 'raw' WHEN e IN ('.jpg', '.jpeg', '.png') THEN 'conventional-image' WHEN e IN ('.jxl', '.avif', '.webp') THEN 'compressed-image' ELSE 'rendered-image' END AS class,
 CASE WHEN provenance OR role LIKE 'managed%' OR role LIKE 'derived%' THEN 'managed' ELSE 'source' END AS origin, CASE WHEN e IN ('.jpg', '.jpeg') THEN 'jpeg' ELSE substr(e, 2) END AS format FROM e""")
def prj_9_12(spark, d):
    f = F.col("file_id")
    other = F.element_at(F.array(*[F.lit(x) for x in MORE_EXTENSIONS]), (f % 8 + 1).cast("int"))
    provenance = load(spark, d, "file").filter("file_id % 11 = 4").select("file_id", F.lit(True).alias("managed"))
    files = load(spark, d, "file").join(provenance, "file_id", "left").withColumn("x", F.when(f % 3 == 0, F.col("extension")).otherwise(other))
    e = F.col("x")
    return files.select("file_id", M.media_category(e).alias("category"), M.representation_class(e).alias("class"), M.representation_origin(F.col("role"), F.col("managed")).alias("origin"), M.format_name(e).alias("format"))


@query("agg_1_asset_quality", f"SELECT asset_id, CASE WHEN bool_or(NOT {RAW_SQL}) THEN max(CASE WHEN NOT {RAW_SQL} THEN quality_score END) ELSE max(quality_score) END AS quality, max(quality_score) AS unruled FROM file WHERE in_scope GROUP BY asset_id")
def agg_1(spark, d):
    raw, q = M.is_raw(F.col("extension")), F.col("quality_score")
    g = load(spark, d, "file").filter("in_scope").groupBy("asset_id").agg(F.bool_or(~raw).alias("r"), F.max(F.when(~raw, q)).alias("a"), F.max(q).alias("unruled"))
    return g.select("asset_id", F.when(F.col("r"), F.col("a")).otherwise(F.col("unruled")).alias("quality"), "unruled")


@query("agg_2_name_key", "SELECT asset_id, min(lower(filename)) AS name_key FROM file WHERE in_scope GROUP BY asset_id")
def agg_2(spark, d):
    return load(spark, d, "file").filter("in_scope").groupBy("asset_id").agg(F.min(F.lower("filename")).alias("name_key"))


@query("flt_1_2_scope_filters", "SELECT a.asset_id, EXISTS (SELECT 1 FROM file f WHERE f.asset_id = a.asset_id AND f.in_scope AND f.is_online) AS online FROM asset a WHERE EXISTS (SELECT 1 FROM file f WHERE f.asset_id = a.asset_id AND f.in_scope)")
def flt_1_2(spark, d):
    g = load(spark, d, "file").filter("in_scope").groupBy("asset_id").agg(F.bool_or("is_online").alias("online"))
    return load(spark, d, "asset").join(g, "asset_id").select("asset_id", "online")


@query("flt_3_recursive_folder", "SELECT file_id, relative_path FROM file WHERE lower(relative_path) LIKE 'year3/trip2/%'")
def flt_3(spark, d):
    return load(spark, d, "file").filter(M.in_folder(F.col("relative_path"), "Year3/Trip2")).select("file_id", "relative_path")


@query("flt_4_exact_folders", "SELECT DISTINCT asset_id FROM file WHERE in_scope AND folder IN ('', 'Year1/Trip4')")
def flt_4(spark, d):
    return load(spark, d, "file").filter(F.col("in_scope") & M.parent_folder(F.col("relative_path")).isin("", "Year1/Trip4")).select("asset_id").distinct()


@query("flt_5_media_type", "SELECT asset_id, media_type = 'video' AS by_asset, EXISTS (SELECT 1 FROM file f WHERE f.asset_id = asset.asset_id AND f.media_type = 'video') AS by_file FROM asset")
def flt_5(spark, d):
    has = load(spark, d, "file").groupBy("asset_id").agg(F.bool_or(F.col("media_type") == "video").alias("v"))
    return load(spark, d, "asset").join(has, "asset_id", "left").select("asset_id", (F.col("media_type") == "video").alias("by_asset"), F.coalesce("v", F.lit(False)).alias("by_file"))


@query("flt_6_filename", "SELECT file_id FROM file WHERE lower(filename) LIKE '%dsc_10%'")
def flt_6(spark, d):
    return load(spark, d, "file").filter(F.lower("filename").contains("DSC_10".lower())).select("file_id")


@query("flt_7_layout", f"WITH {CATALOG} SELECT CASE WHEN width >= height THEN 'horizontal' ELSE 'vertical' END AS layout, count(*) AS n FROM cat WHERE width > 0 AND height > 0 GROUP BY 1")
def flt_7(spark, d):
    c = catalog_of(spark, d)
    both = B.facets(c, layout="horizontal").select(F.lit("horizontal").alias("layout")).unionByName(B.facets(c, layout="vertical").select(F.lit("vertical").alias("layout")))
    return both.groupBy("layout").agg(F.count("*").cast("long").alias("n"))


@query("flt_8_decision", "SELECT asset_id FROM asset WHERE selection_state = 'rejected'")
def flt_8(spark, d):
    return B.facets(load(spark, d, "asset"), decision="rejected").select("asset_id")


@query("flt_9_representatives", f"WITH {CATALOG}, r AS (SELECT group_id, asset_id FROM cat WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY quality DESC NULLS LAST, capture_time NULLS LAST, asset_id) = 1) SELECT asset_id FROM cat WHERE asset_id IN (SELECT asset_id FROM r)")
def flt_9(spark, d):
    from ..operators.groups import representatives

    c = catalog_of(spark, d)
    return c.join(representatives(c), "asset_id", "left_semi").select("asset_id")


@query("srt_9_home_thumbnail", "SELECT asset_id, quality, relative_path FROM (SELECT asset_id, max(quality_score) OVER (PARTITION BY asset_id) AS quality, relative_path, file_id FROM file WHERE in_scope AND is_online) ORDER BY quality DESC NULLS LAST, relative_path, asset_id LIMIT 1")
def srt_9(spark, d):
    f = load(spark, d, "file").filter("in_scope and is_online")
    q = f.groupBy("asset_id").agg(F.max("quality_score").alias("quality"), F.min("relative_path").alias("relative_path"))
    return q.orderBy(F.col("quality").desc_nulls_last(), "relative_path", "asset_id").limit(1)


@query("cmp_33_decision_update", "SELECT asset_id, CASE WHEN asset_id % 10 = 3 THEN 'selected' WHEN asset_id % 10 = 4 THEN 'rejected' ELSE selection_state END AS selection_state FROM asset")
def cmp_33(spark, d):
    a = load(spark, d, "asset")
    changes = a.filter("asset_id % 10 in (3, 4)").select("asset_id", F.when(F.col("asset_id") % 10 == 3, "selected").otherwise("rejected").alias("new"))
    return a.join(changes, "asset_id", "left").select("asset_id", F.coalesce("new", "selection_state").alias("selection_state"))
