"""Joins, latest-per-key, set operations, logs (JN, WIN-3, SET, SRT-10, FLT-15..18)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..operators import states as S
from .catalog import load, settled
from .registry import query


@query("jn_1_asset_files", "SELECT a.asset_id, f.file_id, f.relative_path, a.selection_state FROM asset a JOIN file f ON a.asset_id = f.asset_id WHERE f.in_scope")
def jn_1(spark, d):
    return load(spark, d, "asset").join(load(spark, d, "file").filter("in_scope"), "asset_id").select("asset_id", "file_id", "relative_path", "selection_state")


@query("jn_2_component_left_joins", "SELECT f.file_id, m.status AS metadata_status, t.status AS thumbnail_status FROM file f LEFT JOIN (SELECT file_id, max(status) AS status FROM job WHERE kind = 'view' GROUP BY file_id) m ON f.file_id = m.file_id LEFT JOIN (SELECT file_id, max(status) AS status FROM job WHERE kind = 'click' GROUP BY file_id) t ON f.file_id = t.file_id")
def jn_2(spark, d):
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("status")))
    state = load(spark, d, "job").filter("kind in ('view', 'click')").groupBy("file_id").agg(pick("view").alias("metadata_status"), pick("click").alias("thumbnail_status"))
    return load(spark, d, "file").join(state, "file_id", "left").select("file_id", "metadata_status", "thumbnail_status")


@query("jn_3_win_3_latest_derivative", "SELECT f.file_id, j.job_id AS latest FROM file f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY stamp DESC, job_id DESC) AS k FROM job WHERE status = 'complete') WHERE k = 1) j ON f.file_id = j.file_id")
def jn_3(spark, d):
    """Latest per key as one max of a struct instead of a sort."""
    last = load(spark, d, "job").filter("status = 'complete'").groupBy("file_id").agg(F.max(F.struct("stamp", "job_id")).alias("m")).select("file_id", F.col("m.job_id").alias("latest"))
    return load(spark, d, "file").join(last, "file_id", "left").select("file_id", "latest")


@query("jn_4_active_run", "WITH p AS (SELECT max(job_id) % 5 AS run FROM job) SELECT j.job_id, j.kind FROM job j JOIN p ON j.job_id % 5 = p.run")
def jn_4(spark, d):
    j = load(spark, d, "job")
    pointer = j.agg((F.max("job_id") % 5).alias("run"))  # one row
    return j.join(F.broadcast(pointer), j["job_id"] % 5 == pointer["run"]).select("job_id", "kind")


@query("jn_5_freshness", "SELECT v.vec_id, f.file_id FROM vector v JOIN file f ON v.file_id = f.file_id JOIN component_state s ON s.file_id = v.file_id AND s.component = 'embedding:image' AND s.status = 'complete' AND s.version = 'e1' AND s.input_fingerprint = v.input_fingerprint WHERE f.in_scope AND f.is_online")
def jn_5(spark, d):
    """Vectors whose record is complete, of the run's version and of the input that they were made from."""
    return S.fresh_vectors(load(spark, d, "vector"), load(spark, d, "file"), load(spark, d, "component_state"), "embedding:image", "e1").select("vec_id", "file_id")


@query("jn_7_raw_without_rendered", "SELECT file_id FROM file f WHERE extension IN ('.cr3', '.dng') AND NOT EXISTS (SELECT 1 FROM file r WHERE r.asset_id = f.asset_id AND r.extension NOT IN ('.cr3', '.dng'))")
def jn_7(spark, d):
    f = load(spark, d, "file")
    raw = M.is_raw(F.col("extension"))
    return f.filter(raw).join(f.filter(~raw).select("asset_id"), "asset_id", "left_anti").select("file_id")


CONFLICT = "(SELECT file_id AS id, asset_id AS a, (asset_id * 7 + 11) % 1000 AS b FROM file WHERE file_id % 50 = 1)"


@query("jn_8_either_side", f"SELECT c.id, count(DISTINCT f.file_id) AS files FROM {CONFLICT} c JOIN file f ON f.asset_id IN (c.a, c.b) GROUP BY c.id")
def jn_8(spark, d):
    """The OR of two equalities as one equality after exploding the sides."""
    f = load(spark, d, "file")
    c = f.filter("file_id % 50 = 1").select(F.col("file_id").alias("id"), F.explode(F.array_distinct(F.array(F.col("asset_id"), (F.col("asset_id") * 7 + 11) % 1000))).alias("asset_id"))
    return c.join(f, "asset_id").groupBy("id").agg(F.count_distinct("file_id").alias("files"))


@query("jn_9_both_directions", "WITH e AS (SELECT DISTINCT asset_id AS s, (asset_id * 3 + 1) % 50021 AS t FROM file) SELECT n, string_agg(DISTINCT CAST(o AS STRING), ',' ORDER BY CAST(o AS STRING)) AS others FROM (SELECT s AS n, t AS o FROM e UNION ALL SELECT t, s FROM e) GROUP BY n")
def jn_9(spark, d):
    e = load(spark, d, "file").select(F.col("asset_id").alias("s"), ((F.col("asset_id") * 3 + 1) % 50021).alias("t")).distinct()
    both = e.select(F.col("s").alias("n"), F.col("t").alias("o")).union(e.select("t", "s"))
    return both.groupBy("n").agg(F.array_join(F.array_sort(F.collect_set(F.col("o").cast("string"))), ",").alias("others"))


@query("jn_12_exact_pairs", "SELECT a.media_type, a.sha256, count(*) AS pairs, CAST(sum(CASE WHEN a.asset_id <> b.asset_id THEN 1 ELSE 0 END) AS BIGINT) AS across_assets FROM file a JOIN file b ON a.media_type = b.media_type AND a.sha256 = b.sha256 AND a.file_id < b.file_id GROUP BY a.media_type, a.sha256")
def jn_12(spark, d):
    """Pairs of equal content: n (n - 1) / 2 of each family, less those inside one asset; no pair is formed."""
    choose = lambda c: c * (c - 1) / 2
    own = load(spark, d, "file").groupBy("media_type", "sha256", "asset_id").agg(F.count("*").alias("n"))
    fam = own.groupBy("media_type", "sha256").agg(F.sum("n").alias("n"), F.sum(choose(F.col("n"))).alias("inside")).filter("n > 1")
    pairs = choose(F.col("n"))
    return fam.select("media_type", "sha256", pairs.cast("long").alias("pairs"), (pairs - F.col("inside")).cast("long").alias("across_assets"))


#: RAW and rendered files of one folder and stem that are paired as one block; files of the catalog a task of pairs.
RAWS, RENDERED, PAIR_TASK = 64, 256, 60_000


def blocks(files, n, size, name):
    """Files as ``name``, an array of at most ``size`` of one folder and stem, dealt out over ``n`` tasks by these."""
    place = F.row_number().over(Window.partitionBy("folder", "stem").orderBy("file_id")) - 1
    numbered = files.repartition(n, "folder", "stem").withColumn("block", F.floor(place / size))
    return numbered.groupBy("folder", "stem", "block").agg(F.collect_list(F.struct("file_id", "asset_id")).alias(name)).drop("block")


@query("jn_13_same_stem", "WITH s AS (SELECT file_id, asset_id, folder, extension, lower(substr(filename, 1, length(filename) - length(extension))) AS stem FROM file) SELECT r.file_id AS raw_id, j.file_id AS rendered_id FROM s r JOIN s j ON r.folder = j.folder AND r.stem = j.stem WHERE r.extension IN ('.cr3', '.dng') AND j.extension IN ('.jpg', '.png') AND r.asset_id <> j.asset_id")
def jn_13(spark, d):
    """Every pair of a RAW and a rendered file, block by block.

    The pairs grow with the square of the files.  In a block the same few rendered
    files come again for each RAW file, and a task holds the files of few stems, so
    that a table of the pairs takes a small part of a byte for each.
    """
    f = settled(load(spark, d, "file"), "file_id", "asset_id", "folder", "extension", F.lower(M.stem(F.col("relative_path"))).alias("stem"))
    n = load(spark, d, "lineitem").count() // PAIR_TASK + 1  # from the footers
    raw = blocks(f.filter("extension in ('.cr3', '.dng')"), n, RAWS, "raws")
    ren = blocks(f.filter("extension in ('.jpg', '.png')"), n, RENDERED, "rendered")
    # a join hands on what one row meets at once: with as many partitions as before, blocks are spelled out one by one
    met = raw.hint("merge").join(ren, ["folder", "stem"]).select("raws", "rendered").coalesce(n)
    pairs = met.select(F.explode("raws").alias("r"), "rendered").select("r", F.explode("rendered").alias("j"))
    return pairs.filter("r.asset_id <> j.asset_id").select(F.col("r.file_id").alias("raw_id"), F.col("j.file_id").alias("rendered_id"))


@query("jn_15_dependencies", "WITH op AS (SELECT file_id, role, is_online AS ok, size_bytes % 10 AS rule FROM file) SELECT c.file_id, c.rule, coalesce(p.ok, FALSE) AS ready FROM op c LEFT JOIN op p ON p.file_id = c.file_id AND p.rule = c.rule AND p.role = 'original' WHERE c.role IN ('original', 'managed_jxl')")
def jn_15(spark, d):
    op = load(spark, d, "file").select("file_id", "role", F.col("is_online").alias("ok"), (F.col("size_bytes") % 10).alias("rule"))
    parent = op.filter("role = 'original'").select("file_id", "rule", F.col("ok").alias("p"))
    return op.filter("role in ('original', 'managed_jxl')").join(parent, ["file_id", "rule"], "left").select("file_id", "rule", F.coalesce("p", F.lit(False)).alias("ready"))


@query("jn_16_provenance", "WITH p AS (SELECT file_id AS p_id, upper(relative_path) AS path, sha256, mtime AS stamp FROM file WHERE role = 'managed_jxl') SELECT file_id, p_id FROM (SELECT f.file_id, p.p_id, row_number() OVER (PARTITION BY f.file_id ORDER BY p.stamp DESC, p.p_id DESC) AS k FROM file f JOIN p ON lower(f.relative_path) = lower(p.path) AND f.sha256 = p.sha256) WHERE k = 1")
def jn_16(spark, d):
    """Without case on the path, the latest claim wins."""
    f = load(spark, d, "file")
    p = f.filter("role = 'managed_jxl'").select(F.lower(F.upper("relative_path")).alias("lp"), "sha256", F.col("mtime").alias("stamp"), F.col("file_id").alias("p_id"))
    best = p.groupBy("lp", "sha256").agg(F.max(F.struct("stamp", "p_id")).alias("m"))
    return f.withColumn("lp", F.lower("relative_path")).join(best, ["lp", "sha256"]).select("file_id", F.col("m.p_id").alias("p_id"))


@query("jn_17_id_filter", "SELECT file_id, relative_path FROM file WHERE file_id IN (SELECT vec_id FROM embeddings)")
def jn_17(spark, d):
    return load(spark, d, "file").join(load(spark, d, "embeddings").select(F.col("vec_id").alias("file_id")), "file_id", "left_semi").select("file_id", "relative_path")


@query("jn_18_flt_18_drift", "WITH now AS (SELECT file_id, size_bytes, CASE WHEN file_id % 97 = 0 THEN NULL ELSE sha256 END AS sha FROM file WHERE file_id % 89 <> 0), plan AS (SELECT file_id, size_bytes + CASE WHEN file_id % 61 = 0 THEN 1 ELSE 0 END AS size_bytes, sha256 AS sha FROM file) SELECT p.file_id, CASE WHEN n.file_id IS NULL THEN 'gone' WHEN n.size_bytes IS DISTINCT FROM p.size_bytes THEN 'size' ELSE 'sha' END AS drift FROM plan p LEFT JOIN now n ON p.file_id = n.file_id WHERE n.file_id IS NULL OR n.size_bytes IS DISTINCT FROM p.size_bytes OR n.sha IS DISTINCT FROM p.sha")
def jn_18(spark, d):
    f = load(spark, d, "file")
    now = f.filter("file_id % 89 <> 0").select(F.col("file_id").alias("n"), F.col("size_bytes").alias("ns"), F.when(F.col("file_id") % 97 != 0, F.col("sha256")).alias("nsha"))
    plan = f.select("file_id", (F.col("size_bytes") + F.when(F.col("file_id") % 61 == 0, 1).otherwise(0)).alias("s"), F.col("sha256").alias("sha"))
    j = plan.join(now, F.col("file_id") == F.col("n"), "left")
    same = F.col("ns").eqNullSafe(F.col("s")) & F.col("nsha").eqNullSafe(F.col("sha"))
    return j.filter(F.col("n").isNull() | ~same).select("file_id", F.when(F.col("n").isNull(), "gone").when(~F.col("ns").eqNullSafe(F.col("s")), "size").otherwise("sha").alias("drift"))


@query("jn_19_ordered_samples", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id", views=False)
def jn_19(spark, d):
    g = load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", "turns", F.array_join(F.transform("x", lambda y: y["role"]), ">").alias("roles"))




@query("jn_20_presets", "SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS rules FROM region JOIN nation ON r_regionkey = n_regionkey WHERE length(n_name) < 10 GROUP BY r_name", views=False)
def jn_20(spark, d):
    """Presets with the enabled rules of their ruleset in order: regions stand for presets, nations for rules, those with short names are enabled."""
    p = load(spark, d, "region").select(F.col("r_regionkey").alias("ruleset"), F.col("r_name").alias("name"))
    r = load(spark, d, "nation").select(F.col("n_regionkey").alias("ruleset"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("op"), (F.length("n_name") < 10).alias("enabled"))
    rules = r.filter("enabled").groupBy("ruleset").agg(F.array_sort(F.collect_list(F.struct("position", "op"))).alias("x"))
    return p.join(rules, "ruleset").select("name", F.array_join(F.transform("x", lambda y: y["op"]), ",").alias("rules"))


@query("srt_10_latest_jobs", "SELECT job_id, kind, status FROM job ORDER BY stamp DESC, job_id DESC LIMIT 100")
def srt_10(spark, d):
    return load(spark, d, "job").orderBy(F.desc("stamp"), F.desc("job_id")).limit(100).select("job_id", "kind", "status")


#: Job kinds for the kinds of events.
KINDS = {"view": "media_index", "click": "media_thumbnails", "purchase": "media_quality", "signup": "embeddings"}
STANDS = """(CASE kind WHEN 'view' THEN coalesce(metadata AND thumbnail, FALSE) WHEN 'click' THEN coalesce(thumbnail, FALSE) WHEN 'purchase' THEN coalesce(quality, FALSE) WHEN 'signup' THEN coalesce(embedding, FALSE) ELSE FALSE END)"""
RESOLVED_SQL = """known AS (SELECT file_id, bool_and(status IN ('complete', 'not_requested')) FILTER (component = 'metadata') AS metadata, bool_and(status IN ('complete', 'not_requested')) FILTER (component = 'thumbnail') AS thumbnail,
 bool_and(status IN ('complete', 'not_requested')) FILTER (component = 'quality') AS quality, bool_and(status IN ('complete', 'not_requested')) FILTER (component LIKE 'embedding:%') AS embedding FROM component_state GROUP BY file_id)"""


def errors_of(spark, d):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return load(spark, d, "job").filter("status = 'failed'").select("job_id", "file_id", F.coalesce(kind[F.col("kind")], F.lit("other")).alias("kind"), "stamp")


@query("flt_15_unresolved_errors", f"WITH {RESOLVED_SQL} SELECT job_id, j.file_id, kind AS event FROM job j LEFT JOIN known k ON j.file_id = k.file_id WHERE status = 'failed' AND NOT {STANDS}")
def flt_15(spark, d):
    """All errors that still stand, by the records of the components that their jobs leave behind."""
    e = S.unresolved_errors(errors_of(spark, d), load(spark, d, "component_state"))
    back = F.create_map(*[F.lit(x) for a, b in KINDS.items() for x in (b, a)])
    return e.select("job_id", "file_id", F.coalesce(back[F.col("kind")], F.lit("error")).alias("event"))


@query("srt_10_flt_15_set_5_problems", f"""WITH {RESOLVED_SQL}, last AS (SELECT job_id, file_id, kind, stamp FROM job WHERE status = 'failed' ORDER BY stamp DESC, job_id DESC LIMIT 500),
 e AS (SELECT 'error' AS kind, job_id AS id, CAST(stamp AS TIMESTAMP) AS stamp FROM last LEFT JOIN known k ON last.file_id = k.file_id WHERE NOT {STANDS}),
 c AS (SELECT 'conflict' AS kind, job_id AS id, CAST(stamp AS TIMESTAMP) AS stamp FROM job WHERE status = 'running' AND job_id % 100 = 1) SELECT kind, id FROM (SELECT * FROM e UNION ALL SELECT * FROM c) ORDER BY stamp DESC, kind, id LIMIT 100""")
def problems(spark, d):
    """The limit on errors comes before the filter of resolved ones, as documented."""
    last = errors_of(spark, d).orderBy(F.desc("stamp"), F.desc("job_id")).limit(500)
    e = S.unresolved_errors(last, load(spark, d, "component_state")).select(F.lit("error").alias("kind"), F.col("job_id").alias("id"), "stamp")
    c = load(spark, d, "job").filter("status = 'running' and job_id % 100 = 1").select(F.lit("conflict").alias("kind"), F.col("job_id").alias("id"), "stamp")
    return e.unionByName(c).orderBy(F.desc("stamp"), "kind", "id").limit(100).select("kind", "id")


@query("flt_16_unresolved_conflicts", "WITH c AS (SELECT asset_id AS a, (asset_id * 5 + 1) % 50021 AS b, asset_id % 2 = 0 AS decision FROM asset) SELECT c.a, c.b FROM c JOIN asset x ON c.a = x.asset_id JOIN asset y ON c.b = y.asset_id WHERE c.a <> c.b AND (NOT c.decision OR (x.selection_state = 'selected' AND y.selection_state = 'rejected') OR (x.selection_state = 'rejected' AND y.selection_state = 'selected'))")
def flt_16(spark, d):
    a = load(spark, d, "asset").select("asset_id", "selection_state")
    c = a.select(F.col("asset_id").alias("a"), F.col("selection_state").alias("x"), ((F.col("asset_id") * 5 + 1) % 50021).alias("b"), (F.col("asset_id") % 2 == 0).alias("decision"))
    y = a.select(F.col("asset_id").alias("b"), F.col("selection_state").alias("y"))
    opposed = F.array_sort(F.array("x", "y")) == F.array(F.lit("rejected"), F.lit("selected"))
    return c.join(y, "b").filter((F.col("a") != F.col("b")) & (~F.col("decision") | opposed)).select("a", "b")


#: Versions of the components, and the scorer.
VERSIONS = {"metadata": "m2", "thumbnail": "t2", "quality": "q2"}
SCORER = "CASE WHEN size_bytes % 50 = 0 THEN 'other' ELSE 'scorer' END"


def work(spark, d, scoring=True):
    files = load(spark, d, "file").withColumns({"quality_algorithm": F.expr(SCORER), "quality_version": F.lit("q2")})
    return S.pending_work(files.filter("in_scope and is_online"), load(spark, d, "file_state"), VERSIONS, "scorer", scoring)


_COMMON = "CASE WHEN s.status <> 'complete' THEN 'status' WHEN s.input_fingerprint <> f.sha256 THEN 'input'"


@query("flt_17_str_1_pending_work", f"""WITH c AS (SELECT * FROM (VALUES ('metadata', 'm2'), ('thumbnail', 't2'), ('quality', 'q2')) AS v(component, wanted)),
 p AS (SELECT f.file_id, c.component, CASE WHEN s.file_id IS NULL THEN 'missing' WHEN s.version <> c.wanted THEN 'version' WHEN s.status = 'unsupported' AND NOT (f.extension = '.jxl' AND c.component IN ('metadata', 'thumbnail')) THEN NULL
   WHEN c.component = 'metadata' THEN {_COMMON} END WHEN c.component = 'thumbnail' THEN {_COMMON} WHEN s.output_path = '' OR s.output_fingerprint IS NULL THEN 'output' END
   WHEN f.media_type = 'video' THEN CASE WHEN s.status <> 'not_requested' THEN 'status' END ELSE {_COMMON} WHEN quality_score IS NULL OR {SCORER} <> 'scorer' THEN 'value' END END AS why
  FROM file f JOIN c ON TRUE LEFT JOIN file_state s ON s.file_id = f.file_id AND s.component = c.component WHERE f.in_scope AND f.is_online)
 SELECT file_id, component, why FROM p WHERE why IS NOT NULL""")
def flt_17(spark, d):
    """Every component of every file in scope that is to be derived, and why."""
    return work(spark, d).select("file_id", F.explode("pending").alias("component", "why"))


@query("set_1_union_of_sets", "SELECT asset_id FROM asset WHERE asset_id % 4 = 0 UNION SELECT asset_id FROM file WHERE media_type = 'video' AND is_online")
def set_1(spark, d):
    return load(spark, d, "asset").filter("asset_id % 4 = 0").select("asset_id").union(load(spark, d, "file").filter("media_type = 'video' and is_online").select("asset_id")).distinct()


@query("set_2_difference", "SELECT relative_path FROM file WHERE in_scope EXCEPT SELECT relative_path FROM file WHERE is_online")
def set_2(spark, d):
    f = load(spark, d, "file")
    return f.filter("in_scope").select("relative_path").subtract(f.filter("is_online").select("relative_path"))


@query("set_3_intersection", "SELECT asset_id FROM asset WHERE selection_state = 'selected' INTERSECT SELECT asset_id FROM file WHERE in_scope")
def set_3(spark, d):
    return load(spark, d, "asset").filter("selection_state = 'selected'").select("asset_id").intersect(load(spark, d, "file").filter("in_scope").select("asset_id"))


@query("set_4_union_all", "SELECT vec_id AS id, 'image' AS kind, NULL AS sample FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 'frame', CAST(vec_id % 7 AS INT) FROM embeddings WHERE vec_id % 2 = 1", views=False)
def set_4(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    image = e.filter("id % 2 = 0").withColumn("kind", F.lit("image"))
    frame = e.filter("id % 2 = 1").withColumn("kind", F.lit("frame")).withColumn("sample", (F.col("id") % 7).cast("int"))
    return image.unionByName(frame, allowMissingColumns=True)


@query("set_6_label_sets", "SELECT asset_id, string_agg(DISTINCT role, ',' ORDER BY role) AS labels FROM file GROUP BY asset_id")
def set_6(spark, d):
    return load(spark, d, "file").groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("labels"))


@query("win_3_first_per_key", "SELECT file_id, job_id FROM (SELECT file_id, job_id, row_number() OVER (PARTITION BY file_id ORDER BY seconds DESC, job_id) AS k FROM job) WHERE k = 1")
def win_3(spark, d):
    w = Window.partitionBy("file_id").orderBy(F.desc("seconds"), "job_id")
    return load(spark, d, "job").withColumn("k", F.row_number().over(w)).filter("k = 1").select("file_id", "job_id")


#: Entries and bytes that a cache of the jobs' outputs may hold.
CACHE_COUNT, CACHE_BYTES = 320, 5_000_000


@query("win_9_lru_eviction", f"""WITH r AS (SELECT job_id, CAST(floor(seconds * 1000) AS BIGINT) AS bytes, status = 'running' AS active, stamp FROM job), t AS (SELECT count(*) AS n, sum(bytes) AS total FROM r),
 k AS (SELECT *, row_number() OVER w - 1 AS gone, coalesce(sum(bytes) OVER (ORDER BY stamp, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM r WHERE NOT active WINDOW w AS (ORDER BY stamp, job_id))
 SELECT job_id FROM r WHERE active UNION ALL SELECT job_id FROM k, t WHERE t.n - gone <= {CACHE_COUNT} AND t.total - freed <= {CACHE_BYTES}""")
def win_9(spark, d):
    """Kept entries.  Active ones count and stay; others go, oldest first, until count and bytes are within the limits.

    Seen from the newest: an idle entry stays if what is newer, the entry itself
    and all active ones fit.  At most ``CACHE_COUNT`` idle ones can stay, so only
    those are ordered in one task.
    """
    r = load(spark, d, "job").select("job_id", F.floor(F.col("seconds") * 1000).cast("long").alias("bytes"), (F.col("status") == "running").alias("active"), "stamp")
    active = r.filter("active")
    held = active.agg(F.count("*").alias("held"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("held_bytes"))
    top = r.filter("not active").orderBy(F.desc("stamp"), F.desc("job_id")).limit(CACHE_COUNT)
    w = Window.orderBy(F.desc("stamp"), F.desc("job_id")).rowsBetween(Window.unboundedPreceding, 0)
    run = top.select("job_id", F.count("*").over(w).alias("n"), F.sum("bytes").over(w).alias("total")).join(F.broadcast(held))
    kept = run.filter((F.col("n") + F.col("held") <= CACHE_COUNT) & (F.col("total") + F.col("held_bytes") <= CACHE_BYTES))
    return active.select("job_id").unionByName(kept.select("job_id"))