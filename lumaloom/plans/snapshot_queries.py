"""Snapshots, sinks and incremental work (SRC-1..7, SNK-1..6, STR-1..9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import snapshots as N
from .browse_queries import PREF
from .catalog import load
from .registry import query

OLD = "o AS (SELECT CASE WHEN file_id % 41 = 0 THEN 'old/' || file_id ELSE CAST(file_id AS STRING) END AS path, size_bytes AS size, CASE WHEN file_id % 29 = 0 THEN 1 ELSE 0 END AS mtime, md5(CAST(file_id AS STRING)) AS sha, is_online AS online FROM file WHERE file_id % 7 <> 0)"
NEW = "n AS (SELECT CAST(file_id AS STRING) AS path, size_bytes AS size, 0 AS mtime, md5(CAST(file_id AS STRING)) AS sha FROM file WHERE file_id % 5 <> 0)"


def listings(spark, d):
    f = load(spark, d, "file")
    i = F.col("file_id")
    old = f.filter("file_id % 7 <> 0").select(F.when(i % 41 == 0, F.concat(F.lit("old/"), i.cast("string"))).otherwise(i.cast("string")).alias("path"), F.col("size_bytes").alias("size"), F.when(i % 29 == 0, 1).otherwise(0).alias("mtime"), F.md5(i.cast("string")).alias("sha"), F.col("is_online").alias("online"))
    new = f.filter("file_id % 5 <> 0").select(i.cast("string").alias("path"), F.col("size_bytes").alias("size"), F.lit(0).alias("mtime"), F.md5(i.cast("string")).alias("sha"))
    return old, new


@query("src_1_folder_scan")
def src_1(spark, d):
    """The folder of the tables as a tree; compared with a walk in the tests.  Remote folders go through ``binaryFile``."""
    from ..sources import listing

    if "://" in d and not d.startswith("file://"):
        return listing.discover(spark, d, [".parquet"]).select("path", "size")
    return listing.scan_tree(spark, d, extensions=".parquet").select("path", "size")


@query("src_2_4_5_snapshot_diff", f"""WITH {OLD}, {NEW}, j AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'missing' WHEN o.path IS NULL THEN 'added' WHEN o.online AND o.size = n.size AND o.mtime = n.mtime THEN 'unchanged' ELSE 'changed' END AS outcome, o.sha AS osha, n.sha AS nsha FROM o FULL JOIN n ON o.path = n.path),
 mv AS (SELECT a.path, m.path AS moved_from FROM j a JOIN j m ON a.nsha = m.osha WHERE a.outcome = 'added' AND m.outcome = 'missing')
 SELECT j.path, CASE WHEN mv.path IS NOT NULL THEN 'moved' ELSE j.outcome END AS outcome, mv.moved_from FROM j LEFT JOIN mv ON j.path = mv.path WHERE j.path NOT IN (SELECT moved_from FROM mv) /* FROM file */""")
def src_2(spark, d):
    return N.diff(*listings(spark, d))


@query("src_3_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents", views=False)
def src_3(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("src_5_blocked_prefix", f"WITH {OLD}, {NEW} SELECT CASE WHEN starts_with(o.path, 'old/') THEN 'blocked' ELSE 'missing' END AS outcome, count(*) AS n FROM o WHERE o.path NOT IN (SELECT path FROM n) AND (starts_with(o.path, 'old/') OR TRUE) GROUP BY 1 /* FROM file */")
def src_5(spark, d):
    old, new = listings(spark, d)
    return N.diff(old, new, ["old"]).filter("outcome in ('missing', 'blocked')").groupBy("outcome").agg(F.count("*").alias("n"))


@query("src_6_invalidation", "SELECT file_id, CASE WHEN file_id % 29 = 0 THEN 'pending' ELSE component_status END AS status, CASE WHEN file_id % 29 = 0 THEN NULL ELSE quality_score END AS quality FROM file")
def src_6(spark, d):
    f = load(spark, d, "file")
    changed = f.filter("file_id % 29 = 0").select("file_id", F.lit(True).alias("c"))
    j = f.join(changed, "file_id", "left")
    return j.select("file_id", F.when(F.col("c"), "pending").otherwise(F.col("component_status")).alias("status"), F.when(F.col("c").isNull(), F.col("quality_score")).alias("quality"))


@query("src_7_ordered_scan", "SELECT file_id, relative_path FROM file WHERE in_scope ORDER BY relative_path, file_id LIMIT 1000")
def src_7(spark, d):
    return load(spark, d, "file").filter("in_scope").orderBy("relative_path", "file_id").limit(1000).select("file_id", "relative_path")


@query("snk_1_json_rows", "SELECT job_id, '{\"kind\":\"' || kind || '\",\"status\":\"' || status || '\"}' AS json FROM job")
def snk_1(spark, d):
    return load(spark, d, "job").select("job_id", F.to_json(F.struct("kind", "status")).alias("json"))


@query("snk_2_upsert", "WITH o AS (SELECT file_id, quality_score AS q, 'old' AS made FROM file WHERE file_id % 2 = 0), n AS (SELECT file_id, 1.0 AS q, 'new' AS made FROM file WHERE file_id % 3 = 0) SELECT coalesce(o.file_id, n.file_id) AS file_id, CASE WHEN n.file_id IS NOT NULL THEN n.q ELSE o.q END AS q, coalesce(o.made, n.made) AS made FROM o FULL JOIN n ON o.file_id = n.file_id")
def snk_2(spark, d):
    f = load(spark, d, "file")
    old = f.filter("file_id % 2 = 0").select("file_id", F.col("quality_score").alias("q"), F.lit("old").alias("made"))
    new = f.filter("file_id % 3 = 0").select("file_id", F.lit(1.0).alias("q"), F.lit("new").alias("made"))
    return N.upsert(old, new, "file_id", ["made"])


@query("snk_4_export_names", f"WITH p AS (SELECT asset_id, filename FROM (SELECT f.asset_id, f.filename, row_number() OVER (PARTITION BY f.asset_id ORDER BY {PREF}) AS k FROM file f JOIN asset a ON f.asset_id = a.asset_id WHERE a.selection_state = 'selected' AND in_scope AND is_online) WHERE k = 1) SELECT asset_id, CASE WHEN row_number() OVER (PARTITION BY lower(filename) ORDER BY asset_id) = 1 THEN filename ELSE regexp_extract(filename, '^(.*)\\.[^.]*$', 1) || '__' || asset_id || regexp_extract(filename, '(\\.[^.]*)$', 1) END AS archive_name FROM p")
def snk_4(spark, d):
    from ..operators.browse import preferred_file

    f = load(spark, d, "file").filter("in_scope and is_online")
    chosen = load(spark, d, "asset").filter("selection_state = 'selected'").select("asset_id")
    return N.export_names(preferred_file(f.join(chosen, "asset_id", "left_semi")).select("asset_id", "filename"))


@query("snk_6_purge", "SELECT (SELECT count(*) FROM file WHERE is_online) AS files, (SELECT count(*) FROM asset a WHERE EXISTS (SELECT 1 FROM file f WHERE f.asset_id = a.asset_id AND f.is_online)) AS assets")
def snk_6(spark, d):
    files, assets = N.purge(load(spark, d, "file"), load(spark, d, "asset"))
    return files.agg(F.count("*").alias("files")).crossJoin(assets.agg(F.count("*").alias("assets")))  # one row each


@query("str_2_streaming_bursts", None)
def str_2(spark, d):
    """The session-window stream's logic on the batch table; the streaming run itself is in the tests."""
    from ..streaming.incremental import bursts

    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return bursts(e, "ts", ["user_id"], "2 hours")


@query("str_8_error_rows", "SELECT job_id, CASE WHEN job_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS value, CASE WHEN job_id % 11 = 0 THEN 'not a number' END AS error FROM job")
def str_8(spark, d):
    """A failing item becomes a row with its error; the others go on."""
    raw = F.when(F.col("job_id") % 11 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    v = raw.try_cast("int")
    return load(spark, d, "job").select("job_id", v.alias("value"), F.when(v.isNull(), "not a number").alias("error"))


SCANS = """s AS (SELECT file_id, CASE WHEN width = 0 THEN 'unsupported' WHEN component_status = 'failed' THEN 'failed' ELSE 'complete' END AS status, sha256 AS one, CASE WHEN size_bytes % 3 = 0 THEN md5(sha256) ELSE sha256 END AS two FROM file WHERE in_scope AND is_online),
 c AS (SELECT s.*, 'features' AS component, 'v1' AS v_one, 'v1' AS v_two FROM s UNION ALL SELECT s.*, 'metadata', 'v1', 'v2' FROM s)"""


@query("str_1_4_versioned_derivation", f"""WITH {SCANS} SELECT file_id, component, 1 AS scan, v_one AS version, 'missing' AS why, status, CASE WHEN status = 'complete' THEN component || ':' || one END AS value FROM c
 UNION ALL SELECT file_id, component, 2, v_two, CASE WHEN v_one <> v_two THEN 'version' WHEN status = 'failed' THEN 'failed' ELSE 'input' END, status, CASE WHEN status = 'complete' THEN component || ':' || two END FROM c WHERE v_one <> v_two OR status = 'failed' OR (status = 'complete' AND one <> two) /* FROM file */""")
def str_1(spark, d):
    """Two scans of the library by one stream: it stops after the first, files change, and one component has a new version when it goes on."""
    import uuid

    from ..operators.scratch import shared_dir
    from ..streaming.incremental import derive_versioned_batches

    f = load(spark, d, "file").filter("in_scope and is_online")
    changed = F.when(F.col("size_bytes") % 3 == 0, F.md5("sha256")).otherwise(F.col("sha256"))
    base = f"{shared_dir(spark)}/versioned-{uuid.uuid4().hex}"
    state = F.when(F.col("width") == 0, "unsupported").when(F.col("component_status") == "failed", "failed").otherwise("complete")

    def derive(component, rows):
        done = rows["state"] == "complete"
        return rows.assign(status=rows["state"], value=(component + ":" + rows["fingerprint"]).where(done, None))[["status", "value"]]

    for scan, fingerprint, versions in ((1, F.col("sha256"), {"features": "v1", "metadata": "v1"}), (2, changed, {"features": "v1", "metadata": "v2"})):
        f.select("file_id", F.lit(scan).cast("long").alias("scan"), fingerprint.alias("fingerprint"), state.alias("state")).write.mode("append").parquet(f"{base}/listings")
        listings = spark.readStream.schema("file_id long, scan long, fingerprint string, state string").parquet(f"{base}/listings")
        derive_versioned_batches(listings, versions, derive, f"{base}/derived", f"{base}/state", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/derived").select("file_id", "component", "scan", "version", "why", "status", "value")


@query("str_9_one_pass_two_tables", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v)
 SELECT 'embedding' AS part, vec_id, round(norm, 6) AS a, round(e[1] / norm, 6) AS b FROM m WHERE norm > 0 UNION ALL SELECT 'quality', vec_id, round(list_avg(e), 6), round(list_var_pop(e), 6) FROM m""", views=False)
def str_9(spark, d):
    """Vectors are decoded once for two tables: one for search, one with statistics."""
    import uuid

    from ..operators.scratch import shared_dir
    from ..streaming.incremental import fan_out

    def decode(batch):
        return np.array(batch["embedding"].tolist(), dtype=np.float64).reshape(len(batch), -1)

    def search(batch, m):
        norm = np.sqrt((m * m).sum(1))
        keep = norm > 0
        return pd.DataFrame({"vec_id": batch["vec_id"][keep], "norm": norm[keep], "first": m[keep, 0] / norm[keep]})

    def quality(batch, m):
        return pd.DataFrame({"vec_id": batch["vec_id"], "mean": m.mean(1), "spread": m.var(1)})

    consumers = {"embedding": (search, "vec_id long, norm double, first double"), "quality": (quality, "vec_id long, mean double, spread double")}
    out = fan_out(load(spark, d, "embeddings").select("vec_id", "embedding"), decode, consumers, f"{shared_dir(spark)}/one-pass-{uuid.uuid4().hex}")
    r = lambda c: F.round(c, 6)
    return out["embedding"].select(F.lit("embedding").alias("part"), "vec_id", r("norm").alias("a"), r("first").alias("b")).unionByName(out["quality"].select(F.lit("quality").alias("part"), "vec_id", r("mean").alias("a"), r("spread").alias("b")))
