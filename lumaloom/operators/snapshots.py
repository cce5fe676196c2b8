"""Incremental snapshots: diff, moves, missing files, upserts and publishing."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """old/new(path, size, mtime, sha, online) -> path, outcome, moved_from.

    unchanged: same path, online, same size and time.  changed: same path
    otherwise.  moved: a new path whose content belongs to exactly one missing
    path, and to no path that is still there.  added: other new paths.  missing:
    old paths that are gone, except under ``blocked`` (unreadable) prefixes, which
    are kept as ``blocked``.
    """
    o = old.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("sha").alias("o_sha"), F.col("online").alias("o_online"), F.lit(True).alias("was"))
    n = new.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.col("sha").alias("n_sha"), F.lit(True).alias("now"))
    j = o.join(n, "path", "full")
    under = F.lit(False)
    for b in blocked or []:
        under = under | (F.col("path") == b) | F.col("path").startswith(b.rstrip("/") + "/") | F.lit(b == "")
    same = F.col("o_online") & (F.col("o_size") == F.col("n_size")) & F.col("o_mtime").eqNullSafe(F.col("n_mtime"))
    state = F.when(F.col("now").isNull(), F.when(under, "blocked").otherwise("missing")).when(F.col("was").isNull(), "added").when(same, "unchanged").otherwise("changed")
    j = j.withColumn("outcome", state)
    # one aggregate by content says what was lost, what is still there and what is new
    role = F.when(F.col("outcome") == "missing", "lost").when(F.col("outcome") == "added", "found").when(F.col("now") & F.col("was"), "present")
    by_sha = j.select(F.when(role == "found", F.col("n_sha")).otherwise(F.col("o_sha")).alias("sha"), role.alias("role"), "path").filter("sha is not null and role is not null")
    at = lambda r: F.min(F.when(F.col("role") == r, F.col("path")))
    moves = by_sha.groupBy("sha").agg(F.count_if(F.col("role") == "lost").alias("n"), F.bool_or(F.col("role") == "present").alias("kept"), at("lost").alias("moved_from"), at("found").alias("path"))
    moves = moves.filter("n = 1 and not kept and path is not null")
    ends = moves.select(F.explode(F.array(F.struct("path", "moved_from", F.lit(None).cast("boolean").alias("left")), F.struct(F.col("moved_from").alias("path"), F.lit(None).cast("string").alias("moved_from"), F.lit(True).alias("left")))).alias("x")).select("x.*")
    out = j.select("path", "outcome").join(ends, "path", "left")
    return out.filter("left is null").select("path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("outcome")).alias("outcome"), "moved_from")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New rows replace old ones by key; the columns in ``keep`` stay as they were."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    j = old.join(n, old[key] == n[f"n_{key}"], "full")
    hit = F.col(f"n_{key}").isNotNull()
    return j.select(*[(F.coalesce(old[c], F.col(f"n_{c}")) if c in keep or c == key else F.when(hit, F.col(f"n_{c}")).otherwise(old[c])).alias(c) for c in old.columns])


def export_names(selected: DataFrame) -> DataFrame:
    """asset_id, filename -> archive names that are unique without case: the first keeps its name, others add the id."""
    from pyspark.sql import Window

    from ..functions import media as M

    w = Window.partitionBy(F.lower("filename")).orderBy("asset_id")
    own = F.concat(M.stem(F.col("filename")), F.lit("__"), F.col("asset_id").cast("string"), F.regexp_extract("filename", r".(\.[^.]*)$", 1))
    return selected.withColumn("k", F.row_number().over(w)).select("asset_id", F.when(F.col("k") == 1, F.col("filename")).otherwise(own).alias("archive_name"))


def purge(files: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without the offline ones, and assets that still have a file."""
    left = files.filter("is_online")
    return left, assets.join(left.select("asset_id"), "asset_id", "left_semi")


def fingerprint(rows: DataFrame, key: str, columns: list[str], block: int = 10_000) -> DataFrame:
    """n, fingerprint: sha256 over a table in the order of its integer key, as a tree.

    Rows are digested each, then by blocks of ``block`` keys, then the blocks, so
    no step holds more than a block's digests and the last one a digest a block.
    """
    chain = lambda at, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, h))), lambda x: x[h]), ""), 256)
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    blocks = rows.select(F.col(key).alias("at"), F.floor(F.col(key) / block).alias("block"), row.alias("h")).groupBy("block").agg(F.count("*").alias("n"), chain("at", "h").alias("h"))
    return blocks.agg(F.sum("n").cast("long").alias("n"), chain("block", "h").alias("fingerprint"))


def publish(df: DataFrame, base: str, table: str, run_id: str | None = None) -> str:
    """Write a run, then add it to the pointer's log: a failure at any step leaves the previous run active."""
    run_id = run_id or uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{base}/{table}/run_id={run_id}")
    pointer = df.sparkSession.createDataFrame([(run_id, time.time_ns())], "run_id string, published long")
    pointer.coalesce(1).write.mode("append").json(f"{base}/{table}_active")
    return run_id


def active(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The active run of a table; None if none was published."""
    try:
        run_id = spark.read.schema("run_id string, published long").json(f"{base}/{table}_active").orderBy(F.desc("published"), F.desc("run_id")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(f"{base}/{table}/run_id={run_id['run_id']}") if run_id else None
