"""A media catalog over the star-schema test tables.

Orders stand for assets, line items for their files (one file per order and line
number), events for the job log, pages for folders, embeddings for vectors.  Each
view is a list of expressions that Spark and DuckDB read alike, so that the same
mapping feeds both sides of a comparison.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

S = "CAST({} AS STRING)".format

#: Files of some days have a record of how they were made.
MADE = "CAST(substr(CAST(mtime AS STRING), 9, 2) AS INT) {}".format

DAY = MADE("").strip()


def _state(component: str, version: str, status: str, old: int, path: str, mark: str, missing: int) -> tuple:
    """Records of one component: its version and status, an old input on one day of the month, none on another."""
    return (
        "file",
        None,
        [
            ("file_id", "file_id"),
            ("component", f"'{component}'"),
            ("version", version),
            ("status", status),
            ("input_fingerprint", f"CASE WHEN {DAY} = {old} THEN md5(sha256) ELSE sha256 END"),
            ("output_path", path),
            ("output_fingerprint", mark),
        ],
        f"{DAY} <> {missing}",
    )


#: view -> (source, group keys or None, [(column, expression)][, condition on the source]), or a list of views that it unites
VIEWS: dict[str, tuple | list] = {
    "asset": (
        "orders",
        None,
        [
            ("asset_id", "o_orderkey"),
            ("media_type", "CASE WHEN o_orderkey % 5 = 0 THEN 'video' ELSE 'image' END"),
            ("capture_time", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) || 'T' || lpad(CAST(o_custkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':00' END"),
            ("capture_time_kind", "CASE WHEN o_orderkey % 3 = 0 THEN 'exif_offset' ELSE 'exif_local_unknown' END"),
            ("selection_state", "CASE o_orderstatus WHEN 'F' THEN 'selected' WHEN 'O' THEN 'undecided' ELSE 'rejected' END"),
            ("group_id", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END"),
            ("created_day", "o_orderdate"),
        ],
    ),
    "rawfile": (
        "lineitem",
        ["l_orderkey", "l_linenumber"],
        [
            ("file_id", "l_orderkey * 8 + l_linenumber"),
            ("asset_id", "l_orderkey"),
            ("sup", "max(l_suppkey)"),
            ("part", "max(l_partkey)"),
            ("qty", "max(l_quantity)"),
            ("price", "max(l_extendedprice)"),
            ("disc", "max(l_discount)"),
            ("tax", "max(l_tax)"),
            ("flag", "max(l_returnflag)"),
            ("st", "max(l_linestatus)"),
            ("ship", "max(l_shipdate)"),
        ],
    ),
    "namedfile": (
        "rawfile",
        None,
        [
            ("file_id", "file_id"),
            ("asset_id", "asset_id"),
            ("folder", "CASE WHEN sup % 11 = 0 THEN '' ELSE 'Year' || CAST(sup % 5 AS STRING) || CASE WHEN sup % 3 = 0 THEN '/Trip' || CAST(sup % 7 AS STRING) || CASE WHEN sup % 2 = 0 THEN '/Raw' ELSE '' END ELSE '' END END"),
            ("filename", "CASE WHEN part % 2 = 0 THEN 'IMG_' ELSE 'dsc_' END || CAST(part % 500 AS STRING) || CASE part % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.cr3' WHEN 3 THEN '.mp4' WHEN 4 THEN '.jxl' WHEN 5 THEN '.heic' WHEN 6 THEN '.png' ELSE '.dng' END"),
            ("role", "CASE part % 9 WHEN 0 THEN 'camera_jpeg' WHEN 1 THEN 'managed_jxl' WHEN 2 THEN 'derived_preview' ELSE 'original' END"),
            ("is_online", "st = 'O'"),
            ("in_scope", "sup % 10 <> 0"),
            ("quality_score", "CASE WHEN part % 6 = 0 THEN NULL ELSE disc * 10 END"),
            ("width", "CASE WHEN part % 17 = 0 THEN 0 ELSE CAST(floor(qty) AS INT) * 40 END"),
            ("height", "CASE WHEN part % 19 = 0 THEN 0 ELSE 400 + CAST(floor(tax * 100) AS INT) * 150 END"),
            ("size_bytes", "CAST(floor(price * 100) AS BIGINT)"),
            ("sha256", "md5(CAST(part % 1500 AS STRING))"),
            ("mtime", "ship"),
            ("duration", "CASE WHEN part % 8 = 3 THEN qty ELSE NULL END"),
            ("component_status", "CASE flag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'pending' ELSE 'failed' END"),
        ],
    ),
    "file": (
        "namedfile",
        None,
        [
            (c, c) for c in "file_id asset_id folder filename role is_online in_scope quality_score width height size_bytes sha256 mtime duration component_status".split()
        ]
        + [
            ("relative_path", "CASE WHEN folder = '' THEN filename ELSE folder || '/' || filename END"),
            ("extension", "lower(substr(filename, length(filename) - CASE WHEN filename LIKE '%.heic' THEN 4 ELSE 3 END))"),
            ("media_type", "CASE WHEN filename LIKE '%.mp4' THEN 'video' ELSE 'image' END"),
            ("is_raw", "filename LIKE '%.cr3' OR filename LIKE '%.dng'"),
        ],
    ),
    "managed_copy": (
        "file",
        None,
        [
            ("file_id", "file_id"),
            ("output_path", "CASE WHEN " + MADE("<= 3") + " THEN relative_path ELSE relative_path || '.old' END"),
            ("output_sha256", "sha256"),
        ],
        MADE("<= 6"),
    ),
    "managed_derivative": (
        "file",
        None,
        [
            ("file_id", "file_id"),
            ("output_path", "relative_path"),
            ("output_sha256", f"CASE WHEN {MADE('= 5')} THEN sha256 ELSE md5(sha256) END"),
        ],
        MADE("BETWEEN 5 AND 8"),
    ),
    "analysis": (
        "file",
        None,
        [
            ("file_id", "file_id"),
            ("codec", "CASE WHEN media_type = 'video' THEN 'av1' ELSE 'jpeg-xl' END"),
            ("contract", "'v1'"),
            ("runtime", "CASE WHEN CAST(substr(CAST(mtime AS STRING), 9, 2) AS INT) = 9 THEN 'r0' ELSE 'r1' END"),
            ("sha256", "CASE WHEN CAST(substr(CAST(mtime AS STRING), 9, 2) AS INT) = 10 THEN md5(sha256) ELSE sha256 END"),
            ("size_bytes", "size_bytes"),
            ("mtime", "mtime"),
            ("status", "CASE component_status WHEN 'complete' THEN 'success' WHEN 'pending' THEN CASE WHEN media_type = 'video' THEN 'preflight_required' WHEN size_bytes % 5 = 0 THEN 'timeout' ELSE 'success' END ELSE CASE WHEN size_bytes % 2 = 0 THEN 'transient_failure' ELSE 'success' END END"),
            ("error", "CASE WHEN width = 0 AND media_type = 'image' THEN 'unreadable' END"),
            ("mode", "CASE WHEN quality_score IS NULL THEN 'CMYK' WHEN extension = '.png' THEN 'RGBA' ELSE 'RGB' END"),
            ("note", "CASE WHEN height = 0 THEN 'animation' END"),
            ("width", "width"),
            ("height", "height"),
            ("duration", "duration"),
            ("fps", "CASE WHEN quality_score IS NULL THEN 0.0 ELSE 25.0 END"),
            ("bit_depth", "CASE WHEN size_bytes % 7 = 0 THEN 12 ELSE 8 END"),
        ],
    ),
    "metadata": (
        "file",
        None,
        [
            ("file_id", "file_id"),
            (
                "text",
                "CASE WHEN size_bytes % 23 = 0 THEN '{broken' ELSE '{\"exif\": {\"Make\": \"' || CASE size_bytes % 4 WHEN 0 THEN ' Lumen ' WHEN 1 THEN 'LUMEN' WHEN 2 THEN 'Orb' ELSE '' END || '\", \"Model\": \"' || CASE WHEN size_bytes % 4 = 3 THEN ' ' ELSE 'X1' END || '\"'"
                " || CASE WHEN size_bytes % 3 <> 0 THEN ', \"DateTimeOriginal\": \"2024:02:' || lpad(CAST(1 + size_bytes % 28 AS STRING), 2, '0') || ' 10:20:30\"' ELSE '' END || CASE WHEN size_bytes % 7 = 0 THEN ', \"SubSecTimeOriginal\": \"' || CAST(size_bytes % 1000 AS STRING) || '\"' ELSE '' END"
                " || CASE WHEN size_bytes % 5 = 0 THEN ', \"OffsetTimeOriginal\": \"+02:00\"' ELSE '' END || ', \"DateTime\": \"2023:12:31 23:59:59\", \"SubSecTime\": \"5\"}, \"gps\": {\"latitude\": ' || CAST(size_bytes % 200 - 100 AS STRING) || ', \"longitude\": ' || CAST(size_bytes % 300 - 150 AS STRING) || '}}' END",
            ),
        ],
        f"{DAY} <> 21",
    ),
    "state_metadata": _state("metadata", f"CASE WHEN {DAY} = 2 THEN 'm1' ELSE 'm2' END", f"CASE WHEN {DAY} IN (3, 4) THEN CASE WHEN size_bytes % 3 = 0 THEN 'unsupported' ELSE 'failed' END ELSE 'complete' END", 5, "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", 1),
    "state_thumbnail": _state(
        "thumbnail", f"CASE WHEN {DAY} = 6 THEN 't1' ELSE 't2' END", f"CASE WHEN {DAY} IN (7, 8) THEN CASE WHEN size_bytes % 3 = 0 THEN 'unsupported' ELSE 'failed' END WHEN {DAY} = 9 THEN 'pending' ELSE 'complete' END",
        10, f"CASE WHEN {DAY} = 11 THEN '' ELSE 'thumbs/' || sha256 || '.jpg' END", f"CASE WHEN {DAY} <> 12 THEN md5('t' || sha256) END", 13,
    ),
    "state_quality": _state(
        "quality", f"CASE WHEN {DAY} = 14 THEN 'q1' ELSE 'q2' END", "CASE WHEN (media_type = 'video' AND size_bytes % 4 <> 0) OR (quality_score IS NULL AND size_bytes % 2 = 0) THEN 'not_requested' ELSE 'complete' END",
        15, "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", 16,
    ),
    "file_state": ["state_metadata", "state_thumbnail", "state_quality"],
    "state_embedding": (
        "embeddings",
        None,
        [
            ("file_id", "vec_id"),
            ("component", "'embedding:image'"),
            ("version", "CASE WHEN vec_id % 9 = 0 THEN 'e0' ELSE 'e1' END"),
            ("status", "CASE WHEN vec_id % 10 = 3 THEN 'failed' ELSE 'complete' END"),
            ("input_fingerprint", "md5(CAST(vec_id - CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS STRING))"),
            ("output_path", "CAST(NULL AS STRING)"),
            ("output_fingerprint", "CAST(NULL AS STRING)"),
        ],
        "vec_id % 13 <> 5",
    ),
    "component_state": ["file_state", "state_embedding"],
    "vector": ("embeddings", None, [("vec_id", "vec_id"), ("file_id", "vec_id"), ("input_fingerprint", "md5(CAST(vec_id AS STRING))")]),
    "job": (
        "events",
        None,
        [
            ("job_id", "event_id"),
            ("file_id", "user_id"),
            ("kind", "event_type"),
            ("seconds", "value"),
            ("stamp", "ts"),
            ("status", "CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' ELSE 'complete' END"),
            ("props", "props"),
        ],
    ),
}


def with_views(sql: str) -> str:
    """``sql`` behind the definitions of the views that it names."""
    needed: list[str] = []

    def need(name: str) -> None:
        view = VIEWS[name]
        for source in view if isinstance(view, list) else view[:1]:
            if source in VIEWS:
                need(source)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.I):
            need(name)
    parts = []
    for name in needed:
        if isinstance(VIEWS[name], list):
            parts.append(f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {v}' for v in VIEWS[name])})")
            continue
        source, keys, columns, *where = VIEWS[name]
        select = ", ".join(f"{e} AS {c}" for c, e in columns)
        parts.append(f"{name} AS (SELECT {select} FROM {source}{' WHERE ' + where[0] if where else ''}{' GROUP BY ' + ', '.join(keys) if keys else ''})")
    if not parts:
        return sql
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
    if re.match(r"WITH\b", body, re.I):
        return "WITH " + ", ".join(parts) + ", " + re.sub(r"^WITH\s+", "", body, flags=re.I)
    return "WITH " + ", ".join(parts) + " " + body


def load(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None, dealt: bool = False) -> DataFrame:
    """A view of the catalog, or a plain table; ``given`` are views that are there already.

    ``dealt``: grouped views are dealt out by their first key.  Groups lie inside
    it, and a join by that key needs no other exchange; the aggregate then sorts in
    the stage of what follows, which adds to the memory of a task.
    """
    if given and name in given:
        return given[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if isinstance(VIEWS[name], list):
        return _united(spark, sf_dir, VIEWS[name], given)
    source, keys, columns, *where = VIEWS[name]
    df = load(spark, sf_dir, source, given, dealt)
    if where:
        df = df.filter(where[0])
    if keys:
        from pyspark.sql import functions as F

        plain = [(c, e) for c, e in columns if "max(" not in e]
        grouped = (df.repartition(keys[0]) if dealt else df).groupBy(*keys).agg(*[F.expr(e).alias(c) for c, e in columns if "max(" in e])
        return grouped.selectExpr(*[f"{e} AS {c}" for c, e in plain], *[c for c, e in columns if "max(" in e])
    return df.selectExpr(*[f"{e} AS `{c}`" for c, e in columns])


def settled(df: DataFrame, *columns) -> DataFrame:
    """Columns of a view, each worked out once a row, however many conditions and keys name it."""
    from pyspark.sql import functions as F

    return df.select(F.inline(F.array(F.struct(*columns))))


def _united(spark: SparkSession, sf_dir: str, names: list[str], given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Views after each other; those over one source become one explode, so that it is read once."""
    from functools import reduce

    from pyspark.sql import functions as F

    sources = {VIEWS[n][0] for n in names if not isinstance(VIEWS[n], list)}
    if len(sources) == 1 and len(names) > 1 and not any(isinstance(VIEWS[n], list) for n in names):
        # the day decides most of what a record says: it is read from the time once a file
        expr = lambda e: F.expr(e.replace(DAY, "__day"))
        rows = [F.when(expr(where[0] if where else "true"), F.struct(*[expr(e).alias(c) for c, e in columns])) for _, _, columns, *where in (VIEWS[n] for n in names)]
        said = " ".join(e for n in names for e in [*dict(VIEWS[n][2]).values(), *VIEWS[n][3:]])
        source = load(spark, sf_dir, sources.pop(), given)
        named = [c for c in source.columns if re.search(rf"\b{c}\b", said.replace(DAY, ""))]
        day = [F.expr(DAY).alias("__day")] if DAY in said else []
        return settled(source, *named, *day).select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")
    return reduce(DataFrame.unionByName, [load(spark, sf_dir, n, given) for n in names])
