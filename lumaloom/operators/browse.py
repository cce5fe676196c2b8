"""Catalog rows, facets, order and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import times as T
from .scratch import written


def preferred_file(files: DataFrame, complete: Column | None = None) -> DataFrame:
    """One row per asset: its most preferred file, as one aggregation with a struct key (no sort, map-side combine)."""
    key = M.preference(F.col("in_scope"), F.col("is_online"), F.col("extension"), F.col("role"), F.col("relative_path"), F.col("file_id"), complete)
    row = F.struct(*[c for c in files.columns if c != "asset_id"])
    return files.groupBy("asset_id").agg(F.min_by(row, key).alias("p")).select("asset_id", "p.*")


def browse_catalog(assets: DataFrame, files: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """One summary per asset with a file in scope; with ``folders``, in one of exactly these.

    Everything comes from one aggregation of the files by asset, so the only
    exchanges are the two sides of the join on the asset.
    """
    key = M.preference(F.col("in_scope"), F.col("is_online"), F.col("extension"), F.col("role"), F.col("relative_path"), F.col("file_id"))
    rendered = ~M.is_raw(F.col("extension"))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    scope = F.col("in_scope")
    inside = F.lit(True) if folders is None else M.parent_folder(F.col("relative_path")).isin(folders) if folders else F.lit(False)
    summary = files.groupBy("asset_id").agg(
        F.min_by(F.struct("file_id", "relative_path", "filename", "extension"), key).alias("p"),
        F.min_by(F.when(sized, F.struct("width", "height")), F.when(sized, key)).alias("d"),
        F.bool_or(scope & inside).alias("any_scope"),
        F.bool_or(scope & rendered).alias("any_rendered"),
        F.max(F.when(scope & rendered, F.col("quality_score"))).alias("q_rendered"),
        F.max(F.when(scope, F.col("quality_score"))).alias("q_all"),
        F.count("*").cast("long").alias("n_files"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).cast("long").alias("bytes"),
    ).filter("any_scope")
    return assets.join(summary, "asset_id").select(
        "asset_id", "media_type", "capture_time", "selection_state", "group_id",
        F.col("p.file_id").alias("preferred_file_id"), F.col("p.relative_path").alias("preferred_path"), F.col("p.filename").alias("filename"),
        F.col("d.width").alias("width"), F.col("d.height").alias("height"),
        F.when(F.col("any_rendered"), F.col("q_rendered")).otherwise(F.col("q_all")).alias("quality"),
        "n_files", "bytes",
    )


def facets(catalog: DataFrame, files: DataFrame | None = None, *, folders: list[str] | None = None, media_type: str | None = None, decision: str | None = None, layout: str | None = None, text: str | None = None) -> DataFrame:
    """Faceted filter of catalog rows.  folders: exact parents of any in-scope file; None is all, [] none."""
    out = catalog
    if folders is not None:
        inside = files.filter("in_scope").filter(M.parent_folder(F.col("relative_path")).isin(folders) if folders else F.lit(False))
        out = out.join(inside.select("asset_id").distinct(), "asset_id", "left_semi")
    if media_type:
        out = out.filter(F.col("media_type") == media_type)
    if decision:
        if decision not in ("selected", "rejected", "undecided"):
            raise ValueError(f"unknown decision: {decision}")
        out = out.filter(F.col("selection_state") == decision)
    if layout:
        if layout not in ("horizontal", "vertical"):
            raise ValueError(f"unknown layout: {layout}")
        sized = (F.col("width") > 0) & (F.col("height") > 0)
        out = out.filter(sized & (F.col("width") >= F.col("height") if layout == "horizontal" else F.col("height") > F.col("width")))
    if text:
        out = out.filter(F.lower("filename").contains(text.lower()))
    return out


def ordered(catalog: DataFrame, by: str = "capture_time", descending: bool = True) -> DataFrame:
    """Nulls last in both directions, then the id."""
    if by not in ("capture_time", "quality", "filename"):
        raise ValueError(f"unknown sort key: {by}")
    c = F.lower(by) if by == "filename" else F.col(by)
    return catalog.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "asset_id")


def page(rows: DataFrame, number: int, size: int, most: int = 180) -> DataFrame:
    """Rows of a page, counted from 1; the size is limited."""
    size = max(1, min(size, most))
    return rows.offset((max(1, number) - 1) * size).limit(size)


def windows_of_groups(items: DataFrame, catalog: DataFrame, qualify: bool = False, least: int = 2) -> DataFrame:
    """Groups of at least ``least`` filtered items; with ``qualify`` the items only choose groups and all catalog members return."""
    if qualify:
        chosen = items.filter("group_id is not null").select("group_id").distinct()
        members = catalog.join(chosen, "group_id", "left_semi")
    else:
        members = items.filter("group_id is not null")
    return (
        members.groupBy("group_id")
        .agg(F.count("*").cast("long").alias("n_members"), F.min("asset_id").alias("first_asset"), F.max("asset_id").alias("last_asset"), F.max("quality").alias("best_quality"))
        .filter(F.col("n_members") >= least)
    )


def timeline_points(assets: DataFrame, files: DataFrame, mode: str = "capture") -> DataFrame:
    """asset_id, time_us, precision_us of every asset with a time, by the displayed clock.

    ``capture``: the asset's time, or the finest time that one of its files in
    scope records, if that is finer.  ``file_created``: the time of the preferred
    file in scope.  files(file_created_time, exif_time) beside the usual columns.
    """
    return timelines(assets, files, [mode]).drop("mode")


def timelines(assets: DataFrame, files: DataFrame, modes: list[str]) -> DataFrame:
    """mode, asset_id, time_us, precision_us: :func:`timeline_points` of several modes, from one pass over the files."""
    for mode in modes:
        if mode not in ("capture", "file_created"):
            raise ValueError(f"unknown time mode: {mode}")
    key = M.preference(F.col("in_scope"), F.col("is_online"), F.col("extension"), F.col("role"), F.col("relative_path"), F.col("file_id"))
    exif = F.col("exif_time")
    known = F.when(T.wall_clock_us(exif).isNotNull(), F.struct(T.precision_us(exif), key))
    found = files.filter("in_scope").groupBy("asset_id").agg(F.min_by("file_created_time", key).alias("created"), F.min_by("exif_time", known).alias("exif"))
    j = assets.join(found, "asset_id", "left")
    own = F.coalesce(T.precision_us(F.col("capture_time")), F.lit(1_000_000))
    values = {"file_created": F.col("created"), "capture": F.when(T.precision_us(F.col("exif")) < own, F.col("exif")).otherwise(F.col("capture_time"))}
    j = j.select("asset_id", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), values[m].alias("value")) for m in modes])))
    value = F.col("value")
    return j.select("mode", "asset_id", T.wall_clock_us(value).alias("time_us"), T.precision_us(value).alias("precision_us")).filter("time_us is not null")


def locate(ordered_ids: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Position (from 0) and page (from 1) of every row of an ordered list.

    The list is sorted by ranges and written; a row's position is its place in
    its part and the rows of the parts before, one number for each of those.
    """
    saved = written(ordered_ids.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "located")
    part = F.shiftright("__at", 33)
    counts = saved.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r["__part"], before))
        before += r["n"]
    parts = ordered_ids.sparkSession.createDataFrame(starts, "__part long, __before long")
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return saved.join(F.broadcast(parts), part == F.col("__part")).withColumn("position", at).withColumn("page", (F.floor(F.col("position") / size) + 1).cast("long")).drop("__at", "__part", "__before")
