"""Level-of-detail aggregation for timelines, maps and vector plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Bucket widths that a timeline can take.
LADDER_US = [1_000_000, 60_000_000, 3_600_000_000, 21_600_000_000, 86_400_000_000, 604_800_000_000]


def bucket_interval(span_us: Column, width: int, ladder: list[int]) -> Column:
    """The interval nearest, by ratio, to 92 pixels' worth of the span; the shorter if tied."""
    target = span_us * F.lit(92.0) / width
    best = F.array_min(F.array(*[F.struct(F.abs(F.ln(F.lit(float(x)) / target)).alias("r"), F.lit(x).cast("long").alias("x")) for x in ladder]))
    return best["x"]


#: From these intervals on, in seconds, buckets are calendar years, quarters and months.
CALENDAR = [(31_536_000, 12), (7_776_000, 3), (2_592_000, 1)]


def bucket_bounds(time_us: Column, interval_us: Column) -> tuple[Column, Column]:
    """(start, end) in microseconds of the bucket that a time (UTC) falls into; the interval may differ by row."""
    day = F.to_date(F.timestamp_micros(time_us))
    at = lambda d: F.unix_date(d) * F.lit(86_400_000_000)
    fixed = F.floor(time_us / interval_us).cast("long") * interval_us
    start, end = fixed, fixed + interval_us
    for least, months in reversed(CALENDAR):
        first = F.trunc(day, {12: "year", 3: "quarter", 1: "month"}[months])
        long = interval_us >= least * 1_000_000
        start, end = F.when(long, at(first)).otherwise(start), F.when(long, at(F.add_months(first, months))).otherwise(end)
    return start, end


def time_buckets(points: DataFrame, time_us: str, interval_us: int) -> DataFrame:
    """bucket, n, representative: counts, and the best point by (quality desc, id)."""
    b = F.floor(F.col(time_us) / interval_us).cast("long")
    best = F.struct(F.coalesce(-F.col("quality"), F.lit(float("inf"))).alias("q"), F.col("id"))
    return points.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.min(best)["id"].alias("representative"))


def zero_filled(buckets: DataFrame) -> DataFrame:
    """All buckets between the first and the last, empty ones with 0; the spine has one row a bucket."""
    ends = buckets.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("bucket"))
    return spine.join(buckets.select("bucket", "n"), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def timeline(points: DataFrame, interval_us: int) -> tuple[DataFrame, DataFrame]:
    """(buckets, members) of points(id, us, quality).

    buckets: start_us, end_us, n, representative (by quality, then id); members:
    start_us, id, us, one row a point, because a bucket may hold any part of all
    points: in a bucket they go by (us, id).  Points without a time are left out.
    """
    start, end = bucket_bounds(F.col("us"), F.lit(interval_us).cast("long"))
    members = points.filter("us is not null").select("id", "us", "quality", start.alias("start_us"), end.alias("end_us"))
    best = F.struct(F.coalesce(-F.col("quality"), F.lit(float("inf"))).alias("q"), F.col("id"))
    buckets = members.groupBy("start_us", "end_us").agg(F.count("*").alias("n"), F.min(best)["id"].alias("representative"))
    return buckets, members.select("start_us", "id", "us")


#: Why a view is empty.
EMPTY = {"geo": "No filtered assets have valid GPS coordinates.", "capture": "No filtered assets have a usable capture time.", "file_created": "No filtered assets have a usable file-created time.", "vector": "No filtered assets have a projected semantic vector."}
NOTHING = "No assets match these filters."


def view_state(kind: str, assets: DataFrame, points: DataFrame | None, mode: str = "capture", reason: str | None = None) -> DataFrame:
    """One row on a view of the filtered assets: filtered_asset_count, represented_point_count, available, empty_reason.

    kind: geo, timeline (mode capture or file_created; any other is capture) or
    vector.  A vector view without a projection (``points`` is None) isn't available, for ``reason``.
    """
    if kind not in ("geo", "timeline", "vector"):
        raise ValueError(f"unknown view: {kind}")
    key = EMPTY[kind if kind != "timeline" else mode if mode == "file_created" else "capture"]
    counted = assets.select(F.lit(1).alias("a"), F.lit(0).alias("p"))
    if points is not None:
        counted = counted.unionByName(points.select(F.lit(0).alias("a"), F.lit(1).alias("p")))
    n = counted.agg(F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("filtered_asset_count"), F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("represented_point_count"))
    # a vector view doesn't tell apart that no asset matches
    empty = F.lit(key) if kind == "vector" else F.when(F.col("filtered_asset_count") == 0, NOTHING).otherwise(key)
    why = F.lit(reason).cast("string") if points is None else F.when(F.col("represented_point_count") == 0, empty)
    return n.select(F.lit(kind).alias("view"), "filtered_asset_count", "represented_point_count", F.lit(points is not None).alias("available"), why.alias("empty_reason"))


def density(buckets: DataFrame) -> DataFrame:
    """Binomial smoothing (1 4 6 4 1) / 16 over neighbouring buckets: each bucket sends its share, no window over all rows."""
    share = F.explode(F.array(*[F.struct((F.col("bucket") + k).alias("bucket"), (F.col("n") * w).alias("v")) for k, w in ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))]))
    spread = buckets.select(share.alias("s")).select("s.*").groupBy("bucket").agg(F.sum("v").alias("v"))
    return buckets.join(spread, "bucket").select("bucket", "n", (F.col("v") / 16).alias("density"))


def cells(points: DataFrame, x: str, y: str, base: float, level: int) -> DataFrame:
    """Square cells of side base / 2**level: count, centroid and the best point by (quality desc, id)."""
    side = base / 2**level
    best = F.struct(F.coalesce(-F.col("quality"), F.lit(float("inf"))).alias("q"), F.col("id"))
    return points.groupBy(F.floor(F.col(x) / side).cast("long").alias("cx"), F.floor(F.col(y) / side).cast("long").alias("cy")).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(best)["id"].alias("representative")
    )


def visible(cells_: DataFrame, box: tuple[float, float, float, float], side: float, overscan: float) -> DataFrame:
    """Cells that meet a viewport widened by ``overscan``."""
    a, b, c, d = box
    low, high = (lambda v: math.floor((v - overscan) / side)), (lambda v: math.floor((v + overscan) / side))
    return cells_.filter(F.col("cx").between(low(a), high(c)) & F.col("cy").between(low(b), high(d)))


def splat(points: DataFrame, x: str, y: str, size: int = 512, radius: int = 3) -> DataFrame:
    """Density raster: every point adds exp(-d*d/5) to the pixels around it; points are counted by pixel first."""
    p = points.select(F.floor(F.col(x) * size).cast("int").alias("px"), F.floor(F.col(y) * size).cast("int").alias("py")).groupBy("px", "py").agg(F.count("*").alias("k"))
    around = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    out = p.select(F.explode(F.array(*[F.struct((F.col("px") + i).alias("px"), (F.col("py") + j).alias("py"), (F.col("k") * math.exp(-(i * i + j * j) / 5)).alias("v")) for i, j in around])).alias("s")).select("s.*")
    return out.filter(F.col("px").between(0, size - 1) & F.col("py").between(0, size - 1)).groupBy("px", "py").agg(F.sum("v").alias("v"))


def merge_rectangles(boxes: DataFrame, order: list[str], overlap: float = 0.55) -> DataFrame:
    """boxes(id, x, y, w, h, ...) -> id, anchor: rectangles that would hide each other share one marker.

    In ``order`` a rectangle joins the marker that it covers most, if that is at
    least ``overlap`` of the smaller of the two (ties: the earlier marker), else it
    is a marker itself.  ``order`` must tell all rows apart.  Rectangles without an
    area, or with a null, are markers of their own.

    A rectangle is a marker unless an earlier marker covers it, so only pairs that
    cover each other matter; they come from an equi-join on a grid.  Each round
    settles those that wait for nobody, and what they cover; rounds grow with the
    longest chain of rectangles that wait for each other, and every round is a
    written table with the pairs that are left.
    """
    place = F.struct(*[F.col(c) for c in order])
    rows = boxes.select("id", place.alias("at"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    solid = rows.filter((F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull())
    # a grid as wide as the widest one: a rectangle meets others in its own cell and the cells after it
    side = solid.agg(F.greatest(F.max("w"), F.max("h")).alias("side"))
    placed = solid.crossJoin(F.broadcast(side)).withColumn("gx", F.floor(F.col("x") / F.col("side"))).withColumn("gy", F.floor(F.col("y") / F.col("side")))  # one row
    around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    names = ["id", "at", *"xywh"]
    left = placed.select(*[F.col(c).alias(f"a_{c}") for c in names], "gx", "gy")
    right = placed.select(*[F.col(c).alias(f"b_{c}") for c in names], around.alias("g")).select("*", "g.gx", "g.gy").drop("g")

    def shared(p: str, size: str) -> Column:
        ends = F.least(F.col(f"a_{p}") + F.col(f"a_{size}"), F.col(f"b_{p}") + F.col(f"b_{size}"))
        return F.greatest(F.lit(0.0), ends - F.greatest(f"a_{p}", f"b_{p}"))

    part = shared("x", "w") * shared("y", "h") / F.least(F.col("a_w") * F.col("a_h"), F.col("b_w") * F.col("b_h"))
    pairs = left.join(right, ["gx", "gy"]).filter(F.col("a_at") < F.col("b_at")).withColumn("part", part).filter(F.col("part") >= overlap)
    pairs = written(pairs.select(F.col("a_id").alias("early"), F.col("a_at").alias("at"), F.col("b_id").alias("late"), "part"), "covered")
    waiting, joined = pairs.select("early", "late"), None
    while not waiting.isEmpty():
        free = waiting.select("early").join(waiting.select(F.col("late").alias("early")), "early", "left_anti").distinct()
        gone = written(waiting.join(free, "early", "left_semi").select("late").distinct(), "joined")
        joined = gone if joined is None else joined.union(gone)
        waiting = written(waiting.join(gone, "late", "left_anti").join(gone.select(F.col("late").alias("early")), "early", "left_anti"), "waiting")
    if joined is None:
        return rows.select("id", F.col("id").alias("anchor"))
    joined = written(joined, "joined")
    markers = pairs.join(joined, "late", "left_semi").join(joined.select(F.col("late").alias("early")), "early", "left_anti")
    best = markers.groupBy(F.col("late").alias("id")).agg(F.min_by("early", F.struct(-F.col("part"), F.col("at"))).alias("anchor"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("anchor", "id").alias("anchor"))
