"""What an index run has to do, and how long it will take."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import metrics as X
from .states import SETTLED

#: Seconds an item where nothing was timed, and seconds that a step costs whatever its size.
RATES = {
    "scan.discovery": 0.025, "scan.hashing": 0.06, "metadata.processing": 0.14, "thumbnail.image": 0.20, "thumbnail.raw": 0.30, "thumbnail.video": 1.10,
    "reconciliation": 0.035, "quality.image": 0.28, "quality.raw": 0.35, "quality.video_sample": 0.45, "video.extraction_total": 0.40, "embedding.image": 0.25,
    "embedding.video_sample": 0.30, "grouping.image": 0.06, "features.total": 0.06, "strict_grouping.rate_sample": 0.008, "semantic_projection.rate_sample": 0.001, "recommendations.asset": 0.015,
}
FIXED = {"scan": 1.0, "reconciliation": 0.8, "embedding_initialization": 8.0, "grouping": 0.8, "recommendations": 0.3}
#: Frames of a video of unknown length, seconds to open a video, and the least part of its usual rate that a timed one may be.
UNKNOWN_SAMPLES, OPEN_SECONDS, LEAST_SHARE = 8, 0.6, 0.45
#: Rates that the time of a job of a kind is made of.
JOB_RATES = {
    "scan": ["scan.discovery", "scan.hashing"], "media_index": ["metadata.processing"], "media_thumbnails": ["thumbnail.image"], "media_quality": ["quality.image"], "raw_quality": ["quality.raw"],
    "video_quality": ["quality.video_sample"], "embeddings": ["embedding.image"], "visual_features": ["grouping.image"], "grouping": ["grouping.image"], "recommendations": ["recommendations.asset"], "reconciliation": ["reconciliation"],
}


@dataclass(frozen=True)
class IndexOptions:
    """What an index run covers.  ``folders`` says of exact folders, without case, whether they take part; others do."""

    folders: dict[str, bool] = field(default_factory=dict)
    rendered: bool = True
    raw: bool = True
    videos: bool = True
    rendered_quality: bool = True
    raw_quality: bool = True
    video_quality: bool = False
    semantic: bool = False
    semantic_videos: bool = False
    fps: float = 2.0
    least_frames: int = 2
    most_frames: int = 32

    def enabled(self, category: Column) -> Column:
        on = [c for c, yes in (("jpeg", self.rendered), ("other_image", self.rendered), ("raw", self.raw), ("video", self.videos)) if yes]
        return category.isin(on)

    def selected(self, folder: Column) -> Column:
        out = [M.casefold(F.lit(f)) for f, included in self.folders.items() if not included]
        return ~M.casefold(folder).isin(out) if out else F.lit(True)

    def samples(self, duration: Column) -> Column:
        return F.coalesce(X.sample_count(duration, self.fps, self.least_frames, self.most_frames), F.lit(UNKNOWN_SAMPLES)).cast("long")


def folder_seconds(files: Column, images: Column, raw: Column, videos: Column, o: IndexOptions) -> Column:
    """Time for the files of one folder at the usual rates."""
    samples = videos * UNKNOWN_SAMPLES
    out = FIXED["scan"] + files * (RATES["scan.discovery"] + RATES["scan.hashing"] + RATES["metadata.processing"]) + videos * RATES["thumbnail.video"]
    out = out + images * (RATES["thumbnail.image"] + RATES["quality.image"] * o.rendered_quality) + raw * (RATES["thumbnail.raw"] + RATES["quality.raw"] * o.raw_quality)
    if o.video_quality:
        out = out + videos * OPEN_SECONDS + samples * RATES["quality.video_sample"]
    if o.semantic:
        out = out + (images + raw) * RATES["embedding.image"] + samples * (RATES["embedding.video_sample"] * o.semantic_videos)
    return out


def folder_plan(report: DataFrame, reusable: DataFrame, o: IndexOptions) -> DataFrame:
    """Each folder of ``sources.listing.folder_report`` with what a run would take from it.

    ``reusable(path)`` are files that are indexed already.  Supported are media of
    enabled categories; ``plan_categories`` has for each category the count of its
    last extension, as documented, not the sum.  A folder that is not selected keeps its figures.
    """
    taken = F.filter(F.map_entries("direct_extensions"), lambda e: o.enabled(M.media_category(e["key"])))
    size = F.aggregate(F.transform("__taken", lambda e: F.element_at("direct_extension_bytes", e["key"])), F.lit(0).cast("long"), lambda s, b: s + b)
    count = F.aggregate("__taken", F.lit(0).cast("long"), lambda s, e: s + e["value"])
    r = report.withColumn("__taken", F.array_sort(taken))
    last = lambda c: F.get(F.reverse(F.filter("__taken", lambda e: M.media_category(e["key"]) == c)["value"]), F.lit(0))
    filled = {c: last(c) for c in M.CATEGORIES if c != "other"}
    r = r.withColumn("plan_categories", F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), n.alias("n")) for c, n in filled.items()]), lambda e: e["n"].isNotNull())))
    r = r.withColumns({"selected": o.selected(F.col("folder")), "supported_files": count, "supported_bytes": size, "plan_extensions": F.map_from_entries("__taken")})
    of = lambda c: F.coalesce(F.try_element_at("plan_categories", F.lit(c)), F.lit(0))
    r = r.withColumn("eta_seconds", F.bround(folder_seconds(F.col("supported_files"), of("jpeg") + of("other_image"), of("raw"), of("video"), o), 1))
    done = reusable.filter(o.enabled(M.media_category(M.extension(F.col("path"))))).groupBy(M.parent_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("reusable_files"))
    r = r.join(done, "folder", "left").withColumn("reusable_files", F.coalesce("reusable_files", F.lit(0)).cast("long"))
    r = r.withColumn("pending_files", F.greatest(F.lit(0), F.col("supported_files") - F.col("reusable_files")))
    left = F.when(F.col("supported_files") > 0, F.bround(F.col("eta_seconds") * F.col("pending_files") / F.col("supported_files"), 1)).otherwise(0.0)
    return r.withColumn("pending_eta_seconds", left).drop("__taken")


def indexed_work(files: DataFrame, states: DataFrame, features: DataFrame, o: IndexOptions, embedding: str = "embedding:image") -> DataFrame:
    """One row of counts: what is still to be done for the files in scope and online.

    An asset is a video, else rendered, else RAW; thumbnails, scores and vectors are
    made from its first file of that kind by path.  features(file_id): files with pixel features.
    """
    rows = files.filter("in_scope and is_online").filter(o.selected(M.parent_folder(F.col("relative_path"))) & o.enabled(M.media_category(F.col("extension"))))
    names = {"metadata": "m", "thumbnail": "t", "quality": "q", embedding: "e"}
    known = states.filter(F.col("component").isin(list(names))).groupBy("file_id").agg(*[F.max(F.when(F.col("component") == c, F.col("status"))).alias(n) for c, n in names.items()])
    rows = rows.join(known, "file_id", "left").join(features.select("file_id").distinct().withColumn("f", F.lit(True)), "file_id", "left")
    done, settled = lambda c: F.coalesce(c == "complete", F.lit(False)), lambda c: F.coalesce(c.isin(SETTLED), F.lit(False))
    video, raw = F.col("media_type") == "video", M.is_raw(F.col("extension"))
    pick = F.struct((~settled(F.col("t"))).alias("t"), (~done(F.col("q"))).alias("q"), (~done(F.col("e"))).alias("e"), o.samples(F.col("duration")).alias("n"), F.col("duration").isNotNull().alias("known"))
    place = F.struct("relative_path", "file_id")
    kinds = {"video": video, "image": ~video & ~raw, "raw": ~video & raw}
    assets = rows.groupBy("asset_id").agg(
        *[F.min_by(F.when(k, pick), F.when(k, place)).alias(n) for n, k in kinds.items()],
        F.count("*").alias("files"), F.count_if(~done(F.col("m"))).alias("metadata"), F.count_if(done(F.col("m")) & settled(F.col("t"))).alias("reusable"), F.count_if(~video & F.col("f").isNull()).alias("grouping_images"),
    )
    kind = F.when(F.col("video").isNotNull(), "video").when(F.col("image").isNotNull(), "image").otherwise("raw")
    a = assets.select("files", "metadata", "reusable", "grouping_images", kind.alias("kind"), F.coalesce("video", "image", "raw").alias("s"))
    s, is_ = F.col("s"), lambda k: F.col("kind") == k
    no = F.lit(False)
    quality = {"image": s["q"] if o.rendered_quality else no, "raw": s["q"] if o.raw_quality else no, "video": s["q"] if o.video_quality else no}
    vectors = s["e"] if o.semantic and o.semantic_videos else no
    frames = lambda c: F.coalesce(F.sum(F.when(is_("video") & c, s["n"])), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return a.agg(
        total("files").alias("files"), total("reusable").alias("reusable"), total("metadata").alias("metadata"),
        *[F.count_if(is_(k) & s["t"]).alias(f"thumbnails_{k}") for k in kinds], *[F.count_if(is_(k) & c).alias(f"quality_{k}") for k, c in quality.items()],
        frames(quality["video"]).alias("quality_samples"), frames(vectors).alias("semantic_samples"), frames(quality["video"] | vectors).alias("decode_samples"), F.count_if(is_("video") & (quality["video"] | vectors)).alias("decode_assets"),
        (F.count_if(~is_("video") & s["e"]) if o.semantic else F.lit(0).cast("long")).alias("semantic_images"),
        (F.count_if(~is_("video") | F.lit(o.semantic_videos)) if o.semantic else F.lit(0).cast("long")).alias("projection_assets"),
        total("grouping_images").alias("grouping_images"), F.count("*").alias("recommendation_assets"), F.coalesce(F.bool_and(~is_("video") | s["known"]), F.lit(True)).alias("durations_known"),
    )


def historical_rates(timings: DataFrame, last: int = 8) -> DataFrame:
    """One row, ``rates``: a struct with a column for each of ``RATES``, from timings(finished, .., seconds, counts: maps by rate).

    The latest ``last`` timed jobs count; a rate is never under 0.45 of its usual value, which stands in where nothing was timed.
    """
    rows = timings.filter("seconds is not null and counts is not null").orderBy(*[F.desc(c) for c in timings.columns if c not in ("seconds", "counts")]).limit(last)
    of = lambda m, name: F.coalesce(F.sum(F.try_element_at(m, F.lit(name))), F.lit(0.0))
    rate = lambda n, usual: F.when((of("counts", n) > 0) & (of("seconds", n) > 0), F.greatest(of("seconds", n) / of("counts", n), F.lit(usual * LEAST_SHARE))).otherwise(F.lit(usual))
    return rows.agg(F.struct(*[rate(n, usual).alias(n.replace(".", "_")) for n, usual in RATES.items()]).alias("rates"))


def index_seconds(work: DataFrame, rates: DataFrame, projected: int | None = None) -> DataFrame:
    """The row of ``indexed_work`` with seconds for each of the sixteen steps and ``estimated_seconds``.

    ``projected``: assets of the projection of the active vectors; nothing is to be projected if they are as many.
    Both inputs have one row; they meet in an aggregate.
    """
    counts = work.columns
    one = work.select(F.struct(*counts).alias("w")).withColumn("rates", F.lit(None).cast(rates.schema["rates"].dataType)).unionByName(rates.select("rates"), allowMissingColumns=True)
    one = one.agg(F.max("w").alias("w"), F.max("rates").alias("rates"))
    n, r = lambda c: F.col("w")[c], lambda name: F.col("rates")[name.replace(".", "_")]
    some = lambda c, x: F.when(c > 0, x).otherwise(0.0)
    projection = some(n("projection_assets"), 0.5 + n("projection_assets") * RATES["semantic_projection.rate_sample"])
    if projected is not None:
        projection = F.when(n("projection_assets") == projected, 0.0).otherwise(projection)
    steps = {
        "scan": FIXED["scan"] + n("metadata") * r("scan.discovery"),
        "hashing": n("metadata") * r("scan.hashing"),
        "metadata": n("metadata") * r("metadata.processing"),
        "thumbnails": n("thumbnails_image") * r("thumbnail.image") + n("thumbnails_raw") * r("thumbnail.raw") + n("thumbnails_video") * r("thumbnail.video"),
        "reconciliation": FIXED["reconciliation"] + n("metadata") * r("reconciliation"),
        "rendered_quality": n("quality_image") * r("quality.image"),
        "raw_quality": n("quality_raw") * r("quality.raw"),
        "video_quality": n("decode_assets") * OPEN_SECONDS + n("decode_samples") * r("video.extraction_total") + n("quality_samples") * r("quality.video_sample"),
        "embedding_initialization": some(n("semantic_images") + n("semantic_samples"), F.lit(FIXED["embedding_initialization"])),
        "image_embeddings": n("semantic_images") * r("embedding.image"),
        "video_embeddings": n("semantic_samples") * r("embedding.video_sample"),
        "semantic_projection": projection,
        "visual_features": n("grouping_images") * r("features.total"),
        "strict_grouping": some(n("grouping_images"), FIXED["grouping"] + n("grouping_images") * r("strict_grouping.rate_sample")),
        "recommendations": some(n("recommendation_assets"), FIXED["recommendations"] + n("recommendation_assets") * r("recommendations.asset")),
        "semantic_search": F.lit(0.0),
    }
    out = one.select("w.*", F.struct(*[s.cast("double").alias(k) for k, s in steps.items()]).alias("s"))
    total = sum((F.col("s")[k] for k in steps), F.lit(0.0))
    return out.select(*counts, *[F.bround(F.col("s")[k], 1).alias(f"{k}_seconds") for k in steps], F.bround(total, 1).alias("estimated_seconds"))


def embedding_plan(files: DataFrame, states: DataFrame, stored: DataFrame, frames: DataFrame, o: IndexOptions, version: str, dimension: int, component: str = "embedding:image") -> DataFrame:
    """One row: vectors that the assets need, those at hand, and space and time for the rest.

    files(.., input_fingerprint); stored(file_id, input_fingerprint): picture vectors;
    frames(file_id, n): vectors of a video's frames.  An asset is read from its
    preferred rendered file, else from its preferred file; pictures count one,
    videos their samples, videos of unknown length are counted apart.  A vector is
    at hand if its record is complete, of this version and input, and it is stored whole.
    """
    rows = files.filter("is_online").filter(o.selected(M.parent_folder(F.col("relative_path"))) & o.enabled(M.media_category(F.col("extension")))).withColumn("__raw", M.is_raw(F.col("extension")))
    key = F.struct("__raw", M.preference(F.col("in_scope"), F.col("is_online"), F.col("extension"), F.col("role"), F.col("relative_path"), F.col("file_id")))
    one = rows.groupBy("asset_id").agg(F.min_by(F.struct("file_id", "media_type", "duration", "input_fingerprint"), key).alias("p")).select("p.*")
    video = F.col("media_type") == "video"
    if not o.semantic_videos:
        one = one.filter(~video)
    record = states.filter((F.col("component") == component) & (F.col("status") == "complete") & (F.col("version") == version)).groupBy("file_id").agg(F.max("input_fingerprint").alias("__record"))
    vector = stored.groupBy("file_id").agg(F.max("input_fingerprint").alias("__vector"))
    one = one.join(record, "file_id", "left").join(vector, "file_id", "left").join(frames.select("file_id", F.col("n").alias("__frames")), "file_id", "left")
    unknown = video & ~F.coalesce(F.col("duration") > 0, F.lit(False))
    units = F.when(unknown, 0).when(video, o.samples(F.col("duration"))).otherwise(1)
    held = (F.col("__record") == F.col("input_fingerprint")) & F.when(video, F.col("__frames") == units).otherwise(F.col("__vector") == F.col("input_fingerprint"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    t = one.agg(total(F.when(~video, units)).alias("images"), total(F.when(video, units)).alias("video_samples"), total(F.when(held, units)).alias("cached"), F.count_if(unknown).alias("unknown_videos"))
    pending = F.col("images") + F.col("video_samples") - F.col("cached")
    seconds = F.col("images") * RATES["embedding.image"] + F.col("video_samples") * RATES["embedding.video_sample"]
    return t.select("*", pending.alias("pending"), (pending * dimension * 2).alias("storage_bytes"), F.bround(F.when(pending > 0, FIXED["embedding_initialization"]).otherwise(0.0) + seconds, 1).alias("seconds"))


def job_seconds(jobs: DataFrame, rates: DataFrame, now: Column) -> DataFrame:
    """jobs(status, kind, total, completed, started, eta[, ..]) with ``seconds`` left; null unless pending or running.

    A finite estimate of the running step comes first; then the pace so far, at
    least a millisecond of it; then the rates of the job's kind for what is left,
    at least one item and one second.  Kinds without a rate have one second.  ``rates`` has one row.
    """
    known = rates.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), sum((F.col("rates")[n.replace(".", "_")] for n in names), F.lit(0.0)).alias("rate")) for k, names in JOB_RATES.items()])).alias("r")).select("r.*")
    total, done = F.greatest(F.coalesce("total", F.lit(0)), F.lit(0)), F.greatest(F.coalesce("completed", F.lit(0)), F.lit(0))
    elapsed = F.greatest(F.lit(0.001), (F.unix_micros(now) - F.unix_micros("started")) / 1e6)
    pace = F.when((total > done) & (done > 0), (total - done) * elapsed / done)
    step = F.when(F.col("eta").isNotNull() & ~F.isnan("eta") & (F.abs("eta") != float("inf")), F.greatest(F.lit(0.0), F.col("eta")))
    usual = F.coalesce(F.greatest(F.lit(1.0), F.greatest(F.lit(1), total - done) * F.col("rate")), F.lit(1.0))
    # ten kinds with a rate: small whatever the jobs
    return jobs.join(F.broadcast(known), "kind", "left").withColumn("seconds", F.when(F.col("status").isin("pending", "running"), F.coalesce(step, pace, usual))).drop("rate")
