"""What a viewer shows of an asset: one summary, or all its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from .states import by_component

PARTS = ["metadata", "thumbnail", "quality"]
UNDER_WAY = ["pending", "running"]
#: Files of an asset from which its summary is aggregated in parts; there are few such assets, one in so many files at most.
HOT = 100_000


#: What a file's details hold of its own columns, and what is said of it.
DETAILS = ["relative_path", "filename", "extension", "media_type", "role", "size_bytes", "sha256", "mtime", "is_online", "in_scope", "width", "height", "duration", "quality_score", "relationships"]


def _with_states(files: DataFrame, states: DataFrame) -> DataFrame:
    # of thumbnails it is asked whether a path is recorded, which keeps the order of records; of the others version and status
    told = states.withColumn("output_path", F.col("output_path") != "")
    known = by_component(told, PARTS, {"metadata": 2, "thumbnail": 4, "quality": 2})
    state = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["version"].alias("version"), F.col(c)["status"].alias("status"))).alias(c)
    thumbnail = F.coalesce((F.col("thumbnail.status") == "complete") & F.col("thumbnail.output_path"), F.lit(False))
    known = known.select("file_id", F.struct(*[state(c) for c in PARTS]).alias("__s"), thumbnail.alias("__thumbnail"))
    return files.join(known, "file_id", "left").withColumn("__thumbnail", F.coalesce("__thumbnail", F.lit(False)))


def _preference() -> Column:
    return M.preference(F.col("in_scope"), F.col("is_online"), F.col("extension"), F.col("role"), F.col("relative_path"), F.col("file_id"))


def asset_summaries(assets: DataFrame, files: DataFrame, states: DataFrame, decisions: DataFrame, groups: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row per asset that has a file.

    files(.., codec, quality_record); decisions(asset_id, representative, recommended);
    groups(group_id, members).  Files in scope stand for the asset, all of them if none
    is; the score is the first by (online, path) of a file that is not RAW, of any if
    all are RAW.  What is shown is the preferred online file that is not RAW, else
    the preferred online one, as a preview for RAW and JPEG XL files that have one.
    Issues are as in a viewer: offline, processing, unsupported, failed.

    One aggregate by asset holds the best file for each purpose; the files of an
    asset are never gathered.  They meet it as plain rows, once; only assets of more
    than ``HOT`` files are aggregated in parts before, so that none is one task's.
    """
    f = _with_states(files, states)
    raw = (F.col("media_type") == "image") & M.is_raw(F.col("extension"))
    scope, online, score = F.col("in_scope"), F.col("is_online"), F.col("quality_score")
    key = _preference()
    rank = key["a"] * 16 + key["b"] * 8 + key["d"] * 4 + key["e"] * 2 + key["f"]
    status = F.array(*[F.col("__s")[c]["status"] for c in PARTS])
    flags = {"processing": F.arrays_overlap(status, F.array(*map(F.lit, UNDER_WAY))), "unsupported": F.array_contains(status, "unsupported"), "failed": F.array_contains(status, "failed")}
    # which files count: in scope or all, without RAW ones or all
    cases = {"sr": scope & ~raw, "s": scope, "r": ~raw, "a": F.lit(True)}
    asked = {"online_s": scope & online, **{f"has_{n}": c for n, c in cases.items()}, **{f"{n}_{k}": c & x for n, x in flags.items() for k, c in cases.items()}}
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(asked.values())]
    source = M.quality_source(score, F.col("quality_record"), F.col("media_type"))
    f = f.select(
        "asset_id", "file_id", "relative_path", "filename", "codec", "extension", "in_scope", "is_online", "width", "height",
        raw.alias("raw"), F.col("__thumbnail").alias("thumbnail"), rank.alias("rank"), sum(bits[1:], bits[0]).alias("__bits"), score.alias("score"), source.alias("source"),
    )

    def summed(f: DataFrame) -> DataFrame:
        order = ["rank", F.lower("relative_path").alias("low"), "relative_path", "file_id"]
        place = [(~scope).alias("a"), (~online).alias("b"), "relative_path", "file_id"]
        best = lambda order, when, *shown: F.min(F.when(when, F.struct(*order, *shown)))
        scored, rendered = F.col("score").isNotNull(), ~F.col("raw")
        return f.groupBy("asset_id").agg(
            F.count("*").alias("physical_count"), F.count_if(online).alias("online_count"), F.bit_or("__bits").alias("__said"),
            best(order, F.lit(True), "filename", "codec").alias("__p"), best(order, online, "codec", "extension", "raw", "thumbnail").alias("__o"),
            best(order, online & rendered, "extension", "raw", "thumbnail").alias("__d"), best(order, F.col("thumbnail")).alias("__t"),
            best(order, (F.col("width") > 0) & (F.col("height") > 0), "width", "height").alias("__z"),
            best(place, rendered & scored, "score", "source").alias("__qr"), best(place, scored, "score", "source").alias("__qa"),
        )

    many = F.broadcast(files.groupBy("asset_id").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("asset_id"))
    g = summed(f.join(many, "asset_id", "left_anti").repartition("asset_id")).unionByName(summed(f.join(many, "asset_id", "left_semi")))
    said = {n: F.col("__said").bitwiseAND(F.lit(1 << i)) != 0 for i, n in enumerate(asked)}
    scoped = said["has_s"]
    inside = lambda c: F.when(~scoped | (~F.col(c)["a"] if c.startswith("__q") else F.col(c)["rank"] < 16), F.col(c))
    g = g.select("*", *[inside(c).alias(c[2:]) for c in ("__p", "__o", "__d", "__t", "__z", "__qr", "__qa")])
    rendered = F.when(scoped, said["has_sr"]).otherwise(said["has_r"])
    quality = F.when(rendered, F.col("qr")).otherwise(F.col("qa"))
    counted = lambda n: F.when(scoped, F.when(said["has_sr"], said[f"{n}_sr"]).otherwise(said[f"{n}_s"])).otherwise(F.when(said["has_r"], said[f"{n}_r"]).otherwise(said[f"{n}_a"]))
    offline = ~F.when(scoped, said["online_s"]).otherwise(F.col("online_count") > 0)
    shown = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{n}").alias(n) for n in ("file_id", "extension", "raw", "thumbnail")]))
    display = F.coalesce(shown("d"), shown("o"))
    preview = display["raw"] | ((F.lower(display["extension"]) == ".jxl") & display["thumbnail"])
    out = assets.join(g, "asset_id").join(decisions.select("asset_id", "representative", "recommended"), "asset_id", "left").join(groups.select("group_id", "members"), "group_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "asset_id", "media_type", F.coalesce(F.col("o.codec"), F.col("p.codec")).alias("codec"), "capture_time", "capture_time_kind", F.col("p.filename").alias("filename"), F.col("p.relative_path").alias("relative_path"),
        (F.col("online_count") > 0).alias("is_online"), "physical_count", "online_count", F.col("t.file_id").alias("thumbnail_file_id"), F.col("o.file_id").alias("original_file_id"),
        display["file_id"].alias("display_file_id"), F.when(display.isNotNull(), F.when(preview, "preview").otherwise("original")).alias("display_kind"), quality["score"].alias("quality_score"), quality["source"].alias("quality_source"),
        F.array_compact(F.array(F.when(offline, "offline"), *[F.when(counted(n), n) for n in flags])).alias("issues"), yes(F.col("representative")).alias("is_representative"), F.col("group_id").alias("current_group_id"),
        yes(F.col("recommended")).alias("auto_recommended"), F.col("selection_state").alias("user_decision"), F.lit(run_id).cast("string").alias("recommendation_run_id"), F.col("p.file_id").alias("preferred_physical_id"),
        F.col("members").alias("strict_group_member_count"), F.col("z.width").alias("width"), F.col("z.height").alias("height"),
    )


def asset_details(assets: DataFrame, files: DataFrame, states: DataFrame, relations: DataFrame, derivatives: DataFrame, locations: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """asset_id, location, files: every file of an asset as a struct, the preferred one first, then by (online, path).

    relations(file_id, kind); derivatives(file_id, codec, profile) of managed files;
    locations(file_id, latitude, longitude) as written: the place is that of the
    preferred file if it is on the globe, else of the first file in order whose is,
    among files in scope, or all if none is.  An asset's files are one row by definition.
    ``columns``: which of ``DETAILS`` are wanted, all if none are named.

    Files meet their asset as plain rows that hold each text once, not as lists and keys half made.
    """
    columns = DETAILS if columns is None else columns
    kinds = relations.groupBy("file_id").agg(F.array_sort(F.collect_set("kind")).alias("__kinds"))
    managed = derivatives.groupBy("file_id").agg(F.max(F.struct("codec", "profile")).alias("__m"))
    where = locations.groupBy("file_id").agg(F.max(F.struct("latitude", "longitude")).alias("__l"))
    f = _with_states(files, states).join(kinds, "file_id", "left").join(managed, "file_id", "left").join(where, "file_id", "left")
    related = F.coalesce("__kinds", F.array().cast("array<string>"))
    role = F.when(M.is_raw(F.col("extension")) & (F.col("role") == "original"), "camera_raw").otherwise(F.col("role"))
    label = M.representation_label(F.when(F.col("__m").isNotNull(), F.col("file_id")), F.col("__m.codec"), F.col("__m.profile"), role, related)
    on_globe = M.valid_gps(F.col("__l.latitude"), F.col("__l.longitude"))
    spot = F.when(on_globe, F.struct(F.col("__l.latitude").try_cast("double").alias("latitude"), F.col("__l.longitude").try_cast("double").alias("longitude")))
    asked = dict.fromkeys([*(c for c in columns if c != "relationships"), "relative_path", "extension", "role", "is_online", "in_scope"])
    f = f.select("asset_id", "file_id", *asked, related.alias("relationships"), label.alias("label"), "__s", "__thumbnail", spot.alias("spot")).repartition("asset_id")
    row = F.struct(
        (~F.col("is_online")).alias("off"), F.col("relative_path").alias("path"), F.col("file_id").alias("id"),
        F.struct("file_id", *columns, "label", (F.col("is_online") & F.col("in_scope")).alias("original"), (F.col("__thumbnail") & F.col("in_scope")).alias("thumbnail"),
                 F.struct(*[F.struct(F.col("__s")[c]["status"].alias("status"), F.col("__s")[c]["version"].alias("version")).alias(c) for c in PARTS]).alias("components")).alias("file"),
    )
    key, placed = _preference(), F.col("spot").isNotNull()
    g = f.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(row)).alias("all"), F.min_by("file_id", key).alias("first"), F.bool_or("in_scope").alias("scoped"), F.min_by(F.struct("in_scope", "spot"), key).alias("own"),
        F.min_by(F.when(placed, F.struct("in_scope", "spot")), F.when(placed, F.struct((~F.col("in_scope")).alias("a"), (~F.col("is_online")).alias("b"), "relative_path", "file_id"))).alias("any"),
    )
    ordered = F.concat(F.filter("all", lambda x: x["id"] == F.col("first")), F.filter("all", lambda x: x["id"] != F.col("first")))
    location = F.coalesce(F.col("own.spot"), F.when(~F.col("scoped") | F.col("any.in_scope"), F.col("any.spot")))
    return assets.join(g, "asset_id").select("asset_id", location.alias("location"), ordered["file"].alias("files"))
