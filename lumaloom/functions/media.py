"""Column builders for paths, representations and media classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension classes.
RAW = [".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".rw2"]
JPEG = [".jpg", ".jpeg"]
VIDEO = [".avi", ".m4v", ".mkv", ".mov", ".mp4", ".webm"]
OTHER_IMAGE = [".png", ".heic", ".heif", ".webp", ".jxl", ".avif"]


def casefold(text: Column) -> Column:
    """Text for comparisons without case, as full case folding gives it (sharp s is ss, both sigmas are one, dotless i stays)."""
    kept = F.translate(text, "\u0131", "\ue000")
    # Spark takes lower(upper(x)) for lower(x); the step between them gives the dotless i back
    full = F.translate(F.lower(F.translate(F.upper(kept), "\ue000", "\u0131")), "\u03c2", "\u03c3")
    # of text without other than ASCII letters that is lower(x), at a small part of the time
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(full)


def parent_folder(path: Column) -> Column:
    """Folder of a posix path; the root is the empty string."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the stem."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def folder_prefixes(folder: Column) -> Column:
    """All ancestors of a folder, itself and the root included."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    )


def in_folder(path: Column, folder: str) -> Column:
    """Recursive: the folder itself or anything below it; the comparison ignores case."""
    return F.lit(True) if folder == "" else (F.lower(path) == folder.lower()) | F.lower(path).startswith(folder.lower() + "/")


#: What ``media_category`` tells apart, in order.
CATEGORIES = ["jpeg", "other", "other_image", "raw", "video"]


def media_category(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(JPEG), "jpeg").when(e.isin(RAW), "raw").when(e.isin(VIDEO), "video").when(e.isin(OTHER_IMAGE), "other_image").otherwise("other")


def representation_class(ext: Column) -> Column:
    e = F.lower(ext)
    return (
        F.when(e.isin(VIDEO), "video").when(e.isin(RAW), "raw").when(e.isin([*JPEG, ".png"]), "conventional-image").when(e.isin([".jxl", ".avif", ".webp"]), "compressed-image").otherwise("rendered-image")
    )


def representation_origin(role: Column, managed: Column) -> Column:
    r = F.lower(F.coalesce(role, F.lit("")))
    return F.when(F.coalesce(managed, F.lit(False)) | r.startswith("managed") | r.startswith("derived") | r.startswith("selected_original"), "managed").otherwise("source")


def format_name(ext: Column) -> Column:
    e = F.regexp_replace(F.lower(ext), r"^\.", "")
    return F.when(e == "jpg", "jpeg").otherwise(e)


def quality_source(score: Column, record: Column, media_type: Column) -> Column:
    """What a quality score was computed on; null without one."""
    embedded = F.get_json_object(record, "$.quality_source") == "raw_embedded_preview"
    return F.when(score.isNotNull(), F.when(embedded, "RAW embedded preview").when(media_type == "video", "sampled video frames").otherwise("rendered image"))


def relationship_label(kind: Column) -> Column:
    return F.when(kind == "exact_duplicate", "Exact duplicate").when(kind == "raw_jpeg", "RAW/JPEG pair").when(kind == "external_rendered_peer", "External JPEG XL representation").otherwise("Representation relationship")


def representation_label(managed: Column, codec: Column, profile: Column, role: Column, relations: Column) -> Column:
    """Managed derivatives by codec and profile, then camera roles, then the first relationship."""
    name = F.when(codec == "jpeg-xl", "JPEG XL").when(codec == "av1", "AV1").otherwise(F.coalesce(codec, F.lit("Managed")))
    first = F.array_min(F.transform(relations, relationship_label))
    derivative = F.concat(name, F.lit(" derivative · "), F.coalesce(profile, F.lit("managed profile")))
    return F.when(managed.isNotNull(), derivative).when(role == "camera_raw", "RAW source").when(role == "camera_jpeg", "Camera JPEG").otherwise(F.coalesce(first, F.lit("Physical file")))


def is_raw(ext: Column) -> Column:
    return F.lower(ext).isin(RAW)


def preference(in_scope: Column, online: Column, ext: Column, role: Column, path: Column, key: Column, complete: Column | None = None) -> Column:
    """Order of preference of an asset's files, smallest first.

    In scope, online, component complete, rendered before RAW, camera JPEG,
    unmanaged JXL last, then the path (without case, then as is) and the id.
    """
    no = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    parts = [no(in_scope).alias("a"), no(online).alias("b")]
    if complete is not None:
        parts.append(no(complete).alias("c"))
    r = F.lower(F.coalesce(role, F.lit("")))
    unmanaged_jxl = (F.lower(ext) == ".jxl") & ~r.startswith("managed") & ~r.startswith("derived")
    return F.struct(*parts, no(~is_raw(ext)).alias("d"), no(role == "camera_jpeg").alias("e"), no(~unmanaged_jxl).alias("f"), F.lower(path).alias("g"), path.alias("h"), key.alias("i"))


def valid_gps(latitude: Column, longitude: Column) -> Column:
    """Numeric, finite and on the globe."""
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok, F.lit(False))


def preservation(source: Column, output: Column) -> Column:
    """struct<preserved, changed, lost>: keys of two maps of text by what becomes of them, each in order.

    A key without a value counts as missing; values are compared trimmed and
    without case; ``changed`` has the key with both values.  What only the output has is no matter.
    """
    plain = lambda v: casefold(F.trim(F.coalesce(v, F.lit(""))))
    both = F.map_entries(F.map_zip_with(source, output, lambda k, a, b: F.struct(a.alias("source"), b.alias("output"), plain(a).alias("x"), plain(b).alias("y"))))

    def told(entries: Column) -> Column:
        of = lambda cond: F.filter(entries, lambda e: (e["value"]["x"] != "") & cond(e["value"]["x"], e["value"]["y"]))
        return F.struct(
            F.transform(of(lambda x, y: x == y), lambda e: e["key"]).alias("preserved"),
            F.transform(of(lambda x, y: (y != "") & (x != y)), lambda e: F.struct(e["key"].alias("key"), e["value"]["source"].alias("source"), e["value"]["output"].alias("output"))).alias("changed"),
            F.transform(of(lambda x, y: y == ""), lambda e: e["key"]).alias("lost"),
        )

    # values are folded once, entries sorted once; null maps stay null lists
    return F.get(F.transform(F.array(F.sort_array(both)), told), F.lit(0))


def capped_size(width: Column, height: Column, long_side: int, short_side: int) -> tuple[Column, Column]:
    """(width, height) within a cap that is turned for upright pictures: never larger, whole even numbers, at least 2."""
    upright = width < height
    wide, high = F.when(upright, short_side).otherwise(long_side), F.when(upright, long_side).otherwise(short_side)
    scale = F.least(F.lit(1.0), wide / width, high / height)
    even = lambda x: F.greatest(F.lit(2), (F.floor(x * scale / 2) * 2).cast("int"))
    return even(width), even(height)


def rational(text: Column) -> Column:
    """Number of "n" or "n/d"; null where it is none or d is zero."""
    over = text.contains("/")
    parts = F.split(text, "/")
    quotient = F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")))
    return F.when(over, quotient).otherwise(text.try_cast("double"))


def gps_position(gps: Column) -> Column:
    """struct<latitude, longitude, altitude_m, image_direction_degrees, timestamp> of a struct of EXIF GPS text.

    Coordinates are arrays of degrees, minutes and seconds, south and west negative;
    altitudes below the sea (reference 1) negative; the time of the fix has up to three places, without trailing zeros.
    Whatever can't be read is null.
    """

    def degrees(name: str) -> Column:
        p = [rational(F.get(gps[name], F.lit(i))) for i in range(3)]
        return F.when(F.upper(gps[f"{name}Ref"]).isin("S", "W"), -1).otherwise(1) * (p[0] + p[1] / 60 + p[2] / 3600)

    h, m, s = (rational(F.get(gps["GPSTimeStamp"], F.lit(i))) for i in range(3))
    seconds = F.format_string("%06.3f", s)
    stamp = F.concat(gps["GPSDateStamp"], F.lit("T"), F.lpad(h.cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("int").cast("string"), 2, "0"), F.lit(":"), seconds)
    below = F.when(rational(gps["GPSAltitudeRef"]) == 1, -1).otherwise(1)
    return F.struct(
        degrees("GPSLatitude").alias("latitude"), degrees("GPSLongitude").alias("longitude"), (rational(gps["GPSAltitude"]) * below).alias("altitude_m"),
        rational(gps["GPSImgDirection"]).alias("image_direction_degrees"), F.regexp_replace(F.regexp_replace(stamp, "0+$", ""), r"\.$", "").alias("timestamp"),
    )


def camera_identity(make: Column, model: Column) -> Column:
    """Aggregate: struct<make, model>, trimmed and without case, of a group of files; null unless exactly one is named."""
    plain = lambda c: casefold(F.trim(F.coalesce(c, F.lit(""))))
    camera = F.when((plain(make) != "") | (plain(model) != ""), F.struct(plain(make).alias("make"), plain(model).alias("model")))
    return F.when(F.min(camera) == F.max(camera), F.min(camera))
