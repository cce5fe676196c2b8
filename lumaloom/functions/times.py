"""Column builders for capture times and their semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of capture time that name an instant.
ABSOLUTE = ["exif_offset", "aware", "container_metadata"]
#: Days from year 1 to 1970 (day 1 is the first of January of year 1).
DAYS_TO_1970 = 719163
ZONE = r"\d(Z|z|([+-])(\d\d):?(\d\d)(?::?(\d\d))?)$"
WALL = r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6})\d*)?"


def wall_clock_us(value: Column) -> Column:
    """Microseconds of the displayed components, whatever the offset; null without a time part or when out of range."""
    part = lambda i: F.regexp_extract(value, WALL, i)
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("."), F.rpad(part(7), 6, "0"))
    return F.when(value.rlike(WALL), F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))))


def completed(value: Column) -> Column:
    """ISO text whose time part is missing, or stops at hours or minutes, with what is left out as zeros."""
    day = r"^(\d{4}-\d\d-\d\d"
    for shape, rest in ((")$", "T00:00:00"), (r"[T ]\d\d)(?=$|[Zz+-])", ":00:00"), (r"[T ]\d\d:\d\d)(?=$|[Zz+-])", ":00")):
        value = F.regexp_replace(value, day + shape, "$1" + rest)
    return value


def precision_us(value: Column) -> Column:
    """Smallest step that the fraction's digits can show."""
    digits = F.least(F.length(F.regexp_extract(value, r"\.(\d+)", 1)), F.lit(6))
    return F.when(value.isNotNull(), F.floor(F.lit(1_000_000) / F.pow(F.lit(10), digits)).cast("long"))


def capture_seconds(value: Column, kind: Column) -> Column:
    """Seconds on the axis of the value's semantics.

    Absolute kinds are seconds since 1970 in UTC and need an offset; local ones
    count from the first day of year 1, by the displayed components, and must have
    none.  A missing time part is midnight.  Other kinds and unparsable values are null.
    """
    value = completed(value)
    wall, zone = wall_clock_us(value) / 1e6, F.regexp_extract(value, ZONE, 1)
    part = lambda i: F.coalesce(F.regexp_extract(value, ZONE, i).try_cast("int"), F.lit(0))
    offset = F.when(F.upper(zone) == "Z", 0).otherwise(F.when(F.regexp_extract(value, ZONE, 2) == "-", -1).otherwise(1) * (part(3) * 3600 + part(4) * 60 + part(5)))
    return F.when(kind.isin(ABSOLUTE) & (zone != ""), wall - offset).when((kind == "exif_local_unknown") & (zone == ""), wall + DAYS_TO_1970 * 86400)


def semantics(kind: Column) -> Column:
    """Absolute and local times are never comparable."""
    return F.when(kind.isin(ABSOLUTE), "absolute").otherwise("local")


def exif_time(value: Column, subsecond: Column, offset: Column) -> Column:
    """'Y:m:d H:M:S' with sub-seconds and offset as ISO text; unparsable values stay as they are."""
    pattern = r"^(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)$"
    iso = F.regexp_replace(value, pattern, "$1-$2-$3T$4")
    fraction = F.when(subsecond.rlike(r"^\s*\d+"), F.concat(F.lit("."), F.substring(F.trim(subsecond), 1, 6))).otherwise("")
    zone = F.when(offset.rlike(r"^[+-]\d\d:\d\d$"), offset).when(F.upper(offset) == "Z", "+00:00").otherwise("")
    return F.when(value.rlike(pattern), F.concat(iso, fraction, zone)).otherwise(value)


def exif_moment(exif: Column) -> Column:
    """struct<value, kind, precision_us> of a map of EXIF text: DateTimeOriginal, else DateTimeDigitized, else DateTime; null without any.

    Sub-seconds are the digits of the same date's field, its offset may stand in
    from the original's; the precision is what the sub-seconds can show, a second without them.
    """
    get = lambda name: F.try_element_at(exif, F.lit(name))
    fields = F.lit(None)
    for suffix in ("", "Digitized", "Original"):
        digits = F.substring(F.regexp_replace(F.coalesce(get(f"SubSecTime{suffix}"), get(f"SubsecTime{suffix}"), F.lit("")), r"\D", ""), 1, 6)
        offset = F.coalesce(F.nullif(get(f"OffsetTime{suffix}"), F.lit("")), get("OffsetTimeOriginal"))
        date = get(f"DateTime{suffix}")
        fields = F.when(date.isNotNull(), F.struct(date.alias("date"), digits.alias("digits"), offset.alias("offset"))).otherwise(fields)

    def parsed(f: Column) -> Column:
        # sub-seconds of nothing but zeros are not shown
        value = exif_time(f["date"], F.when(f["digits"].rlike("[1-9]"), F.rpad(f["digits"], 6, "0")), f["offset"])
        zoned = f["date"].rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$") & (f["offset"].rlike(r"^[+-]\d\d:\d\d$") | (F.upper(f["offset"]) == "Z"))
        precision = F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(6, -1, -1)]), F.length(f["digits"]) + 1)
        return F.struct(value.alias("value"), F.when(zoned, "exif_offset").otherwise("exif_local_unknown").alias("kind"), precision.alias("precision_us"))

    # the fields are chosen once and parsed once
    return F.get(F.transform(F.filter(F.array(fields), lambda f: f.isNotNull()), parsed), F.lit(0))
