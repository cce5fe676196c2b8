"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over the progress of a training run (0 to
1): straight lines between points.  Its integral is the source's share; shares
become targets, no target above ``most`` times the words that the source has.
A source reads its documents in the order of a hash, again from the start when
they are used up, until its target is met; the cumulative demand of the
schedule, inverted, gives each reading its place in the run, and a sort by
ranges of that place puts all readings of all sources into one order.

Running totals are the only thing here that depends on an order.  They come
from a table written in ranges (:func:`running_total`): a source with a third of
all rows, or many rows that are equal, is spread over tasks like any other.

Defined results: a null or empty text has size 0 and is not read; a null source
is one of the sources, the last; rows that repeat a doc_id are documents of
their own, equal ones interchangeable; a null doc_id is ordered like an empty
one; a very long text is read like others, the one on a source's target in part;
ties of the order go by source, hash, doc_id, size and reading; extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: What a word is, for sizes.
WORD = r"[^\x20\x09-\x0D]+"


def running_total(df: DataFrame, group: list[str], order: list, value: Column, name: str, out: str, scratch: Scratch) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, by ``order``, in the same ``group`` as column ``out``.

    Rows are written in ranges of group and order; a range holds its own totals,
    and what lies before it is the sum over earlier ranges.  Tasks hold a range
    each; the window over ranges sees one row for each range of a group.
    """
    keys = [F.col(c).asc_nulls_last() for c in group]
    ranged = df.repartitionByRange(*keys, *order).select("*", F.spark_partition_id().alias("__range"), value.cast("long").alias("__value"))
    rows = scratch.save(ranged, name)
    sums = rows.groupBy("__range", *group).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__{c}") for c in group], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group], F.col("__range") == F.col("__r"))
    within = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("__value").over(within), F.lit(0))
    return rows.withColumn("__here", here).join(before, same).select(*df.columns, (F.col("__before") + F.col("__here")).alias(out))


def integrated(points: Column) -> Column:
    """Points array<struct<at, weight>> of a schedule as segments with the integral before each: at, weight, slope, before, upto."""
    sorted_points = F.array_sort(points)
    spans = F.zip_with(F.slice(sorted_points, 1, F.size(points) - 1), F.slice(sorted_points, 2, F.size(points) - 1), lambda a, b: F.struct(
        a["at"].alias("at"), a["weight"].alias("weight"), ((b["weight"] - a["weight"]) / (b["at"] - a["at"])).alias("slope"), ((a["weight"] + b["weight"]) / 2 * (b["at"] - a["at"])).alias("area")))
    start = F.array().cast("array<struct<at:double,weight:double,slope:double,before:double,upto:double>>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["upto"], F.lit(0.0))
    return F.aggregate(spans, start, lambda acc, s: F.concat(acc, F.array(F.struct(
        s["at"].alias("at"), s["weight"].alias("weight"), s["slope"].alias("slope"), last(acc).alias("before"), (last(acc) + s["area"]).alias("upto")))))


def place(segments: Column, demand: Column) -> Column:
    """The progress at which the integral of a schedule reaches ``demand``: the root of a quadratic in its segment."""
    inside = F.filter(segments, lambda s: demand < s["upto"])
    s = F.coalesce(F.try_element_at(inside, F.lit(1)), F.element_at(segments, -1))
    left = F.greatest(demand - s["before"], F.lit(0.0))
    # 2c / (b + sqrt(b^2 + 2ac)) also holds for a level or zero start
    root = s["weight"] + F.sqrt(F.greatest(s["weight"] * s["weight"] + 2 * s["slope"] * left, F.lit(0.0)))
    return s["at"] + F.when(left > 0, 2 * left / root).otherwise(0.0)


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources(source_size, weight, ..) with ``target``: ``share`` of all words dealt by weight, none above ``most`` times its size.

    The excess of sources above is dealt again until none is above.  Each round
    is one aggregate; only three numbers reach the driver.
    """
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    size, weight, level = F.col("source_size"), F.col("weight"), None
    while True:
        full = F.lit(False) if level is None else F.lit(level[0]) * weight / F.lit(level[1]) > most * size
        r = sources.agg(F.coalesce(F.sum(F.when(full, most * size)), F.lit(0.0)).alias("met"), F.sum(F.when(~full, weight)).alias("weight"), F.count_if(full).alias("n")).head()
        if not r["weight"]:  # every source is at its most
            return sources.withColumn("target", most * size)
        if level is not None and r["n"] == level[2]:
            return sources.withColumn("target", F.when(full, most * size).otherwise(F.lit(level[0]) * weight / F.lit(level[1])))
        level = (share * total - r["met"], r["weight"], r["n"])


def measured(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row, doc_id, source, size, code of every document: texts are read once, the table has numbers only."""
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("code"))
    return scratch.save(sized.select(F.monotonically_increasing_id().alias("row"), "*"), "sized")


def curriculum(sized: DataFrame, schedules: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(sources, readings) for documents (row, doc_id, source, size, code) and schedules (source, points).

    sources: source, source_size, weight (the schedule's integral), segments,
    target.  readings: row, doc_id, source, reading (from 0), length (words of the
    document taken from its start), at (place in the run, 0 to 1), position (words of the run before it).
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = schedules.select(F.col("source").alias("__s"), integrated(F.col("points")).alias("segments"))
    sources = sizes.join(known, F.col("source").eqNullSafe(F.col("__s"))).select("source", "source_size", "segments", F.element_at("segments", -1)["upto"].alias("weight"))
    sources = scratch.save(targets(scratch.save(sources, "weighed"), share, most), "sources")

    order = ["code", F.col("doc_id").asc_nulls_first(), "size", "row"]
    placed = running_total(sized.filter("size > 0"), ["source"], order, F.col("size"), "placed", "offset", scratch)
    facts = sources.select(F.col("source").alias("__s"), "source_size", "segments", "weight", "target")
    joined = placed.join(facts, F.col("source").eqNullSafe(F.col("__s")))
    wanted = F.floor("target").cast("long")
    rounds = joined.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int"))).alias("reading"))
    start = rounds.withColumn("start", F.col("reading") * F.col("source_size") + F.col("offset"))
    read = start.withColumn("length", F.least(F.col("size"), wanted - F.col("start"))).filter("length > 0")
    at = place(F.col("segments"), F.col("start") * F.col("weight") / F.col("target"))
    timed = read.select("row", "doc_id", "source", "code", "size", "reading", "length", at.alias("at"))
    ties = ["at", F.col("source").asc_nulls_last(), "code", F.col("doc_id").asc_nulls_first(), "size", "reading", "row"]
    return sources, running_total(timed, [], ties, F.col("length"), "timed", "position", scratch)


def repeating_schedules(sized: DataFrame, weights: list[float], shapes: list[tuple[float, float]], scratch: Scratch) -> DataFrame:
    """(source, points) for all sources by code point, null last: weights in turn, each on a line from ``a`` to ``b`` times its weight."""
    names = running_total(sized.select("source").distinct(), [], [F.col("source").asc_nulls_last()], F.lit(1), "names", "rank", scratch)
    number = (F.col("rank") % len(weights)).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), number + 1)
    point = lambda at, end: F.struct(F.lit(float(at)).alias("at"), (of(weights) * of([s[end] for s in shapes])).alias("weight"))
    return names.select("source", F.array(point(0, 0), point(1, 1)).alias("points"))


#: Weights of the sources in turn; the first kind fades, the second grows, the third stays level.
WEIGHTS, SHAPES = [3, 1, 2], [(1.5, 0.5), (0.5, 1.5), (1.0, 1.0)]


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what the mix takes of it, how often and where in the run it is read first."""
    scratch = Scratch(spark, "mixing")
    sized = measured(table(spark, sf_dir, "documents"), scratch)
    sources, readings = curriculum(sized, repeating_schedules(sized, WEIGHTS, SHAPES, scratch), scratch)
    taken = readings.groupBy(F.col("row").alias("__row")).agg(F.sum("length").alias("taken"), F.count("*").alias("readings"), F.min("position").alias("first_position"))
    facts = sources.select(F.col("source").alias("__s"), "source_size", "target")
    return (
        sized.join(taken, F.col("row") == F.col("__row"), "left").join(facts, F.col("source").eqNullSafe(F.col("__s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("readings", F.lit(0)).cast("long").alias("readings"), "first_position")
    )


#: Targets without a loop: a source is at its most if the level at which it gets there deals no more than all that is wanted.
SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS code,
    CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
names AS (SELECT source, sum(size) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM sized GROUP BY source),
weighed AS (SELECT source, CAST(s AS BIGINT) AS s, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, CASE k WHEN 0 THEN 4.5 WHEN 1 THEN 0.5 ELSE 2.0 END AS a, CASE k WHEN 0 THEN 1.5 WHEN 1 THEN 1.5 ELSE 2.0 END AS b FROM names),
levels AS (SELECT i.source, sum(least(2 * j.s * i.w, 2 * i.s * j.w)) * 2 < (SELECT sum(s) FROM weighed) * 3 * any_value(i.w) AS met FROM weighed i CROSS JOIN weighed j GROUP BY i.source),
marked AS (SELECT w.*, l.met FROM weighed w JOIN levels l ON w.source IS NOT DISTINCT FROM l.source),
rest AS (SELECT 1.5::DOUBLE * sum(s) - coalesce(sum(2 * s) FILTER (WHERE met), 0) AS words, sum(w) FILTER (WHERE NOT met) AS weight FROM marked),
sources AS (SELECT m.source, s, a::DOUBLE AS a, (b - a)::DOUBLE AS slope, w::DOUBLE AS w, CASE WHEN met THEN 2.0::DOUBLE * s ELSE words::DOUBLE * w::DOUBLE / weight::DOUBLE END AS target FROM marked m CROSS JOIN rest),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY code, doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM sized WHERE size > 0),
starts AS (SELECT p.*, o.s, o.a, o.slope, o.w, o.target, r.reading, r.reading * o.s + p.o AS start
  FROM placed p JOIN sources o ON p.source IS NOT DISTINCT FROM o.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS reading) r),
readings AS (SELECT *, least(size, CAST(floor(target) AS BIGINT) - start) AS length, start * w / target AS demand FROM starts WHERE CAST(floor(target) AS BIGINT) > start),
timed AS (SELECT *, CASE WHEN demand > 0 THEN 2 * demand / (a + sqrt(a * a + 2 * slope * demand)) ELSE 0.0 END AS moment FROM readings),
run AS (SELECT *, coalesce(sum(length) OVER (ORDER BY moment, source NULLS LAST, code, doc_id NULLS FIRST, size, reading, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM timed),
taken AS (SELECT row, sum(length)::BIGINT AS taken, count(*) AS readings, min(position) AS first_position FROM run GROUP BY row)
SELECT d.doc_id, d.size, o.s AS source_size, o.target, coalesce(t.taken, 0)::BIGINT AS taken, coalesce(t.readings, 0)::BIGINT AS readings, t.first_position
FROM sized d JOIN sources o ON d.source IS NOT DISTINCT FROM o.source LEFT JOIN taken t USING (row)
"""
