"""Near-duplicate lines across documents by a segment-partition edit join.

Lines within ``edits`` edits of each other are found exactly: a line is cut into
``edits + 1`` segments of even length, of which one must survive in a partner.
Segments go into an index keyed by (line length, segment number, characters);
a line probes it with the substrings that can line up with a segment of an
equal or shorter line, and only those (selection by position and length
difference).  Only keys that several lines share bring their lines along; pairs
that Spark's own bounded distance rejects never leave the join on the key, so
that a family of lines with one common segment makes no more rows than it has
similar pairs.  What is left is verified with a banded bit-parallel edit
distance, folded over the characters.

A line is named by two 64-bit hashes, so unequal lines do not fall together.

A class is what such pairs connect; only its first line, by (doc_id, line
number), stays.  Lines under ``least`` characters (after trimming blanks) are
never removed.  Only DataFrame functions are used.

Defined results: a null text has no lines and stays null; an empty one is one
empty line; line numbers count from 0; doc_id is the key, and rows that repeat
one are one document (their lines fall together, the text is taken as is); a row
with a null doc_id is kept whole and makes no other line go; extra columns pass
through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .graph import components

EDITS = 2
LEAST = 20


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, line_no, line, id1, id2, size of every line that is long enough."""
    rows = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "line_no", F.trim("raw").alias("line")).withColumn("size", F.length("line")).filter(F.col("size") >= least)
    # the lowest bit of the second name is left to the marks of the index
    return rows.withColumn("id1", F.xxhash64("line")).withColumn("id2", F.xxhash64("size", "line").bitwiseAND(F.lit(-2).cast("long")))


def _segment(size: Column, i: int, n: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of n of a line: the last ones are longer by one."""
    short = F.call_function("div", size, F.lit(n)).cast("int")
    longer = size - short * n
    before = F.greatest(F.lit(i) - (F.lit(n) - longer), F.lit(0))
    return (short * i + before + 1).cast("int"), (short + F.when(F.lit(i) >= F.lit(n) - longer, 1).otherwise(0)).cast("int")


def index_keys(line: Column, size: Column, edits: int) -> Column:
    keys = []
    for i in range(edits + 1):
        start, length = _segment(size, i, edits + 1)
        keys.append(F.xxhash64(size, F.lit(i), F.substring(line, start, length)))
    return F.array(*keys)


def probe_keys(line: Column, size: Column, edits: int) -> Column:
    """Substrings that can be segment i of a line shorter by ``less``: as many edits as i to its left, at most edits - i to its right."""
    keys = []
    for less in range(edits + 1):
        other = size - less
        for i in range(edits + 1):
            start, length = _segment(other, i, edits + 1)
            for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                keys.append(F.xxhash64(other, F.lit(i), F.substring(line, start + move, length)))
    return F.array(*keys)  # a repeated substring gives a repeated key


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings (of at least ``edits`` characters) are within ``edits`` edits.

    One word of 2 * edits + 1 bits holds the vertical differences of the band
    around the diagonal; bit i of column j stands for row j - edits + i.  The
    fold follows the band's lowest diagonal down to the last row and then that
    row to the last column.
    """
    w = 2 * edits + 1
    full = (1 << w) - 1
    long = lambda x: F.lit(x).cast("long")
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  binds a value to a name
    pad = F.array_repeat(F.lit(""), edits)
    start = F.struct(long(full & ~((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
    parts = F.struct(F.concat(pad, F.split(a, ""), pad).alias("rows"), F.split(b, "").alias("columns"), F.length(a).alias("m"))

    def match(parts: Column, j: Column) -> Column:
        c, out = F.get(parts["columns"], j - 1), long(0)
        for i in range(w):
            out = out.bitwiseOR(F.when(F.get(parts["rows"], j - 1 + i) == c, long(1 << i)).otherwise(long(0)))
        return out

    def step(parts: Column, s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = lambda x: (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(long(full))
        return once(match(parts, j), lambda x: once(d0(x), lambda y: _advance(s, y, j, parts["m"], edits, full, long)))

    fold = lambda parts: F.aggregate(F.sequence(F.lit(1), F.length(b)), start, lambda s, j: step(parts, s, j), lambda s: s["d"])
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(once(parts, fold) <= edits)


def _advance(s: Column, d0: Column, j: Column, m: Column, edits: int, full: int, long) -> Column:
    vp, vn = s["vp"], s["vn"]
    hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(long(full))
    hn = d0.bitwiseAND(vp)
    down = F.shiftrightunsigned(d0, 1)
    row = F.greatest(m - j + edits, F.lit(0))  # bit of the last row, once the band has reached it
    bit = lambda v, i: F.call_function("shiftrightunsigned", v, i).bitwiseAND(long(1)).cast("int")
    d = F.when(j <= m - edits, s["d"] + 1 - bit(d0, F.lit(2 * edits))).otherwise(s["d"] + bit(hp, row) - bit(hn, row))
    return F.struct(
        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(long(full)).alias("vp"),
        down.bitwiseAND(hp).alias("vn"),
        d.alias("d"),
    )


ID = ["id1", "id2"]


def similar_lines(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """a, b (structs of both names): different lines within ``edits`` edits."""
    # equal lines fall together before their keys are made, so no (key, line) comes twice
    lines = lines_of(docs, max(least, edits + 1)).select("line", *ID, "size").distinct()
    own = F.array_distinct(index_keys(F.col("line"), F.col("size"), edits))
    lines = lines.select(*ID, own.alias("own"), F.array_distinct(probe_keys(F.col("line"), F.col("size"), edits)).alias("probe"))
    # a line's own segments are probes as well; the lowest bit of id2 marks them
    mark = lambda keys, bit: F.transform(keys, lambda k: F.struct(k.alias("key"), F.col("id2").bitwiseOR(F.lit(bit).cast("long")).alias("id2")))
    keyed = lines.select("id1", F.explode(F.concat(mark(F.col("own"), 1), mark(F.array_except("probe", "own"), 0))).alias("k")).select("k.key", "id1", "k.id2")
    w = Window.partitionBy("key").orderBy(*ID)
    shared = keyed.withColumn("before", F.lag("id1").over(w)).withColumn("after", F.lead("id1").over(w)).filter("before is not null or after is not null")
    shared = shared.select("key", "id1", F.col("id2").bitwiseAND(F.lit(-2).cast("long")).alias("id2"), (F.col("id2").bitwiseAND(F.lit(1).cast("long")) == 1).alias("own"))
    shared = scratch.save(shared, "line-keys")
    scratch.release()
    texts = lines_of(docs, least).select(*ID, "line").join(shared.select(*ID).distinct(), ID, "left_semi").dropDuplicates(ID)
    held = scratch.save(shared.join(texts, ID), "line-texts")
    scratch.drop("line-keys")
    scratch.release()
    name = F.struct(*ID)
    index = held.filter("own").select("key", name.alias("x"), F.col("line").alias("tx"))
    probe = held.select(F.col("key").alias("met"), name.alias("y"), F.col("line").alias("ty"))
    # one condition, cheap tests first: as a filter the verification would be put before them
    close = (F.abs(F.length("tx") - F.length("ty")) <= edits) & (F.levenshtein("tx", "ty", edits) >= 0) & within_edits(F.col("tx"), F.col("ty"), edits)
    met = index.join(probe, (F.col("key") == F.col("met")) & (F.col("x") != F.col("y")) & close)
    pairs = scratch.save(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "line-pairs")
    scratch.drop("line-texts")
    scratch.release()
    return pairs


def removed_lines(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, exact, near: numbers of the lines that go because an equal or a similar line stands earlier."""
    at = F.struct("doc_id", "line_no")
    places = scratch.save(lines_of(docs, least).select(*ID, "doc_id", "line_no"), "places")
    firsts = places.groupBy(*ID).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    pairs = similar_lines(docs, scratch, edits, least)
    classes = scratch.save(components(pairs, scratch, "lines"), "line-classes").select("node.id1", "node.id2", "component")
    touched = firsts.join(classes, ID, "left").filter("n > 1 or component is not null").withColumn("class", F.coalesce("component", F.struct(*ID)))
    touched = scratch.save(touched.select(*ID, "first", "class"), "touched")
    heads = touched.groupBy("class").agg(F.min("first").alias("head"))
    fate = touched.join(heads, "class").select(*ID, "first", "head")
    gone = places.join(fate, ID).filter(at != F.col("head")).select("doc_id", "line_no", (at != F.col("first")).alias("copy"))
    return gone.groupBy("doc_id").agg(F.collect_set(F.when(F.col("copy"), F.col("line_no"))).alias("exact"), F.collect_set(F.when(~F.col("copy"), F.col("line_no"))).alias("near"))


def without(lines: Column, gone: Column) -> Column:
    """The array less the elements at these places (from 0, those beyond its end mean nothing): the stretches between them, in order."""

    def cut(x: Column) -> Column:
        at = F.array_sort(F.filter(x["gone"], lambda i: i < F.size(x["lines"])))
        after, before = F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(x["lines"])))
        return F.flatten(F.zip_with(after, before, lambda a, b: F.slice(x["lines"], a + 2, b - a - 1)))

    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), cut), 1)


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with ``text`` rid of repeated lines, and n_lines, n_exact, n_near."""
    gone = removed_lines(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "lines"), edits, least)
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("exact").alias("__exact"), F.col("near").alias("__near"))
    joined = docs.join(gone, docs["doc_id"] == F.col("__d"), "left")
    # rows that repeat a doc_id share the numbers of lost lines, and may be shorter than those
    lines, drop = F.split(docs["text"], "\n"), F.array_distinct(F.concat("__exact", "__near"))
    kept = F.when(F.col("__d").isNull(), docs["text"]).when(docs["text"].isNotNull(), F.array_join(without(lines, drop), "\n"))
    count = lambda c: F.when(F.col("__d").isNull(), 0).otherwise(F.size(c)).cast("long")
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_exact", "n_near")],
        kept.alias("text"),
        F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        count("__exact").alias("n_exact"),
        count("__near").alias("n_near"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_exact", "n_near", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
