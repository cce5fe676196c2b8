"""Exact Jaccard similarity join over word shingles in a metric space.

The Jaccard distance is a metric, but nearly all documents are at distance 1
from any pivot, where the triangle inequality says nothing.  So the space is cut
step by step:

1. Documents that could be within the threshold share one of their first
   ``n - ceil(t n) + 1`` shingles in a common order.  Each such shingle is a
   cell; documents that share no cell are known to be far apart.  The order puts
   frequent shingles last, so that cells stay small where documents only share
   passages.
2. In a cell the document with the least before the shared shingle is the pivot.
   The cells of one pivot are its region.  Distances to the pivot are exact;
   documents in its ball are linked to it, and linked documents are one
   component.  A region whose documents are one component is finished.
3. A region that is not is cut again by size and, if it is large, into Voronoi
   regions: every document goes to the nearest of the elected pivots, and those
   near a border go as well to each region that the window of the triangle
   inequality leaves open.  Distances here are Jaccard distances of folded sets
   (shingles modulo a power of two, as bits), where a link has a bounded distance,
   so nothing is lost.  The same cut is repeated inside a task.
4. What may link in such a region is joined exactly on the full sets.

Only pairs of different components are looked at: the links returned connect all
that the full join connects, but links inside a component that is already known
are neither sought nor counted, because their number is the square of a group.

Documents with equal sets are one class, named by one of its rows; classes are
compared, never copies.

Defined results: null and empty texts, or texts without words, have no shingles
and link with nothing; fewer words than ``k`` are one shingle; rows that repeat a
doc_id are one document and so one component; a row with a null doc_id links
with nothing and has a null component; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, whole_groups
from .graph import components

K = 5
#: Similarity in per cent: a link needs 100 * intersection >= 80 * union.
PERCENT = 80
#: Shingles in more than so many prefixes go to the end of the order ...
OFTEN = 32
#: ... the most frequent of them, at most so many (8 bytes each are broadcast).
MOST_OFTEN = 1 << 20
#: A cell with more rows finds its pivot by a partial aggregate, not in one task.
CELL = 4096
#: Members of a pivot that one task verifies together.
BLOCK = 512
#: A region with more classes, or more shingles in all, is dealt to several tasks.
HOT = 8192
HEAVY = 1 << 21
#: Regions inside a task that are compared directly.
LEAF = 512
#: Bits of a folded set for each shingle, at least.
FOLD = 4

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ROOM = {"n": 0}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MUL
    return h ^ (h >> np.uint64(32))


def _tables(n: int):
    if _ROOM["n"] < n:
        from .suffix_dedup import _powers

        _ROOM.update(n=n, power=_powers(n, _MUL), inverse=_powers(n, np.uint64(pow(int(_MUL), -1, 1 << 64))))
    return _ROOM["power"], _ROOM["inverse"]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str | None], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and where each text's begin (one more bound at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    power, inverse = _tables(len(data) + 1)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    first, last = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    word = _mix((total[last] - total[first]) * inverse[first]) | np.uint64(1)
    doc = np.searchsorted(begin, first, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(n_words)])

    def fold(start: np.ndarray, m: int) -> np.ndarray:
        h = np.full(len(start), m, dtype=np.uint64)
        for i in range(m):
            h = h * _MUL + word[start + i]
        return _mix(h)

    found_doc, found = [], []
    full = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.array([], dtype=np.int64)
    found_doc.append(doc[full])
    found.append(fold(full, k))
    for m in range(1, k):
        few = np.flatnonzero(n_words == m)
        found_doc.append(few)
        found.append(fold(at[few], m))
    d, h = np.concatenate(found_doc), np.concatenate(found)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    d, h = d[keep], h[keep]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


def batches_of(texts: list, size: int = 1 << 19):
    """Index ranges of texts of about ``size`` characters together."""
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b] or "") <= size):
            n += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


def small(batches, rows: int = 256):
    """Slices of Arrow batches, so that few rows at a time become Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _names_of(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names for each set: equal sets have equal names."""
    n = np.diff(begin)
    if not len(h):
        return np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)

    def total(x: np.ndarray) -> np.ndarray:
        t = np.concatenate([[np.uint64(0)], np.cumsum(x)])
        return t[begin[1:]] - t[begin[:-1]]

    one, two = total(_mix(h * _MIX)), total(_mix(h ^ _MUL))
    return _mix(one + n.astype(np.uint64)).view(np.int64), _mix(two * _MUL + n.astype(np.uint64)).view(np.int64)


def level(n: np.ndarray) -> np.ndarray:
    """Power of two of the bits of a folded set of n shingles."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(n, 1) * FOLD))).astype(np.int64)


def folded(h: np.ndarray) -> bytes:
    """Bit ``x mod size`` for every shingle x, as bytes."""
    size = 1 << int(level(np.array([len(h)]))[0])
    bits = np.zeros(size, dtype=np.uint8)
    bits[(h & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unfolded(column, power: int) -> np.ndarray:
    """Folded sets as rows of 0 and 1 with 2**power columns; longer ones are folded further."""
    out = np.zeros((len(column), 1 << power), dtype=np.float32)
    for i, x in enumerate(column):
        bits = np.unpackbits(np.frombuffer(x, dtype=np.uint8), bitorder="little")
        out[i] = bits.reshape(-1, 1 << power).max(0)
    return out


def sets_and_prefixes(docs: DataFrame, often: np.ndarray | None, k: int = K) -> DataFrame:
    """row, doc_id, name1, name2, n, prefix (shingles in the common order) and late (how many of them are frequent), bits of every document.

    ``row`` is a number of its own for every row; it holds only in a written copy of the result.
    """

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for a, b in batches_of(texts):
                h, begin = shingle_sets(texts[a:b], k)
                n = np.diff(begin)
                one, two = _names_of(h, begin)
                bits = [folded(h[s:e]) for s, e in zip(begin[:-1], begin[1:], strict=True)]
                late = np.zeros(len(h), dtype=np.int64)
                if often is not None and len(often):
                    i = np.searchsorted(often_sorted, h)
                    i[i == len(often_sorted)] = 0
                    late = np.where(often_sorted[i] == h, often_rank[i] + 1, 0)
                    order = np.lexsort((h, late, np.repeat(np.arange(len(n)), n)))
                    h, late = h[order], late[order]
                take = prefix_length(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array((part << 33) + row + np.arange(b - a), pa.int64()), batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(one), pa.array(two), pa.array(n.astype(np.int32)),
                    pa.array([h[s : s + t].view(np.int64) for s, t in zip(begin[:-1], take, strict=True)], pa.list_(pa.int64())),
                    pa.array([int(np.count_nonzero(late[s : s + t])) for s, t in zip(begin[:-1], take, strict=True)], pa.int32()), pa.array(bits, pa.binary()),
                ], names=["row", "doc_id", "name1", "name2", "n", "prefix", "late", "bits"])
                row += b - a

    if often is not None and len(often):
        by = np.argsort(often, kind="stable")
        often_sorted, often_rank = often[by], by.astype(np.int64)
    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, name1 long, name2 long, n int, prefix array<long>, late int, bits binary")


def prefixes(docs: DataFrame, k: int = K) -> DataFrame:
    """prefix (shingles in plain hash order) of every document."""

    def run(batches):
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for a, b in batches_of(texts):
                h, begin = shingle_sets(texts[a:b], k)
                take = prefix_length(np.diff(begin))
                yield pa.RecordBatch.from_arrays([pa.array([h[s : s + t].view(np.int64) for s, t in zip(begin[:-1], take, strict=True)], pa.list_(pa.int64()))], names=["prefix"])

    return docs.select("text").mapInArrow(run, "prefix array<long>")


def frequent_shingles(docs: DataFrame, often: int = OFTEN, most: int = MOST_OFTEN) -> np.ndarray:
    """Shingles in more than ``often`` prefixes under the plain hash order, rarest first; counted over all documents."""
    keys = prefixes(docs).select(F.explode("prefix").alias("s"))
    found = keys.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > often).orderBy(F.desc("n"), "s").limit(most)
    got = found.toPandas()
    return got["s"].to_numpy(dtype=np.int64)[::-1].view(np.uint64).copy() if len(got) else np.array([], dtype=np.uint64)


def could_link(n_a, at_a, n_b, at_b, percent: int = PERCENT):
    """Whether sets that first meet at these places of their orders can reach the threshold: I >= t (n_a + n_b - I)."""
    most = F.lit(1) + F.least(n_a - 1 - at_a, n_b - 1 - at_b)
    return (100 + percent) * most >= percent * (n_a + n_b)


def within_reach(docs: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs without most of those whose doc_id is not wanted, so that their texts cross no exchange.

    One bit a wanted id in 2**20 words of 64 bits: at most MOST_OFTEN rows are
    broadcast, whatever the number of ids.  A join by the id itself must follow.
    """
    word, bit = F.expr("shiftrightunsigned(xxhash64(doc_id), 44)"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")
    words = scratch.save(wanted.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits")), name)
    met = docs.withColumn("__word", word).join(F.broadcast(words), "__word")
    return met.filter(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with the exact intersection: a, b, n_a, n_b, common.

    The members of a pivot ``a`` are dealt out in blocks; each block gets the
    pivot's set once.
    """
    sized = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(sized, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK)).cast("int")).drop("m")
    blocks = dealt.select("a", "block").distinct()
    own = blocks.join(sets.withColumnRenamed("class", "a"), "a").select("a", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), "items")
    rest = dealt.join(sets.withColumnRenamed("class", "b"), "b").select("a", "block", F.lit(1).alias("kind"), "b", "items")

    def run(batches):
        pivot, items = None, None
        for pdf in batches:
            rows = []
            for a, kind, b, x in zip(pdf["a"].tolist(), pdf["kind"].tolist(), pdf["b"].tolist(), pdf["items"], strict=True):
                x = np.frombuffer(x, dtype=np.uint64)
                if not kind:
                    pivot, items = a, x
                    continue
                assert pivot == a
                small, large = (x, items) if len(x) < len(items) else (items, x)
                i = np.searchsorted(large, small)
                i[i == len(large)] = 0
                rows.append((a, b, len(items), len(x), int(np.count_nonzero(large[i] == small))))
            yield pd.DataFrame(rows, columns=["a", "b", "n_a", "n_b", "common"], dtype="int64")

    return own.unionByName(rest).repartition("a", "block").sortWithinPartitions("a", "block", "kind").select("a", "kind", "b", "items").mapInPandas(run, "a long, b long, n_a long, n_b long, common long")


def divided(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows(cell, ..., often): those of small cells, and those of large ones.

    Frequent shingles were counted under the plain order; with those at its end
    other shingles come into the prefixes, so the cells are counted again here.
    """
    plain, large = rows.filter("not often").drop("often"), rows.filter("often").drop("often")
    found = scratch.save(plain.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).select("cell"), "large-cells")
    n = found.count()
    if n:
        found = F.broadcast(found) if n <= MOST_OFTEN else found
        large = large.unionByName(plain.join(found, "cell", "left_semi"))
        plain = plain.join(found, "cell", "left_anti")
    return plain, large


def stars(reps: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """pivot, class, n, near, fits: the regions.  ``near`` if a place of both allows a link with the pivot, ``fits`` if one with another row of the cell.

    Large cells find their pivot by a partial aggregate and a join, which
    adaptive execution splits; the others have at most ``CELL`` rows.
    """
    low = (1 << 32) - 1
    # one long for (at, n): the order of a cell, and narrower rows to shuffle
    rows = reps.select("class", "n", (F.size("prefix") - F.col("late")).alias("first_late"), F.posexplode("prefix").alias("at", "cell"))
    rows = rows.select("cell", "class", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("key"), (F.col("at") >= F.col("first_late")).alias("often"))
    size = F.col("key").bitwiseAND(F.lit(low)).cast("int")
    w = Window.partitionBy("cell")
    ordered = w.orderBy("key", "class")
    small_cells, often = divided(rows, scratch)
    rare = small_cells.withColumn("pivot", F.first(F.struct("key", "class")).over(ordered)).withColumn("smallest", F.min(size).over(w))
    heads = often.groupBy("cell").agg(F.min(F.struct("key", "class")).alias("pivot"), F.min(size).alias("smallest"))
    both = rare.unionByName(often.join(heads, "cell"))
    n_of, at_of = (lambda c: F.col(c).bitwiseAND(F.lit(low)).cast("int")), (lambda c: F.shiftright(F.col(c), 32).cast("int"))
    met = both.filter("class != pivot.class").select("class", n_of("key").alias("n"), at_of("key").alias("at"), F.col("pivot.class").alias("pivot"), n_of("pivot.key").alias("pivot_n"), at_of("pivot.key").alias("pivot_at"), "smallest")
    # a row whose place leaves too little for even the smallest set of its cell can link with none of it
    fits = (100 + percent) * (F.col("n") - F.col("at")) >= percent * (F.col("n") + F.col("smallest"))
    near = could_link(F.col("n"), F.col("at"), F.col("pivot_n"), F.col("pivot_at"), percent)
    return met.select("pivot", "class", "n", near.alias("near"), fits.alias("fits")).filter("near or fits").groupBy("pivot", "class").agg(F.first("n").alias("n"), F.bool_or("near").alias("near"), F.bool_or("fits").alias("fits"))


def unresolved(regions: DataFrame, named: DataFrame) -> DataFrame:
    """regions(pivot, class, n), named(node, component) -> pivot, class, n, component, main (whether in the pivot's component): regions of several components."""
    state = regions.join(named.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    state = state.join(named.select(F.col("node").alias("pivot"), F.col("component").alias("own")), "pivot", "left").withColumn("main", F.col("component") == F.coalesce("own", "pivot")).drop("own")
    open_ = state.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("pivot")
    return state.join(open_, "pivot", "left_semi").select("pivot", "class", "n", "component", "main")


def leveled(state: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """region, class, component, n, main, home, bits: a region for each size; a row goes as a guest to the next smaller one if it can have partners there."""

    def run(batches):
        for batch in small(batches, 2048):
            pdf = batch.to_pandas()
            n, own = pdf["n"].to_numpy(), level(pdf["n"].to_numpy())
            guest = (own > 6) & (n * percent <= 100 * ((1 << (own - 1)) // FOLD))
            for home, take, power in ((True, np.ones(len(n), dtype=bool), own), (False, guest, own - 1)):
                i = np.flatnonzero(take)
                packed = [x if home else np.bitwise_or.reduce(np.frombuffer(x, dtype=np.uint8).reshape(2, -1)).tobytes() for x in pdf["bits"].to_numpy()[i]]
                yield pa.RecordBatch.from_pydict({"pivot": pdf["pivot"].to_numpy()[i], "power": power[i].astype(np.int32), "class": pdf["class"].to_numpy()[i], "component": pdf["component"].to_numpy()[i], "n": n[i].astype(np.int32), "main": pdf["main"].to_numpy()[i], "home": np.full(len(i), home), "bits": pa.array(packed, pa.binary())})

    out = state.join(bits, "class").select("pivot", "class", "component", "n", "main", "bits").mapInArrow(run, "pivot long, power int, class long, component long, n int, main boolean, home boolean, bits binary")
    return out.withColumn("region", F.xxhash64("pivot", "power")).drop("pivot")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = x @ y.T
    return 1 - both / np.maximum(x.sum(1)[:, None] + y.sum(1)[None] - both, 1)


def _radius(n: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Largest Jaccard distance of folded sets that a partner within the threshold can have: the sets differ in (1 - t) / (1 + t) of both sizes at most, and so do the bits."""
    return (100 - percent) / (100 + percent) * n * (1 + 100 / percent) / np.maximum(size, 1) + 1e-6


def voronoi(rows: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """rows as from ``leveled``, large regions cut: region, part, class, component, n, home, power, bits.

    A large region elects pivots by hash.  Its rows are dealt in blocks, each with
    all pivots; a row goes home to the nearest pivot.  Guests, and rows outside
    the main component, also go to every part that their window leaves open;
    rows of the main component need not meet each other.
    """
    sized = rows.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / HOT), F.ceil(F.sum("n") / HEAVY)).cast("int").alias("k"))
    # only large regions are named, and there are few of them: rows with their bits need no exchange to meet them
    hot = scratch.save(sized.filter("k > 1"), "hot-regions")
    found = hot.count()
    if not found:
        return rows.withColumn("part", F.lit(0)).drop("main")
    hot = F.broadcast(hot) if found <= MOST_OFTEN else hot
    small = rows.join(hot, "region", "left_anti").withColumn("part", F.lit(0)).drop("main")
    large = rows.join(hot, "region").withColumn("block", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    heads = large.groupBy("region", "block").agg(F.min(F.struct(F.xxhash64("class", F.lit(1)), "class", "bits", "k")).alias("x"))
    heads = heads.select("region", F.explode(F.sequence(F.lit(0), F.col("x.k") - 1)).alias("block"), F.col("x.class").alias("class"), F.col("x.bits").alias("bits"))
    heads = heads.select("region", "block", F.lit(0).alias("kind"), "class", F.lit(0).cast("long").alias("component"), F.lit(0).alias("n"), F.lit(False).alias("main"), F.lit(True).alias("home"), F.lit(0).alias("power"), "bits")
    body = large.select("region", "block", F.lit(1).alias("kind"), "class", "component", "n", "main", "home", "power", "bits")

    def run(batches):
        pivots, where = None, None
        for pdf in whole_groups(batches, "block_of"):
            for key, g in pdf.groupby("block_of", sort=False):
                heads, g = g[g["kind"] == 0], g[g["kind"] == 1]
                if not len(g):
                    continue
                power = int(g["power"].iloc[0])
                if where != key:
                    where, pivots = key, unfolded(heads["bits"], power)
                for a in range(0, len(g), 1024):
                    part = g.iloc[a : a + 1024]
                    x = unfolded(part["bits"], power)
                    d = _distances(x, pivots)
                    near = d.argmin(1)
                    r = _radius(part["n"].to_numpy(), x.sum(1), percent)
                    open_ = d <= d.min(1)[:, None] + 2 * r[:, None]
                    home, main = part["home"].to_numpy(), part["main"].to_numpy()
                    open_[home & main] = False
                    open_[np.arange(len(part)), near] = True
                    i, j = np.nonzero(open_)
                    out = part.iloc[i][["region", "class", "component", "n", "power", "bits"]].copy()
                    out["part"], out["home"] = j.astype(np.int32), home[i] & (near[i] == j)
                    yield out

    cut = heads.unionByName(body).withColumn("block_of", F.xxhash64("region", "block")).repartition("block_of").sortWithinPartitions("block_of", "kind", "class")
    cut = cut.mapInPandas(run, "region long, part int, class long, component long, n int, home boolean, power int, bits binary")
    return small.unionByName(scratch.save(cut, "voronoi"))


def _meet(x, n, f, comp, home, i, j, percent):
    """Index pairs of rows i and j whose bits allow a link."""
    both = x[i] @ x[j].T
    most = np.minimum((n[i] - f[i])[:, None] + both, (n[j] - f[j])[None] + both)
    ok = ((100 + percent) * most >= percent * (n[i][:, None] + n[j][None])) & (comp[i][:, None] != comp[j][None]) & (home[i][:, None] | home[j][None])
    a, b = np.nonzero(ok)
    return i[a], j[b]


def candidates(x: np.ndarray, n: np.ndarray, comp: np.ndarray, home: np.ndarray, percent: int = PERCENT):
    """Pairs (index arrays) of rows of a region whose folded sets allow a link: Voronoi regions with windows, down to leaves."""
    f = x.sum(1)
    stack = [(np.arange(len(n)), np.array([], dtype=np.int64))]  # rows of a region, and its guests
    while stack:
        own, guests = stack.pop()
        rest = np.concatenate([own, guests])
        k = int(np.sqrt(len(rest)))
        if len(rest) > LEAF:
            pivots = own[:: max(1, len(own) // k)]
            d = _distances(x[rest], x[pivots])
            near, r = d.argmin(1), _radius(n[rest], f[rest], percent)
            open_ = d <= d.min(1)[:, None] + 2 * r[:, None]
            if open_.sum() * len(rest) < len(rest) * len(rest) * len(pivots) / 4 and len(pivots) > 1:
                is_own = np.arange(len(rest)) < len(own)
                for j in range(len(pivots)):
                    mine = is_own & (near == j)
                    # each pair of regions is looked at once, by the one with the smaller number
                    other = open_[:, j] & ~mine & (~is_own | (near > j))
                    if mine.any() and mine.sum() < len(own):
                        stack.append((rest[mine], rest[other]))
                    elif mine.any():
                        yield from _leaves(x, n, f, comp, home, rest[mine], rest[other], percent)
                continue
        yield from _leaves(x, n, f, comp, home, own, guests, percent)


def _leaves(x, n, f, comp, home, own, guests, percent):
    rest = np.concatenate([own, guests])
    for a in range(0, len(own), LEAF):
        for b in range(a, len(rest), LEAF):
            i, j = _meet(x, n, f, comp, home, own[a : a + LEAF], rest[b : b + LEAF], percent)
            if len(i):
                yield i, j


def promising(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows of regions (region, part, class, component, n, home, power, bits) -> group, class, component: rows that may link, connected ones in one group."""

    def run(batches):
        for pdf in whole_groups(batches, "key"):
            for key, g in pdf.groupby("key", sort=False):
                if len(g) < 2:
                    continue
                g = g.sort_values(["home", "class"], ascending=[False, True], kind="stable")
                x = unfolded(g["bits"], int(g["power"].iloc[0]))
                n, comp, home = g["n"].to_numpy().astype(np.float64), g["component"].to_numpy(), g["home"].to_numpy()
                up = np.arange(len(g))
                met = np.zeros(len(g), dtype=bool)
                for i, j in candidates(x, n, comp, home, percent):
                    met[i] = met[j] = True
                    _unite(up, i, j)
                at = np.flatnonzero(met)
                if len(at):
                    yield pd.DataFrame({"key": key, "root": up[at], "class": g["class"].to_numpy()[at], "component": comp[at]})

    dealt = rows.withColumn("key", F.xxhash64("region", "part")).repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "key long, root long, class long, component long").select(F.xxhash64("key", "root").alias("group"), "class", "component")


def _unite(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of index pairs in ``up``, where every entry holds the root of its row."""
    while True:
        a, b = up[i], up[j]
        differ = a != b
        if not differ.any():
            return
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(up, high, low)
        while not np.array_equal(up, nxt := up[up]):
            up[:] = nxt


def exact_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows(group, class, component, items) -> a, b: links that connect what the group's links connect."""

    def run(batches):
        for pdf in whole_groups(batches, "group"):
            for _, g in pdf.groupby("group", sort=False):
                g = g.drop_duplicates("class")
                if len(g) < 2:
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in g["items"]]
                found = _links_of(sets, g["component"].to_numpy(), percent)
                if found:
                    names = g["class"].to_numpy()
                    yield pd.DataFrame({"a": [names[i] for i, _ in found], "b": [names[j] for _, j in found]})

    return rows.repartition("group").sortWithinPartitions("group").mapInPandas(run, "a long, b long")


def _links_of(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(word, kind="stable")
    post, bounds = owner[order], np.searchsorted(word[order], np.arange(word.max() + 2))
    begin = np.concatenate([[0], np.cumsum(n)])
    _, up = np.unique(component, return_inverse=True)
    up, out = np.array(up), []
    for i in range(len(sets)):
        if (up == up[0]).all():
            break
        mine = word[begin[i] : begin[i + 1]]
        lo, size = bounds[mine], bounds[mine + 1] - bounds[mine]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        common = np.bincount(post[at], minlength=len(sets))
        hit = np.flatnonzero(((100 + percent) * common >= percent * (n[i] + n)) & (up != up[i]))
        for j in hit:
            if up[j] != up[i]:
                out.append((i, int(j)))
                up[up == up[j]] = up[i]
    return out


def similarity_join(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(doc_id, class, n) of every document with an id, links(a, b) between classes within the threshold that connect all classes that the full join connects."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    often = frequent_shingles(docs, OFTEN)
    scratch.release()
    base = scratch.save(sets_and_prefixes(docs, often), "sets", "snappy")
    names = ["name1", "name2"]
    classes = base.filter("n > 0").groupBy(*names).agg(F.min("row").alias("class"), F.min("doc_id").alias("doc_id"))
    classes = scratch.save(classes, "classes")
    empty = base.filter("n = 0").select("doc_id", F.lit(None).cast("long").alias("class"), "n")
    members = scratch.save(base.filter("n > 0").select("doc_id", "n", *names).join(classes.select("class", *names), names).select("doc_id", "class", "n").unionByName(empty), "members")
    reps = base.join(classes.select(F.col("class").alias("row")), "row", "left_semi").withColumnRenamed("row", "class")
    regions = scratch.save(stars(reps.select("class", "n", "prefix", "late"), scratch, percent), "regions")
    scratch.release()
    bits = base.select(F.col("row").alias("class"), "bits")
    sets: list[DataFrame] = []

    def sets_of(batches):
        for batch in small(batches):
            texts, names_ = batch.column("text").to_pylist(), batch.column("class").to_numpy()
            one, two = batch.column("name1").to_numpy(), batch.column("name2").to_numpy()
            for a, b in batches_of(texts):
                h, begin = shingle_sets(texts[a:b])
                x, y = _names_of(h, begin)
                # a repeated doc_id may have other texts
                keep = np.flatnonzero((x == one[a:b]) & (y == two[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(names_[a:b][keep], pa.int64()), pa.array([h[begin[i] : begin[i + 1]].tobytes() for i in keep], pa.binary())], names=["class", "items"])

    def with_sets(wanted: DataFrame) -> DataFrame:
        """class, items; the sets of classes not met before come from their texts."""
        for known in sets:
            wanted = wanted.join(known.select("class"), "class", "left_anti")
        wanted = scratch.save(wanted.join(classes, "class"), f"wanted-{len(sets)}")
        found = within_reach(docs, wanted, scratch, f"words-{len(sets)}").join(wanted, "doc_id").select("class", "name1", "name2", "text").mapInArrow(sets_of, "class long, items binary")
        sets.append(scratch.save(found, f"items-{len(sets)}", "snappy"))
        scratch.release()
        union = sets[0]
        for more in sets[1:]:
            union = union.unionByName(more)
        return union

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        union = with_sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
        out = verify(pairs, union).filter((100 + percent) * F.col("common") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")
        out = scratch.save(out, name)
        scratch.release()
        return out

    # rows that repeat a doc_id are one document
    spread = members.filter("class is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a != z")
    links = scratch.save(members.join(spread, "doc_id").select("a", F.col("class").alias("b")).filter("a != b").distinct(), "same-id")
    links = links.unionByName(verified(regions.filter("near").select(F.col("pivot").alias("a"), F.col("class").alias("b")), "links-0"))
    named = components(links, scratch, "cc-0")
    inner = regions.filter("fits").select("pivot", "class", "n")
    state = scratch.save(unresolved(inner, named), "state-0")
    # pivots of large regions merge most of what is near, so that few rows are left outside the main component
    step, before = 0, None
    while True:
        sized = state.groupBy("pivot").agg(F.count("*").alias("m"), F.count_if(~F.col("main")).alias("outside")).filter(F.col("m") > HOT)
        outside = sized.agg(F.sum("outside")).first()[0]
        if not outside or (before is not None and outside > 0.9 * before):
            break
        step, before = step + 1, outside
        hot = state.join(sized.select("pivot"), "pivot", "left_semi")
        elected = hot.filter("not main").groupBy("pivot", F.pmod(F.xxhash64("class"), F.lit(2)).alias("half")).agg(F.min(F.struct(F.xxhash64("class", F.lit(step)), "class", "n", "component")).alias("x"))
        elected = elected.select("pivot", F.col("x.class").alias("a"), F.col("x.n").alias("n_a"), F.col("x.component").alias("c_a"))
        pairs = hot.join(elected, "pivot").filter((F.col("c_a") != F.col("component")) & (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent)).select("a", F.col("class").alias("b")).distinct()
        links = links.unionByName(verified(scratch.save(pairs, f"pairs-{step}"), f"links-{step}"))
        named = components(links, scratch, f"cc-{step}")
        state = scratch.save(unresolved(inner, named), f"state-{step}")
    level_rows = scratch.save(leveled(state, bits, percent), "leveled", "snappy")
    # prefixes and bits have been read for the last time
    scratch.drop("sets")
    scratch.release()
    may = scratch.save(promising(voronoi(level_rows, scratch, percent), percent), "promising")
    scratch.drop("leveled", "voronoi")
    scratch.release()
    union = with_sets(may.select("class").distinct())
    more = scratch.save(exact_links(may.join(union, "class"), percent), "links-exact")
    scratch.release()
    return members, links.unionByName(more)


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    members, links = similarity_join(docs, percent)
    scratch = Scratch(docs.sparkSession, "jaccard-groups")
    found = components(links, scratch)
    # the smallest id of each class, then of each component, then back to the classes: no step joins a component's rows
    named = members.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("low")).join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("component", "class"))
    named = scratch.save(named.select("class", "low", "group"), "classes")
    heads = named.groupBy("group").agg(F.min("low").alias("component_id"))
    ids = named.join(heads, "group").select("class", "component_id")
    some = members.filter("class is not null").join(ids, "class").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = members.filter("class is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).unionByName(without_id(docs))


def without_id(docs: DataFrame) -> DataFrame:
    """Rows with a null doc_id: they have a set, and link with nothing."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batches_of(texts):
                n = np.diff(shingle_sets(texts[a:b])[1])
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return docs.filter("doc_id is null").select("text").mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
