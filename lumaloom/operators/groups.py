"""Time and similarity groups of assets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions import times as T
from .scratch import written

BURST_GAP = 0.5
WINDOW = 10.0
#: Widths of a band that one task looks at together, and pairs that it holds at once.
BANDS, SLICE = 16, 1 << 19
#: Rows that a stream of groups takes from a batch at once.
ROWS = 4096


def representatives(items: DataFrame) -> DataFrame:
    """The best scored member of each group, the earliest among equals or if none is scored, then the smallest id.

    With ``capture_time_kind``, instants come before local times and these before
    times that name neither; else times are compared as they are written.  One partial aggregate, no sort.
    """
    time = F.struct(F.col("capture_time").isNull(), "capture_time")
    if "capture_time_kind" in items.columns:
        seconds = T.capture_seconds(F.col("capture_time"), F.col("capture_time_kind"))
        place = F.when(seconds.isNull(), 2).when(T.semantics(F.col("capture_time_kind")) == "absolute", 0).otherwise(1)
        time = F.struct(place, F.coalesce(seconds, F.lit(0.0)))
    key = F.struct(F.col("quality").isNull(), -F.col("quality"), time, "asset_id")
    return items.filter("group_id is not null").groupBy("group_id").agg(F.min_by(F.struct(*items.columns), key).alias("r")).select("r.*")


def band_pairs(events: DataFrame, time: str, key: str, by: list[str], width: float) -> DataFrame:
    """Pairs of rows at most ``width`` apart in time within equal ``by``: a bucketed interval join.

    Each row looks into its own bucket and the next one, so the join is an
    equi-join with a range residual; rows with null time or key pair with nothing.
    """
    cols = [*by, F.col(time).alias("t"), F.col(key).alias("k")]
    rows = events.select(*cols).withColumn("b", F.floor(F.col("t") / width))
    left = rows.select(*by, F.col("t").alias("t1"), F.col("k").alias("k1"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    right = rows.select(*by, F.col("t").alias("t2"), F.col("k").alias("k2"), "b")
    later = (F.col("t2") > F.col("t1")) | ((F.col("t2") == F.col("t1")) & (F.col("k2") > F.col("k1")))
    return left.join(right, [*by, "b"]).filter(later & (F.col("t2") - F.col("t1") <= width)).drop("b")


def _spans(events: DataFrame, time: str, by: list[str], width: float) -> DataFrame:
    """Rows by spans of ``BANDS`` widths; those at the end of a span also stand in the next one, not as its own."""
    span = lambda t: F.floor(t / (width * BANDS))
    dated = events.dropna(subset=[time, *by])
    here, there = span(F.col(time)), span(F.col(time) + width * 1.01)
    return dated.withColumn("span", F.explode(F.array_distinct(F.array(here, there)))).withColumn("own", F.col("span") == here)


def _first(size: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each query the first place below ``size`` from which ``holds`` is true, else ``size``."""
    lo, hi = np.zeros_like(size), size.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        ok = holds(np.where(open_, mid, 0))
        lo, hi = np.where(open_ & ~ok, mid + 1, lo), np.where(open_ & ok, mid, hi)
    return lo


def _below(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of ``ranks[lo:hi]`` are below ``limit``, for each query: a wavelet matrix, one pass for each bit."""
    total = np.zeros_like(lo)
    for bit in range(int(len(ranks)).bit_length() - 1, -1, -1):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        at, to, big = zeros[lo], zeros[hi], (limit >> bit & 1).astype(bool)
        total += np.where(big, to - at, 0)
        lo, hi = np.where(big, zeros[-1] + lo - at, at), np.where(big, zeros[-1] + hi - to, to)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return total


def band_pair_counts(events: DataFrame, time: str, key: str, by: list[str], width: float, value: str, most: float) -> DataFrame:
    """by, pairs, accepted: how many pairs ``band_pairs`` has, and how many of them are at most ``most`` apart in ``value``.

    No pair is formed: in order of time the partners of a row are one range, and
    those near in value are counted in it by their ranks.
    """
    rows = _spans(events.select(*by, F.col(time).alias("t"), F.col(key).alias("k"), F.col(value).cast("double").alias("v")), "t", by, width)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a row pairs with none of its own time and key; without a key with none of its time
        pdf = pdf.sort_values(["t", "k"], na_position="last", kind="stable")
        t, v, own = pdf["t"].to_numpy(), pdf["v"].to_numpy(float), pdf["own"].to_numpy(bool)
        at = np.arange(len(pdf))
        new = np.append(True, t[1:] != t[:-1])
        k, keyless = pdf["k"].to_numpy(), pdf["k"].isna().to_numpy()
        other = new | np.append(True, (k[1:] != k[:-1]) & ~keyless[1:])
        hi = np.maximum.accumulate(np.where(other, at, 0))
        hi[keyless] = np.maximum.accumulate(np.where(new, at, 0))[keyless]
        lo = np.minimum(_first(at, lambda i: t - t[i] <= width), hi)
        out = pdf[by].head(1).assign(pairs=int((hi - lo)[own].sum()), accepted=0)
        told = np.isfinite(v)
        before = np.concatenate([[0], np.cumsum(told)])
        asked = told & own
        if asked.any():
            ordered, x = np.sort(v[told]), v[asked]
            ranks = np.empty(len(ordered), dtype=np.int64)
            ranks[np.argsort(v[told], kind="stable")] = np.arange(len(ordered))
            size = np.full(len(x), len(ordered))
            low, high = _first(size, lambda i: x - ordered[i] <= most), _first(size, lambda i: ordered[i] - x > most)
            a, b = before[lo[asked]], before[hi[asked]]
            out["accepted"] = int((_below(ranks, a, b, high) - _below(ranks, a, b, low)).sum())
        return out

    types = dict(rows.dtypes)
    found = rows.groupBy(*by, "span").applyInPandas(run, ", ".join([*[f"`{c}` {types[c]}" for c in by], "pairs long", "accepted long"]))
    return found.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.sum("accepted").alias("accepted")).filter("pairs > 0")


def nearest_band_pairs(events: DataFrame, time: str, key: str, by: list[str], width: float, value: str, least: float, n: int) -> DataFrame:
    """a, b, diff: of the pairs that ``band_pairs`` has, the first ``n`` more than ``least`` apart in ``value``, by diff, distance in time and keys.

    Rows equal but for their key differ in the last places of the order alone, so
    the ``n`` smallest keys of them are enough.  A task finds the first ``n`` pairs
    of a span: it takes pairs up to a difference that it raises until there are so many.
    """
    rows = events.select(*by, F.col(time).alias("t"), F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null").dropna(subset=["t", *by])
    same = Window.partitionBy(*by, "t", "v").orderBy(F.col("k").asc_nulls_last())
    spans = _spans(rows.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= n).drop("__n"), "t", by, width)
    kind = dict(rows.dtypes)["k"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", na_position="last", kind="stable")
        t, v, own = (pdf[c].to_numpy() for c in ("t", "v", "own"))
        keyless = pdf["k"].isna().to_numpy()
        k = pdf["k"].fillna(0).to_numpy(np.int64)
        at = np.arange(len(pdf))
        with np.errstate(invalid="ignore"):
            end = _first(at, lambda i: v - v[i] <= least)
            reached = np.sort((v - v[np.maximum(end - 1, 0)])[end > 0])
            reached, take = reached[np.isfinite(reached)], 2 * n
            while True:
                limit = reached[take - 1] if take <= len(reached) else np.inf
                begin = np.minimum(_first(at, lambda i: v - v[i] <= limit), end) if np.isfinite(limit) else np.zeros_like(end)
                best = within(t, v, own, k, keyless, begin, end)
                if len(best) == n or not np.isfinite(limit):
                    return best[["a", "b", "diff", "dt"]]
                take *= 4

    def within(t, v, own, k, keyless, begin, end) -> pd.DataFrame:
        order, best = ["diff", "dt", "a", "b"], pd.DataFrame({"diff": [], "dt": [], "a": pd.array([], "Int64"), "b": pd.array([], "Int64")})
        past = np.concatenate([[0], np.cumsum(end - begin)])
        for start in range(0, int(past[-1]), SLICE):
            place = np.arange(start, min(start + SLICE, int(past[-1])))
            j = np.searchsorted(past, place, side="right") - 1
            i = begin[j] + place - past[j]
            ahead = (t[i] > t[j]) | ((t[i] == t[j]) & (k[i] > k[j]))
            x, y = np.where(ahead, j, i), np.where(ahead, i, j)
            met = own[y] & (t[y] - t[x] <= width) & ((t[x] < t[y]) | ((k[x] < k[y]) & ~keyless[x] & ~keyless[y]))
            i, j, x, y = i[met], j[met], x[met], y[met]
            diff = v[j] - v[i]
            if len(diff) > n:
                near = ~(diff > np.partition(diff, n - 1)[n - 1])
                diff, x, y = diff[near], x[near], y[near]
            keys = {c: pd.Series(k[z], dtype="Int64").mask(keyless[z]) for c, z in (("a", x), ("b", y))}
            found = pd.DataFrame({"diff": diff, "dt": t[y] - t[x], **keys})
            best = pd.concat([best, found]).sort_values(order, na_position="last").head(n) if len(best) else found.sort_values(order, na_position="last").head(n)
        return best

    found = spans.groupBy(*by, "span").applyInPandas(run, f"a {kind}, b {kind}, diff double, dt double")
    # pandas hands NaN on as null
    found = found.withColumn("diff", F.coalesce("diff", F.lit(math.nan)))
    ends = [F.col(c).asc_nulls_last() for c in ("a", "b")]
    return found.orderBy("diff", "dt", *ends).limit(n).select("a", "b", "diff")


def islands(events: DataFrame, time: str, by: list[str], gap: float, order: list[str]) -> DataFrame:
    """Adds ``island``: a new one starts after more than ``gap`` or at a null time."""
    w = Window.partitionBy(*by).orderBy(F.col(time).asc_nulls_last(), *order)
    before = F.lag(time).over(w)
    new = F.when(F.col(time).isNull() | before.isNull() | (F.col(time) - before > gap), 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def timeline_islands(events: DataFrame, time: str, stream: str, gap: float, order: str) -> DataFrame:
    """``islands`` of a few long streams, none of which fits one task.

    The rows are sorted by ranges of (stream, time, order) and written; islands
    are found inside each range, and one row for each range and stream says how
    a range goes on from the one before.  Rows with a null time are left out;
    ``island`` counts from 0 in each stream.
    """
    keys = [stream, time, order]
    dated = events.filter(F.col(time).isNotNull())
    ranges = written(dated.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "timeline")
    w = Window.partitionBy("__part", stream).orderBy(time, order)
    since = F.col(time) - F.lag(time).over(w)
    inside = ranges.withColumn("__new", F.when(since > gap, 1).otherwise(0)).withColumn("__new", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    borders = inside.groupBy("__part", stream).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.max("__new").alias("n")).collect()
    before: dict = {}
    starts = []
    for b in sorted(borders, key=lambda b: b["__part"]):
        last, number = before.get(b[stream], (None, 0))
        number += last is not None and b["first"] - last > gap
        starts.append((b["__part"], b[stream], number))
        before[b[stream]] = (b["last"], number + b["n"])
    found = events.sparkSession.createDataFrame(starts, f"p int, s {dict(events.dtypes)[stream]}, __base long")
    # as many rows as ranges and streams in them
    joined = inside.join(F.broadcast(found), (F.col("__part") == F.col("p")) & F.col(stream).eqNullSafe(F.col("s")))
    return joined.withColumn("island", F.col("__base") + F.col("__new")).drop("__part", "__new", "__base", "p", "s")


def _grouped(batches, burst: Callable[[dict, dict], bool], similarity: Callable[[dict, dict], float | None], features: list[str]):
    """Lists of (asset_id, group key) from batches in order of semantics, island, time and id: a group is told as soon as nothing can join it."""
    island, before, home, open_groups, out = None, None, None, [], []

    def told(groups: list[list[dict]]):
        for g in groups:
            key = min(m["asset_id"] for m in g)
            out.extend((m["asset_id"], key) for m in g)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for r in batch.slice(at, ROWS).to_pylist():
                if (r["semantics"], r["island"]) != island:
                    told(open_groups)
                    island, before, home, open_groups = (r["semantics"], r["island"]), None, None, []
                if any(r[f] is None or r[f] != r[f] for f in features):
                    before = None
                    continue
                # times only grow: a group whose first member is too old takes no one by likeness any more, only the one of the record before goes on by bursts
                old = [g for g in open_groups if r["t"] - g[0]["t"] > WINDOW]
                joins = before is not None and r["t"] - before["t"] <= BURST_GAP and burst(before, r)
                if old:
                    told([g for g in old if not (joins and g is home)])
                    open_groups = [g for g in open_groups if r["t"] - g[0]["t"] <= WINDOW or (joins and g is home)]
                if not joins:
                    home = _most_alike(open_groups, r, similarity)
                    if home is None:
                        home = []
                        open_groups.append(home)
                home.append(r)
                before = r
            if out:
                yield out
                out = []
    told(open_groups)
    if out:
        yield out


def _most_alike(groups: list[list[dict]], r: dict, similarity: Callable[[dict, dict], float | None]) -> list[dict] | None:
    """The group whose members ``r`` all matches, with the best worst similarity; among equals the one with the smallest ids."""
    best = None
    for g in groups:
        worst = math.inf
        for m in g:
            x = similarity(m, r)
            if x is None:
                break
            worst = min(worst, x)
        else:
            if best is None or worst > best[0] or (worst == best[0] and [m["asset_id"] for m in g] < [m["asset_id"] for m in best[1]]):
                best = (worst, g)
    return best[1] if best else None


def strict_groups(records: DataFrame, burst: Callable[[dict, dict], bool], similarity: Callable[[dict, dict], float | None], features: list[str]) -> DataFrame:
    """asset_id, group_key: strict temporal and visual groups.

    records(asset_id, semantics, t, features...).  In time order a record joins
    the group of the record before it if that is at most 0.5 s away and
    ``burst`` agrees; else the group within 10 s whose members it all matches
    (``similarity`` not null), the one with the best worst similarity.  A record
    without time is a group of its own; one without features joins nothing and
    breaks a chain.

    A gap of more than 10 s closes every group, so islands between such gaps are
    independent; within one a record looks only at groups that began in the last
    10 s.  A task streams its islands in order of time and holds the groups that may
    still grow, not an island.
    """
    dated = timeline_islands(records, "t", "semantics", WINDOW, "asset_id")

    kind = dated.schema["asset_id"].dataType
    schema = StructType([StructField(c, kind) for c in ("asset_id", "group_key")])

    def run(batches):
        for part in _grouped(batches, burst, similarity, features):
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(kind)) for c in zip(*part)], names=["asset_id", "group_key"])

    # neighbouring islands share a task: most are a few rows
    near = dated.select("semantics", "island", "t", "asset_id", *[c for c in dated.columns if c not in ("semantics", "island", "t", "asset_id")])
    found = near.repartition("semantics", F.floor(F.col("island") / 256)).sortWithinPartitions("semantics", "island", "t", "asset_id").mapInArrow(run, schema)
    alone = records.filter("t is null").select("asset_id", F.col("asset_id").alias("group_key"))
    return found.unionByName(alone)


def percentile_rank(df: DataFrame, by: list[str], value: str) -> Column:
    """(average rank - 0.5) / n within ``by``."""
    w = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, value)
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2 - F.lit(0.5)) / F.count("*").over(w)
