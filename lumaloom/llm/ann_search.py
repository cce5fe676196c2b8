"""Approximate nearest neighbours by inner product from balanced posting lists.

Centroids are fitted on a bounded sample and kept in memory as a graph; vectors
go to the list of their nearest centroid and, near a boundary, to those of other
centroids as well.  Lists longer than a block are cut into blocks of even size,
so a dense region is many tasks.  A query walks the centroid graph and, of the
lists met there, takes those whose distance is within a ratio of the nearest
one's; ratio and width of the walk are calibrated on the sample.  It first scores its nearest lists, and from the
others only what beats its k-th score there comes back.

Inner product becomes distance by one more component that gives all vectors the
same norm; scores are exact inner products of the original vectors in double
precision.

Sample: ``SAMPLE`` vectors by order of a hash of vec_id, which also bounds the
number of lists (an eighth of it).  Every vector is indexed.

Defined results: vectors that are null, zero or hold null or non-finite
components are neither queries nor candidates; a vector of another length is no
candidate;
with fewer candidates than k all are returned; ties go to the smaller vec_id;
vec_id is the key (rows that repeat one are one candidate, scored by the best);
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import lengths, matrix, usable

SAMPLE = 20_000
#: Vectors of one list that a task scores together.
BLOCK = 2048
#: A vector stands in so many lists at most.
COPIES = 3
#: ... in those whose squared distance is within this ratio of the nearest one's.
BOUNDARY = 1.1
#: Lists that a query scores before the others.
FIRST = 4
#: Share of the sample's true neighbours that the chosen lists must hold.
SHARE = 0.95


class CentroidGraph:
    """Nearest centroids by a walk over their neighbour graph, for many points at once.

    A point keeps its ``beam`` nearest centroids seen; each hop expands the best
    ones not expanded yet, and the walk ends when all of them are.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 16, at_once: int = 8):
        self.c, self.sq = centroids, (centroids**2).sum(1)
        n = len(centroids)
        self.at_once = at_once
        step = max(1, (1 << 22) // max(1, n))
        near = [np.argsort(self.sq[None] - 2 * centroids[i : i + step] @ centroids.T, axis=1)[:, : degree + 1] for i in range(0, n, step)]
        self.near = np.concatenate(near)
        # as many ways in as groups of centroids that the neighbour lists may leave apart
        self.entries = np.linspace(0, n - 1, min(n, max(32, int(2 * np.sqrt(n))))).astype(int)

    def nearest(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and squared distances of the ``beam`` centroids found near each point, nearest first; a few MB of work at a time."""
        beam = max(1, min(beam, len(self.c)))
        step = max(1, (1 << 20) // (self.at_once * self.near.shape[1] * self.c.shape[1]))
        parts = [self._walk(points[i : i + step], beam) for i in range(0, max(1, len(points)), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, room = len(points), max(beam, len(self.entries))
        rows, norm = np.arange(b)[:, None], (points**2).sum(1)[:, None]
        ids = np.tile(self.entries, (b, 1))
        dist = norm + self.sq[ids] - 2 * points @ self.c[self.entries].T
        done = np.zeros(ids.shape, dtype=bool)
        while b:
            open_ = np.where(done, np.inf, dist)
            m = min(self.at_once, open_.shape[1])
            pick = np.argpartition(open_, m - 1, axis=1)[:, :m]
            fresh = np.isfinite(open_[rows, pick])
            if not fresh.any():
                break
            done[rows, pick] = True
            new = self.near[np.where(fresh, ids[rows, pick], ids[:, :1])].reshape(b, -1)
            far = norm + self.sq[new] - 2 * np.einsum("bd,bmd->bm", points, self.c[new])
            ids, dist, done = np.concatenate([ids, new], 1), np.concatenate([dist, far], 1), np.concatenate([done, np.zeros(new.shape, dtype=bool)], 1)
            # a centroid met again counts once, as expanded if it was
            order = np.argsort(ids * 2 + ~done, axis=1)
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            dist[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            if ids.shape[1] > room:
                keep = np.argpartition(dist, room - 1, axis=1)[:, :room]
                ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
            done |= ~np.isfinite(dist)
        order = np.argsort(dist, axis=1)[:, :beam]
        return ids[rows, order], np.maximum(dist[rows, order], 0)


def lift(m: np.ndarray, norm2: float) -> np.ndarray:
    """One more component, so that all norms are equal and the nearest point has the largest inner product."""
    return np.column_stack([m, np.sqrt(np.maximum(norm2 - (m**2).sum(1), 0))])


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Balanced k-means: an overfull cluster pushes points away in proportion to its size."""
    r = np.random.default_rng(seed)
    n = max(1, min(n, len(sample)))
    c = sample[r.choice(len(sample), n, replace=False)].copy()
    size = np.full(n, len(sample) / n)
    for _ in range(rounds):
        spread = max(1e-12, float(((sample[:256] - sample.mean(0)) ** 2).sum(1).mean()))
        pull = (c**2).sum(1) + 0.05 * spread * (size / (len(sample) / n) - 1)
        at = np.concatenate([(pull[None] - 2 * sample[i : i + 2048] @ c.T).argmin(1) for i in range(0, len(sample), 2048)])
        size = np.bincount(at, minlength=n).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        empty = size == 0
        c = np.where(empty[:, None], sample[r.choice(len(sample), n)], total / np.maximum(size, 1)[:, None])
    return c


def homes(points: np.ndarray, graph: CentroidGraph) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each place of a vector: its nearest centroid, and others near a boundary."""
    home, dist = graph.nearest(points, 4 * COPIES)
    home, dist = home[:, :COPIES], dist[:, :COPIES]
    take = (dist <= BOUNDARY * dist[:, :1] + 1e-12) | (np.arange(dist.shape[1]) == 0)
    i, j = np.nonzero(take & np.isfinite(dist))
    return i, home[i, j]


def calibrate(sample: np.ndarray, graph: CentroidGraph, norm2: float, k: int, share: float = SHARE, probes: int = 200) -> tuple[float, int]:
    """(ratio, beam): the distance ratio within which lists hold that share of the sample's true neighbours, and the most lists that a probe has within it."""
    if len(sample) < 3:
        return 1e9, len(graph.c)
    q = sample[:: max(1, len(sample) // probes)][:probes]
    i, at = homes(lift(sample, norm2), graph)
    begin = np.searchsorted(i, np.arange(len(sample) + 1))
    score = q @ sample.T
    flat = np.column_stack([q, np.zeros(len(q))])
    to = np.sqrt(np.maximum((flat**2).sum(1)[:, None] + graph.sq[None] - 2 * flat @ graph.c.T, 0))
    to /= np.maximum(to.min(1, keepdims=True), 1e-12)
    top = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : k + 1]
    own = np.arange(0, len(sample), max(1, len(sample) // probes))[:probes]
    ratio = np.array([to[p, at[begin[j] : begin[j + 1]]].min() for p in range(len(q)) for j in top[p] if j != own[p]])
    limit = float(np.quantile(ratio, share))
    return limit, max(FIRST, int((to <= limit).sum(1).max()))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products among the other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    vectors = scratch.save(usable(vectors), "vectors")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths(vectors):
        found = found.unionByName(_one_length(vectors.filter(F.size("vec") == d), queries, k, Scratch(spark, f"ann-{d}")))
    return found


def _one_length(vectors: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    # the queries are many tasks, however few files the vectors are
    queries = vectors.join(queries, "vec_id", "left_semi").repartition("vec_id")
    total = vectors.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)")).alias("m")).first()
    norm2 = float(total["m"])
    sample = matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vec"])
    n_lists = int(max(1, min(len(sample) // 8, np.sqrt(total["n"]))))
    graph = CentroidGraph(fit_centroids(lift(sample, norm2), n_lists))
    # the k nearest of all are the nearest few of a sample
    ratio, beam = calibrate(sample, graph, norm2, -(-k * len(sample) // total["n"]))
    logging.getLogger(__name__).info("%d lists, ratio %.4f, at most %d lists a query", n_lists, ratio, beam)

    def post(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                i, at = homes(lift(matrix(part["vec"]), norm2), graph)
                yield pd.DataFrame({"list": at, "vec_id": part["vec_id"].to_numpy()[i], "vec": part["vec"].to_numpy()[i]})

    def choose(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                q = matrix(part["vec"])
                at, near = graph.nearest(np.column_stack([q, np.zeros(len(q))]), beam)
                near = np.sqrt(near)
                place = np.arange(near.shape[1])[None]
                take = ((near <= ratio * np.maximum(near[:, :1], 1e-12)) | (place < FIRST)) & np.isfinite(near)
                i, j = np.nonzero(take)
                yield pd.DataFrame({"list": at[i, j], "query_id": part["vec_id"].to_numpy()[i], "qvec": part["vec"].to_numpy()[i], "place": j.astype(np.int32)})

    lists = scratch.save(vectors.mapInPandas(post, "list int, vec_id long, vec array<double>"), "lists")
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chosen = scratch.save(queries.mapInPandas(choose, "list int, query_id long, qvec array<double>, place int"), "chosen")
    blocks = lists.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "vec", F.lit(float("-inf")).alias("least"))

    def probes_of(some: DataFrame) -> DataFrame:
        return some.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("vec_id"), F.col("qvec").alias("vec"), "least")

    def score(batches):
        """A block's vectors come first and are kept; its probes stream past them."""
        now, ids, rows = None, [], []
        held_ids = held = None
        for pdf in batches:
            out = []
            for (where, kind), part in pdf.groupby([pdf["list"] * (1 << 20) + pdf["block"], "kind"], sort=True):
                if where != now:
                    now, ids, rows, held = where, [], [], None
                if kind == 0:
                    ids.append(part["vec_id"].to_numpy())
                    rows.append(matrix(part["vec"]))
                    continue
                if held is None and ids:
                    held_ids, held = np.concatenate(ids), np.concatenate(rows)
                if held is None:
                    continue
                for a in range(0, len(part), 256):
                    probe = part.iloc[a : a + 256]
                    q, me, least = matrix(probe["vec"]), probe["vec_id"].to_numpy(), probe["least"].to_numpy()
                    s = q @ held.T
                    s[held_ids[None] == me[:, None]] = -np.inf
                    for i in range(len(q)):
                        fit = np.flatnonzero((s[i] >= least[i] - 1e-9) & (s[i] > -np.inf))
                        if len(fit) > k:
                            kth = np.partition(s[i][fit], len(fit) - k)[len(fit) - k]
                            fit = fit[s[i][fit] >= kth - 1e-9 * max(1.0, abs(kth))]
                        if len(fit):
                            # the cut is made on the scores that are returned
                            exact = (held[fit] * q[i]).sum(1)
                            best_ = np.lexsort((held_ids[fit], -exact))[:k]
                            out.append(pd.DataFrame({"query_id": me[i], "vec_id": held_ids[fit[best_]], "score": exact[best_]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64").astype({"score": "float64"})

    def run(probes: DataFrame) -> DataFrame:
        both = blocks.unionByName(probes).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
        return both.mapInPandas(score, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = scratch.save(best(run(probes_of(chosen.filter(F.col("place") < FIRST).withColumn("least", F.lit(float("-inf")))))), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("least"))
    rest = chosen.filter(F.col("place") >= FIRST).join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = first.select("query_id", "vec_id", "score").unionByName(run(probes_of(rest)))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))
