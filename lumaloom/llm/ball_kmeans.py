"""Centroid clustering by ball k-means, in exact integers.

A cluster is a ball around its centroid.  A centroid can only take members of
a ball if it lies nearer than twice the ball's radius: these are the ball's
neighbours.  Inside a batch, members nearer than half way to the nearest
neighbour are its stable core and keep their cluster unseen; the others lie in
annuli between half the distances of successive neighbours, and a member is
compared exactly with the neighbours whose half distance it reaches, no more.
All tests are on squared integers, so the result is that of comparing all.

Each round reads the table of the round before and writes the next one, with
the sums of its clusters as a folder of their own: one job that assigns, one that
adds up.  The driver sees ``k`` centroids and radii and nothing else.  Vectors do
not move between tasks, so a cluster that holds a third of them is no burden.

Defined results: vectors that are null, of another length, or hold null or
non-finite components are left out; zero vectors, repeated ids and repeated
vectors count one each; a null id takes part but cannot be a first centroid; equal
hashes go by vector; with fewer different starts there are fewer clusters;
integers beyond 2^27 count as 2^27, so that a squared distance is a long, and
sums beyond a long as the largest one; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: Largest integer of a component; 64 squared differences of such stay below 2^63.
WIDEST = 2**27
#: Products of integers up to this are exact in double precision.
NARROW = 2**22
#: A table row: kind 0 is a vector, kind 1 what a task adds up for a cluster (n, radius, parts of the inertia, sums in v).
SCHEMA = "vec_id long, v array<long>, cluster int, distance long, n long, low long, high long, kind int"
#: Rows of a block inside a task.
BLOCK = 8192


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = 1024) -> DataFrame:
    """vec_id, v: the kept vectors, each component as floor(scale * x)."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    kept = v.filter(F.expr(f"size(x) = {int(dimensions)} and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"))
    return kept.select("vec_id", F.expr(f"transform(x, c -> cast(greatest(least(floor(least(greatest({int(scale)} * c, -1e18D), 1e18D)), {WIDEST}L), -{WIDEST}L) as bigint))").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``seed:vec_id``: a top-k, k rows on the driver."""
    coded = vectors.filter("vec_id is not null").select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("code"))
    return np.array([r["v"] for r in coded.orderBy("code", "v").limit(k).collect()], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def all_squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids; one product in double precision if that is exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= NARROW:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([squared(x, c) for c in centroids], axis=1)


class Balls:
    """Centroids with their radii: which clusters can take members of which."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None = None):
        self.centroids = centroids
        #: squared distances between centroids, as Python integers on the driver, longs in tasks
        self.between = np.stack([squared(centroids, c) for c in centroids])
        self.neighbours: list[np.ndarray] | None = None
        if radii is not None:
            self.neighbours = []
            for i, r in enumerate(radii):
                near = [j for j in range(len(centroids)) if j != i and int(self.between[i, j]) <= 4 * r * r]
                self.neighbours.append(np.array(sorted(near, key=lambda j: int(self.between[i, j])), dtype=np.int64))

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row; ties go to the smaller number."""
        if self.neighbours is None:
            d = all_squared(x, self.centroids)
            best = d.argmin(axis=1)
            return best, d[np.arange(len(x)), best]
        best, least = cluster.copy(), np.empty(len(x), dtype=np.int64)
        for i in np.unique(cluster):
            members = np.flatnonzero(cluster == i)
            d = squared(x[members], self.centroids[i])
            least[members] = d
            # a member is in annulus a if it reaches half way to the first a neighbours: those alone can be as near
            reach = [self.between[i, j] // 4 for j in self.neighbours[i]]
            for j, half in zip(self.neighbours[i], reach):
                out = members[d >= half]
                if not len(out):
                    break  # all that are left are in the core of what is nearer
                other = squared(x[out], self.centroids[j])
                closer = (other < least[out]) | ((other == least[out]) & (j < best[out]))
                best[out[closer]], least[out[closer]] = j, other[closer]
        return best, least


def assigned(vectors: DataFrame, balls: Balls) -> DataFrame:
    """vectors(vec_id, v, cluster) assigned to the balls, and one row a task and cluster with its sums."""
    k, width = balls.centroids.shape
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("kind", pa.int32())])

    def batches(found):
        n, sums, top, low, high = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in found:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                cluster, d = balls.assign(x, part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
                for i in np.unique(cluster):
                    inside = cluster == i
                    n[i] += inside.sum()
                    sums[i] += x[inside].sum(axis=0)
                    top[i] = max(top[i], d[inside].max())
                    low[i] += (d[inside] & 0x7FFFFFFF).sum()
                    high[i] += (d[inside] >> 31).sum()
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cluster.astype(np.int32)), pa.array(d), none, none, none, pa.array(np.zeros(part.num_rows, np.int32))], schema=schema)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(some.astype(np.int32)), pa.array(top[some]), pa.array(n[some]), pa.array(low[some]), pa.array(high[some]), pa.array(np.ones(len(some), np.int32))], schema=schema)

    return vectors.select("vec_id", "v", "cluster").mapInArrow(batches, SCHEMA)


def cluster_sums(sums: DataFrame) -> tuple[dict[int, tuple[int, int, int]], dict[int, dict[int, int]]]:
    """({cluster: (count, squared radius, inertia)}, {cluster: {component: sum}}): k and k times width rows on the driver."""
    whole = "decimal(38,0)"
    of = sums.groupBy("cluster").agg(F.sum(F.col("n").cast(whole)).alias("n"), F.max("distance").alias("top"), F.sum(F.col("low").cast(whole)).alias("low"), F.sum(F.col("high").cast(whole)).alias("high"))
    parts = sums.select("cluster", F.posexplode("v").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast(whole)).alias("total"))
    both = of.select("cluster", F.lit(None).cast("int").alias("at"), F.lit(None).cast(whole).alias("total"), "n", "top", "low", "high").unionByName(parts, allowMissingColumns=True)
    facts, totals = {}, {}
    for r in both.collect():
        if r["at"] is None:
            facts[r["cluster"]] = (int(r["n"]), int(r["top"]), int(r["low"]) + (int(r["high"]) << 31))
        else:
            totals.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
    return facts, totals


def ball_kmeans(vectors: DataFrame, scratch: Scratch, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """(vec_id, cluster, distance of every vector; what is known of every cluster) after ``rounds`` updates of the centroids.

    vectors(vec_id, v array<long> of one length).  A cluster's facts: cluster,
    centroid, n, inertia.  A round whose centroids do not move ends the loop, as all later ones would repeat it.
    """
    spark, state = scratch.spark, scratch.save(vectors.select("vec_id", "v", F.lit(0).alias("cluster")), "round-0")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.filter("false").select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), []
    balls = Balls(centroids)
    for step in range(1, rounds + 2):
        name = f"round-{step}"
        assigned(state, balls).write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path(name))
        stored = spark.read.schema(SCHEMA).parquet(scratch.path(name))
        facts, totals = cluster_sums(stored.filter("kind = 1"))
        scratch.drop(f"round-{step - 1}")
        state = stored.filter("kind = 0")
        if step > rounds:
            break
        moved = np.array([[totals[i][p] // facts[i][0] for p in range(centroids.shape[1])] if i in facts else list(map(int, centroids[i])) for i in range(len(centroids))], dtype=np.int64)
        # no member is farther from the new centroid than from the old one and from that to the new
        shifts = [int(s) for s in ((moved - centroids) ** 2).sum(axis=1)]
        if not any(shifts):
            break
        radii = [isqrt(facts[i][1]) + isqrt(s) + 2 if i in facts else 0 for i, s in enumerate(shifts)]
        centroids, balls = moved, Balls(moved, radii)
    known = [{"cluster": i, "centroid": [int(c) for c in centroids[i]], "n": facts[i][0], "inertia": facts[i][2]} for i in sorted(facts)]
    return state.select("vec_id", "cluster", "distance"), known


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kept vector: its cluster, squared distance, the inertia of its cluster and of all, the hash of its centroid."""
    scratch = Scratch(spark, "balls")
    found, known = ball_kmeans(integers(table(spark, sf_dir, "embeddings")), scratch)
    largest = 2**63 - 1
    total = min(sum(c["inertia"] for c in known), largest)
    code = lambda c: hashlib.sha256(",".join(map(str, c["centroid"])).encode()).hexdigest()
    rows = [(c["cluster"], min(c["inertia"], largest), total, code(c)) for c in known]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """All rounds one after another, every vector against every centroid."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS INT) AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL
  ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': cluster}}) AS best FROM (
  SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(CAST(s // n AS BIGINT) ORDER BY p) AS c FROM (
  SELECT best.c AS cluster, p, count(*) AS n, (sum(v[p]) - (((sum(v[p]) % count(*)) + count(*)) % count(*)))::HUGEINT AS s FROM a{i} CROSS JOIN (SELECT unnest(range(1, {DIMENSIONS + 1})) AS p) GROUP BY ALL) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT a.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o ON a.best.c = o.cluster"""


SQL = _sql()
