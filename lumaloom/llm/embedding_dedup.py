"""Near-duplicate vectors by NN-descent within equal labels.

1. Identical vectors are one node with a weight.
2. A few hyperplane tables give every node first neighbours: a bucket is dealt
   into bags of bounded size and each bag compares its members.
3. NN-descent: a node's bag is itself, its neighbours and the nodes that have it
   as a neighbour; members of a bag learn of each other when that improves their
   list.  Rounds go on until few lists change.
   Lists keep only what is within twice the threshold angle: by the triangle
   inequality nothing else is a neighbour of a true neighbour.
4. A list whose places are all taken by links is saturated.  Components with
   such lists are compared with each other, exactly and in blocks, unless the
   triangle inequality keeps them apart; links are counted in the same way
   inside all components.
5. Recall is audited: the numbers of links that would be returned are held against
   a comparison of a hash sample of nodes, growing until enough of them have links,
   with all nodes; below the demanded recall, more tables and rounds follow, and
   in the end an error.  The first tables are
   as many as a lone pair at the threshold needs, which grows with the bits.

Defined results: vectors that are null, zero or hold null or non-finite
components, null labels and null ids link with nothing; only vectors of one
length can link; rows that repeat a vec_id are vectors of their own; ties are
equal cosines and all link; extra columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, whole_groups
from .graph import components
from .vectors import lengths, matrix, unit, usable

THRESHOLD = 0.93
LIST = 16
BAG = 96
BLOCK = 512
#: Hyperplane tables at least, and in one pass over the vectors.
TABLES = 8
#: Nodes with links that the audit wants in its sample, and nodes that it looks at for them.
AUDIT = 256
AUDIT_MOST = 1 << 14
#: Rounds of further tables before a missing recall is an error.
ATTEMPTS = 8


class NNDescent:
    def __init__(self, nodes: DataFrame, threshold: float, scratch: Scratch, size: int = LIST):
        """nodes(id, label, vec): unit vectors."""
        self.nodes, self.threshold, self.scratch, self.size = nodes, threshold, scratch, size
        self.floor = math.cos(min(math.pi / 2, 2 * math.acos(threshold)))
        sizes = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        self.most, self.total = sizes["most"] or 0, sizes["total"] or 0
        self.dim = len(nodes.first()["vec"]) if self.most else 0
        self.steps = 0
        self.graph = None

    def _compare(self, bags: DataFrame) -> DataFrame:
        """bags(bag, id, vec, least) -> id, near, sim: pairs of a bag that beat the least of the first."""
        floor, size = self.floor, self.size

        def run(batches):
            for pdf in whole_groups(batches, "bag"):
                out = []
                for _, g in pdf.groupby("bag", sort=False):
                    g = g.drop_duplicates("id")
                    if len(g) < 2:
                        continue
                    ids, v, least = g["id"].to_numpy(), matrix(g["vec"]), np.maximum(g["least"].to_numpy(), floor)
                    s = v @ v.T
                    np.fill_diagonal(s, -1)
                    fit = s >= least[:, None]
                    if fit.sum(1).max() > size:
                        kth = -np.partition(-s, size - 1, axis=1)[:, size - 1]
                        fit &= s >= kth[:, None]
                    i, j = np.nonzero(fit)
                    if len(i):
                        out.append(pd.DataFrame({"id": ids[i], "near": ids[j], "sim": s[i, j]}))
                if out:
                    yield pd.concat(out)

        return bags.repartition("bag").sortWithinPartitions("bag").mapInPandas(run, "id long, near long, sim double")

    def _merge(self, found: DataFrame) -> None:
        """Best ``size`` of old and new neighbours."""
        old = self.graph
        both = found.withColumn("fresh", F.lit(1))
        if old is not None:
            both = both.unionByName(old.select("id", "near", "sim").withColumn("fresh", F.lit(0)))
        one = both.groupBy("id", "near").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        w = Window.partitionBy("id").orderBy(F.desc("sim"), "near")
        ranked = one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= self.size).drop("r")
        self.steps += 1
        self.graph = self.scratch.save(ranked, f"graph-{self.steps}")
        if self.steps > 1:
            self.scratch.drop(f"graph-{self.steps - 1}")

    def bits(self) -> int:
        return max(0, min(24, math.ceil(math.log2(max(1, self.most / 24)))))

    def tables(self, demanded: float) -> int:
        """Tables in which a pair at the threshold shares a bucket at least once with the demanded probability."""
        once = (1 - math.acos(self.threshold) / math.pi) ** self.bits()
        return max(TABLES, math.ceil(math.log(1 - demanded) / math.log(1 - once))) if once < 1 else TABLES

    def hash_tables(self, n: int, seed: int) -> None:
        bits = self.bits()
        planes = np.random.default_rng(seed).normal(size=(n, max(bits, 1), self.dim))

        def codes(batches):
            for pdf in batches:
                v = matrix(pdf["vec"])
                for t in range(n):
                    code = ((v @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1]))).astype(np.int64) if bits else np.zeros(len(v), dtype=np.int64)
                    yield pd.DataFrame({"label": pdf["label"], "code": code * n + t, "id": pdf["id"], "vec": pdf["vec"]})

        coded = self.nodes.mapInPandas(codes, f"label {dict(self.nodes.dtypes)['label']}, code long, id long, vec array<double>")
        sizes = coded.groupBy("label", "code").agg(F.ceil(F.count("*") / (BAG / 2)).alias("m"))
        bags = coded.join(sizes, ["label", "code"]).select(F.xxhash64("label", "code", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("m"))).alias("bag"), "id", "vec", F.lit(-1.0).alias("least"))
        self._merge(self._compare(bags))

    def descend(self, rounds: int = 6, stop: float = 0.001) -> None:
        """Neighbours of neighbours meet in the bag of the one between them."""
        for r in range(rounds):
            g = self.graph
            least = g.groupBy("id").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select("id", F.when(F.col("n") >= self.size, F.col("low")).otherwise(-1.0).alias("least"))
            w = Window.partitionBy("bag").orderBy(F.xxhash64("id", F.lit(r)))
            back = g.select(F.col("near").alias("bag"), "id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * self.size).drop("r")
            members = g.select(F.col("id").alias("bag"), F.col("near").alias("id")).union(back).union(g.select(F.col("id").alias("bag"), "id")).distinct()
            bags = members.join(self.nodes.select("id", "vec"), "id").join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
            self._merge(self._compare(bags))
            n = self.graph.agg(F.sum("fresh").alias("new"), F.count("*").alias("n")).first()
            if not n["n"] or n["new"] <= stop * n["n"]:
                return

    def links(self) -> DataFrame:
        return self.graph.filter(F.col("sim") >= self.threshold).select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()

    def audit(self, counts: DataFrame, weights: DataFrame, wanted: int = AUDIT, most: int = AUDIT_MOST) -> float | None:
        """Recall of links in a sample of nodes; None if no node of it has a link.

        counts(id, n) is what would be returned: the weight of a node's links.  The
        truth comes from comparing the sample with all nodes; every batch sends
        back one sum a sampled node, never pairs.  Each node weighs the same, and
        nodes with fewer links than a list has places are judged apart as well, so
        that large groups cannot hide isolated pairs.  The sample grows until
        ``wanted`` such nodes are in it.
        """
        sample = wanted
        while True:
            got = self._audit(counts, weights, sample)
            few = [min(1.0, ok / n) for n, ok in got if n < self.size]
            if len(few) >= wanted or sample >= most or sample >= self.total:
                break
            sample *= 4
        every = [min(1.0, ok / n) for n, ok in got]
        return min(float(np.mean(x)) for x in (few, every) if x) if every else None

    def _audit(self, counts: DataFrame, weights: DataFrame, sample: int) -> list[tuple[int, int]]:
        """True and found weight of links of every node of the sample that has a link."""
        probe = self.nodes.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample).toPandas()
        pv, pl, pid, t = matrix(probe["vec"]), probe["label"].to_numpy(), probe["id"].to_numpy(), self.threshold

        def run(batches):
            for pdf in batches:
                v, g, ids, w = matrix(pdf["vec"]), pdf["label"].to_numpy(), pdf["id"].to_numpy(), pdf["weight"].to_numpy()
                for k in range(0, len(pid), BLOCK):
                    p, q = pid[k : k + BLOCK], pl[k : k + BLOCK]
                    hit = (v @ pv[k : k + BLOCK].T >= t) & (g[:, None] == q[None]) & (ids[:, None] != p[None])
                    n = w @ hit
                    yield pd.DataFrame({"id": p[n > 0], "n": n[n > 0]})

        true = weights.mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("true"))
        joined = true.join(counts, "id", "left").select("true", F.coalesce("n", F.lit(0)).alias("n"))
        return [(r["true"], r["n"]) for r in joined.collect()]


def compared(nodes: DataFrame, groups: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """nodes(id, vec, weight), groups(id, component), pairs(a, b) of components -> a, b, id, n: weight of all nodes of b that link with a node of a.

    Components are dealt into blocks; every pair of blocks is one task-sized
    comparison that sends back one number a node, never pairs.
    """
    sized = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    dealt = nodes.join(groups, "id").join(sized, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).drop("m")
    blocks = pairs.join(sized.select(F.col("component").alias("a"), F.col("m").alias("ma")), "a").join(sized.select(F.col("component").alias("b"), F.col("m").alias("mb")), "b")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = dealt.join(blocks.withColumn("y", spread("mb")), F.col("component") == F.col("a")).select("a", "b", F.col("block").alias("x"), "y", F.lit(0).alias("kind"), "id", "vec", "weight")
    right = dealt.join(blocks.withColumn("x", spread("ma")), F.col("component") == F.col("b")).select("a", "b", "x", F.col("block").alias("y"), F.lit(1).alias("kind"), "id", "vec", "weight")

    def run(batches):
        for pdf in whole_groups(batches, "cell"):
            for _, g in pdf.groupby("cell", sort=False):
                a, b = g[g["kind"] == 0], g[g["kind"] == 1]
                if len(a) and len(b):
                    hit = (matrix(a["vec"]) @ matrix(b["vec"]).T >= threshold) & (a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None])
                    n = hit @ b["weight"].to_numpy()
                    yield pd.DataFrame({"a": a["a"].to_numpy(), "b": a["b"].to_numpy(), "id": a["id"].to_numpy(), "n": n})[n > 0]

    cells = left.unionByName(right).withColumn("cell", F.concat_ws("/", "a", "b", "x", "y")).drop("x", "y").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInPandas(run, "a long, b long, id long, n long")


def close_components(nodes: DataFrame, groups: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """nodes(id, label, vec), groups(id, component) -> a, b: components of one label that can hold a link between them.

    A component is a ball around the node that names it; by the triangle
    inequality of angles balls farther apart than both radii and the threshold
    angle have no link.  Balls are compared in blocks.
    """
    centres = nodes.join(groups.select(F.col("component").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("component"), "label", F.col("vec").alias("centre"))

    @F.pandas_udf("double")
    def angle(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(np.arccos(np.clip((matrix(u) * matrix(v)).sum(1), -1, 1)) if len(u) else [], dtype="float64")

    radii = nodes.select("id", "vec").join(groups, "id").join(centres, "component").groupBy("component").agg(F.max(angle("vec", "centre")).alias("radius"))
    balls = scratch.save(centres.join(radii, "component"), name)
    sized = balls.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    dealt = balls.join(sized, "label").withColumn("block", F.pmod(F.xxhash64("component"), F.col("m")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    left = dealt.select("label", F.col("block").alias("x"), spread.alias("y"), F.lit(0).alias("kind"), "component", "centre", "radius")
    right = dealt.select("label", spread.alias("x"), F.col("block").alias("y"), F.lit(1).alias("kind"), "component", "centre", "radius")
    limit = math.acos(threshold) + 1e-6  # room for rounding

    def run(batches):
        for pdf in whole_groups(batches, "cell"):
            for _, g in pdf.groupby("cell", sort=False):
                a, b = g[g["kind"] == 0], g[g["kind"] == 1]
                if len(a) and len(b):
                    apart = np.arccos(np.clip(matrix(a["centre"]) @ matrix(b["centre"]).T, -1, 1))
                    i, j = np.nonzero(apart <= a["radius"].to_numpy()[:, None] + b["radius"].to_numpy()[None] + limit)
                    x, y = a["component"].to_numpy()[i], b["component"].to_numpy()[j]
                    yield pd.DataFrame({"a": x[x != y], "b": y[x != y]})

    cells = left.unionByName(right).withColumn("cell", F.concat_ws("/", "label", "x", "y")).drop("label", "x", "y").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInPandas(run, "a long, b long")


def joined_components(work: NNDescent, nodes: DataFrame, attempt: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, across, whole): components by the lists, links between saturated ones (as from ``compared``), and components with those.

    Links that are lost from a list lead from one saturated list to another: an
    end with room keeps them.  Components with saturated lists are therefore
    compared with each other exactly.
    """
    scratch = work.scratch
    links = scratch.save(work.links(), f"links-{attempt}")
    found = scratch.save(components(links, scratch, f"cc-{attempt}"), f"found-{attempt}")
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").count()
    full = degree.filter(F.col("count") >= work.size).join(found.withColumnRenamed("node", "id"), "id").select("component").distinct()
    wide = scratch.save(found.join(full, "component", "left_semi").select(F.col("node").alias("id"), "component"), f"wide-{attempt}")
    pairs = scratch.save(close_components(work.nodes, wide, work.threshold, scratch, f"balls-{attempt}"), f"close-{attempt}")
    across = scratch.save(compared(nodes.select("id", F.col("unit").alias("vec"), "weight"), wide, pairs, work.threshold), f"across-{attempt}")
    return found, across, components(links.union(across.select("a", "b").distinct()), scratch, f"whole-{attempt}")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, demanded: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nn-descent")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    # an input row has a number of its own, so that rows that repeat a vec_id stay apart; it holds in this written copy
    valid = scratch.save(usable(rows, "vec_id", "embedding", "label").filter("label is not null").withColumn("row", F.monotonically_increasing_id()), "valid")
    found = None
    for d in lengths(valid):
        part = _one_length(valid.filter(F.size("vec") == d), threshold, demanded, Scratch(spark, f"nn-descent-{d}"))
        found = part if found is None else found.unionByName(part)
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    unusable = rows.join(valid.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", *alone) if found is not None else rows.select("vec_id", *alone)
    if found is None:
        return unusable.withColumn("kept", F.lit(True))
    # rows of a vec_id that has other, usable rows: those that are not usable themselves
    n = rows.groupBy("vec_id").agg(F.count("*").alias("n")).join(valid.groupBy("vec_id").agg(F.count("*").alias("m")), "vec_id").filter("n > m")
    rest = n.select("vec_id", F.explode(F.sequence(F.col("m") + 1, F.col("n")))).select("vec_id", *alone)
    out = found.unionByName(unusable).unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _one_length(valid: DataFrame, threshold: float, demanded: float, scratch: Scratch) -> DataFrame:
    """vec_id, n_links, component_id for every row of valid(row, vec_id, vec, label), whose vectors have one length."""
    same = valid.groupBy("label", "vec").agg(F.min("row").alias("id"), F.min("vec_id").alias("low"), F.count("*").alias("weight"))

    @F.pandas_udf("array<double>")
    def scaled(v: pd.Series) -> pd.Series:
        return pd.Series(list(unit(matrix(v)))) if len(v) else v

    nodes = scratch.save(same.select("id", "label", "low", "weight", "vec", scaled("vec").alias("unit")), "nodes")
    members = valid.join(nodes.select("label", "vec", "id", "weight"), ["label", "vec"]).select("vec_id", "id", "weight")
    work = NNDescent(nodes.select("id", "label", F.col("unit").alias("vec")), threshold, scratch)
    weighed = nodes.select("id", "label", F.col("unit").alias("vec"), "weight")
    seed = 17
    for attempt in range(ATTEMPTS):
        left = work.tables(demanded) if not attempt else TABLES
        while left > 0:
            work.hash_tables(min(left, TABLES), seed)
            left, seed = left - TABLES, seed + 1
        work.descend()
        found, across, whole = joined_components(work, nodes, attempt)
        whole = scratch.save(whole, f"named-{attempt}")
        own = found.select(F.col("component").alias("a"), F.col("component").alias("b")).distinct()
        inside = compared(nodes.select("id", F.col("unit").alias("vec"), "weight"), found.select(F.col("node").alias("id"), "component"), own, threshold)
        counts = scratch.save(inside.unionByName(across).groupBy("id").agg(F.sum("n").alias("n")), f"counts-{attempt}")
        recall = work.audit(counts, weighed)
        if recall is None:
            logging.getLogger(__name__).warning("no links in the audited sample: recall is not known")
        else:
            logging.getLogger(__name__).info("recall of links %.4f", recall)
        if recall is None or recall >= demanded:
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} of links after {ATTEMPTS} rounds of tables; {demanded} is demanded")
    classes = nodes.select("id", "low").join(whole.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    heads = classes.groupBy("group").agg(F.min("low").alias("component_id"))
    named = classes.join(heads, "group").join(counts, "id", "left").select("id", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    return members.join(named, "id").select("vec_id", (F.col("n") + F.col("weight") - 1).cast("long").alias("n_links"), "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
