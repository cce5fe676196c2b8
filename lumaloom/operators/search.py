"""Exact vector search, query by example and projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _blocked_scores(vectors: DataFrame, queries: np.ndarray, best_of: list[str]) -> DataFrame:
    """Cosine of each vector with the nearest of a few query vectors, in Arrow batches with one matrix product each."""
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    keep = [f for f in vectors.schema.fields if f.name in best_of]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", similarity double, source int"

    def run(batches):
        for pdf in batches:
            fine = pdf["vec"].map(lambda v: v is not None and len(v) == q.shape[1])
            pdf = pdf[fine]
            if not len(pdf):
                continue
            m = np.array(pdf["vec"].tolist(), dtype=np.float64)
            n = np.linalg.norm(m, axis=1)
            ok = (n > 0) & np.isfinite(n)
            s = (m[ok] / n[ok, None]) @ q.T
            out = pdf.loc[ok, best_of].copy()
            out["similarity"], out["source"] = s.max(1), s.argmax(1).astype(np.int32)
            yield out

    return vectors.mapInPandas(run, schema)


def search(vectors: DataFrame, queries: np.ndarray, k: int | None, allowed: DataFrame | None = None, exclude=None) -> DataFrame:
    """vectors(asset_id, sample, vec) -> asset_id, similarity, sample, source: best frame of each asset, top k (None: all) by (-similarity, id).

    The filter of allowed assets comes first: scores do not depend on it.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("asset_id"), "asset_id", "left_semi")
    if exclude is not None:
        vectors = vectors.filter(F.col("asset_id") != exclude)
    scored = _blocked_scores(vectors, queries, ["asset_id", "sample"])
    best = F.max(F.struct("similarity", (-F.col("sample")).alias("s"), "source")).alias("m")
    collapsed = scored.groupBy("asset_id").agg(best).select("asset_id", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).alias("sample"), F.col("m.source").alias("source"))
    ordered = collapsed.orderBy(F.desc("similarity"), "asset_id")
    return ordered if k is None else ordered.limit(k)


def mean_vectors(frames: DataFrame) -> DataFrame:
    """frames(asset_id, vec) -> asset_id, vec: normalised mean of normalised frames, by position (partial sums combine map-side)."""
    from ..functions.metrics import normalized

    parts = frames.select("asset_id", F.posexplode(normalized(F.col("vec"))).alias("i", "x"))
    means = parts.groupBy("asset_id", "i").agg(F.avg("x").alias("m"))
    packed = means.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select("asset_id", normalized(F.transform("p", lambda y: y["m"])).alias("vec"))


def project(vectors: DataFrame, fit: int = 10_000) -> DataFrame:
    """vectors(asset_id, vec) -> asset_id, x, y: two principal axes.

    The axes are fitted on at most ``fit`` assets by order of sha256(id); each is
    turned so that its largest loading is positive; everything is projected.
    """
    sample = vectors.orderBy(F.sha2(F.col("asset_id").cast("string"), 256)).limit(fit).select("vec").toPandas()
    if not len(sample):
        return vectors.select("asset_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    m = np.array(sample["vec"].tolist(), dtype=np.float64)
    centre = m.mean(0)
    _, _, axes = np.linalg.svd(m - centre, full_matrices=False)
    axes = np.vstack([axes, np.zeros((2, m.shape[1]))])[:2]
    if len(m) < 2:
        axes[:] = 0
    axes *= np.where(axes[np.arange(2), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    kind = dict(vectors.dtypes)["asset_id"]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                p = np.nan_to_num((np.array(pdf["vec"].tolist(), dtype=np.float64) - centre) @ axes.T)
                yield pd.DataFrame({"asset_id": pdf["asset_id"], "x": p[:, 0], "y": p[:, 1]})

    return vectors.select("asset_id", "vec").mapInPandas(run, f"asset_id {kind}, x double, y double")


def is_current(projection: dict, run_id: str, ids: DataFrame) -> bool:
    """Whether a stored projection still fits: same run, count and set of ids (an order-independent digest)."""
    now = set_digest(ids)
    return projection.get("run_id") == run_id and (projection.get("n"), projection.get("digest")) == now


def set_digest(ids: DataFrame) -> tuple[int, str]:
    """Number of ids and the sum of their digests, whatever their order."""
    h = F.conv(F.substring(F.md5(F.col("asset_id").cast("string")), 1, 10), 16, 10).cast("decimal(38,0)")
    row = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("h")).first()
    return row["n"], row["h"]
