"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text
of labelled documents.  Every window (one word with its leading space, behind a
constant run that both dictionaries know, so that a frame's fixed cost is the
same) is compressed with both; the difference of the two lengths says which
dictionary knows it better.  A logistic curve over counts of window differences,
fitted on labelled documents that the dictionaries were not trained on, gives a
calibrated score.

Training reads at most ``max_toxic`` + ``max_ordinary`` labelled documents, by
order of a hash of doc_id, with their whole texts, half of them for the
dictionaries and half for the curve.  The texts stay with the tasks: those send
back counts of segments and features.  Scoring reads every whole text.

A dictionary holds at most ``max_bytes``, cut from words whose openings stand in
at least 3 % of the documents of its kind.

Defined results: null and empty texts score like a document without windows;
without labels of both kinds the score is the share of toxic labels (0 without
any); repeated rows are scored each; a null label is no label; extra columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Known to both dictionaries, ahead of each window.
LEAD = bytes(range(1, 25))
#: Behind each window and known to neither: matches are not looked for in a frame's last bytes.
TRAIL = bytes(range(200, 212))
#: Words kept by a worker with their differences; the store is emptied when full.
CACHE = 1_000_000
_known: dict[bytes, dict[str, int]] = {}


def windows_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def openings(text: str | None) -> set[str]:
    """Word openings of 4 to 12 characters, once a document."""
    return {w[:k] for w in set(windows_of(text)) for k in range(4, min(len(w), 12) + 1)}


def segment_counts(texts: DataFrame) -> DataFrame:
    """texts(toxic, text) -> segment, ones, zeros: documents of each kind that hold it."""

    def run(batches):
        for pdf in batches:
            seen: Counter = Counter()
            for t, kind in zip(pdf["text"], pdf["toxic"], strict=True):
                seen.update((s, int(kind)) for s in openings(t))
            yield pd.DataFrame([(s, k, n) for (s, k), n in seen.items()], columns=["segment", "kind", "n"])

    parts = texts.select("toxic", "text").mapInPandas(run, "segment string, kind int, n long")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return parts.groupBy("segment").agg(of(1).alias("ones"), of(0).alias("zeros"))


def train_dictionary(counts: DataFrame, mine: str, theirs: str, n_mine: int, n_theirs: int, max_bytes: int = 256, least_odds: float = 3.5) -> bytes:
    """Raw-content dictionary of the segments that cover documents of one kind and that the other kind lacks.

    A segment must be in at least 3 % of the documents (more in small samples)
    and have log odds of ``least_odds``; segments that extend one already taken
    add nothing and are left out.  The constant run stands at the end and the most
    telling segment right before it, where matches are found first.
    """
    least = max(4, min(8, 0.1 * n_mine), 0.03 * n_mine)
    odds = F.ln((F.col(mine) + 0.5) / (n_mine + 1)) - F.ln((F.col(theirs) + 0.5) / (n_theirs + 1))
    found = counts.withColumn("odds", odds).filter((F.col(mine) >= least) & (F.col("odds") > least_odds))
    order = [F.round(F.col("odds") * F.sqrt(F.col(mine)), 9).desc(), F.length("segment").desc(), "segment"]
    # a taken segment shuts out at most the eight others of its word's openings, and has four bytes at least
    best = found.orderBy(*order).limit(max_bytes * 16).select("segment").collect()
    taken: list[str] = []
    size = 0
    for (s,) in best:
        if size < max_bytes and not any(s.startswith(x) or x.startswith(s) for x in taken):
            taken.append(s)
            size += len(s.encode()) + 2
    return b"\0".join(b" " + s.encode() for s in reversed(taken)).rjust(8, b"\0") + b"\0" + LEAD


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    shape = zstandard.ZstdCompressionParameters(window_log=11, hash_log=10, chain_log=10, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=shape)


class WindowMeter:
    """Length under the ordinary dictionary minus length under the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)
        name = toxic + b"\1" + ordinary
        if name not in _known:
            _known.clear()
        self.known = _known.setdefault(name, {})

    def features(self, text: str | None) -> list[float]:
        known, seen = self.known, Counter(windows_of(text))
        at = [0, 0, 0, 0]
        n = best = 0
        for w, times in seen.items():
            d = known.get(w)
            if d is None:
                b = LEAD + b" " + w.encode("utf-8", "replace") + b" " + TRAIL
                d = len(self.ordinary.compress(b)) - len(self.toxic.compress(b))
                if len(known) >= CACHE:
                    known.clear()
                known[w] = d
            n += times
            if d > 1:
                at[min(d, 5) - 2] += times
                best = max(best, d)
        thousand = max(n, 50) / 1000
        return [np.log1p(at[0] / thousand), np.log1p(at[1] / thousand), np.log1p(at[2] / thousand), np.log1p(at[3] / thousand), float(best >= 3), float(best >= 4), float(best >= 5)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_ordinary: int = 3000) -> dict:
    """docs(doc_id, text), labels(doc_id, toxic) -> {toxic, ordinary: dictionaries; weights; base}.

    The sample is chosen from the labels alone, so only its texts move.
    """
    known = labels.filter("toxic in (0, 1)").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    base = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not n1 or not n0:
        return {"toxic": None, "ordinary": None, "weights": None, "base": base}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(max_toxic).union(known.filter("toxic = 0").orderBy(*order).limit(max_ordinary))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")).bitwiseAND(F.lit(64).cast("long")) == 0
    texts = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text", half.alias("first"))
    texts = Scratch(docs.sparkSession, "toxicity").save(texts, "sample")
    sizes = {(r["first"], r["toxic"]): r["n"] for r in texts.groupBy("first", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.get((True, k), 0) + sizes.get((False, k), 0) for k in (0, 1)):
        return {"toxic": None, "ordinary": None, "weights": None, "base": base}
    # a sample too small to halve serves both purposes
    whole = not all(sizes.get((f, k), 0) for f in (True, False) for k in (0, 1))
    size = lambda f, k: sum(n for (g, j), n in sizes.items() if j == k and (whole or g == f))
    part = lambda f: texts if whole else texts.filter(F.col("first") == f)
    counts = segment_counts(part(True))
    a1, a0 = size(True, 1), size(True, 0)
    model = {"toxic": train_dictionary(counts, "ones", "zeros", a1, a0), "ordinary": train_dictionary(counts, "zeros", "ones", a0, a1, least_odds=0.0), "base": base}

    def measured(batches):
        meter = WindowMeter(model["toxic"], model["ordinary"])
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [meter.features(t) for t in pdf["text"]]})

    got = part(False).select("toxic", "text").mapInPandas(measured, "toxic int, x array<double>").toPandas()
    got = got.iloc[np.lexsort(np.array(got["x"].tolist()).T)]  # the same order, and so the same sums, in every run
    w = fit_logistic(np.array(got["x"].tolist()), got["toxic"].to_numpy(dtype=float))
    b1, b0 = size(False, 1), size(False, 0)
    w[0] += np.log(n1 / n0) - np.log(b1 / b0)  # the sample's share of toxic documents is not the corpus's
    return model | {"weights": w}


def scorer(model: dict):
    """A vectorised column function: text -> score."""

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        meter = WindowMeter(model["toxic"], model["ordinary"]) if model["weights"] is not None else None
        for texts in batches:
            if meter is None:
                yield pd.Series(np.full(len(texts), model["base"], dtype=float))
                continue
            x = np.array([meter.features(t) for t in texts]).reshape(len(texts), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model["weights"][0] + x @ model["weights"][1:], -30, 30))))

    return score_of


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column ``score``."""
    return docs.withColumn("score", scorer(model)(F.col("text")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def model_for(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from the labelled rows that are not held out."""
    kept = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return train(docs.select("doc_id", "text"), kept)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), model_for(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
