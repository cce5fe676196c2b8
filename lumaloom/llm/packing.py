"""Packing documents into fixed-length sequences along a space-filling curve.

Every document becomes a hashed token vector, projected to a few dimensions by
fixed signs, and gets the Hilbert key of its cell.  Documents are range-sorted
by that key and laid end to end along the curve; the line is cut every
``seq_len`` ids.  Neighbouring documents so share sequences, and only the last
sequence has padding.

Ids are those of the tokenizer file, whose added tokens are cut out of a text
before anything else; the rank file of the same vocabulary gives the ids of what
is between them at about three times the speed.

Defined results: a null or empty text is the closing id alone; documents with
one key (copies) follow each other by a hash of doc_id and then doc_id; repeated
rows, and rows with a null doc_id, are packed each; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DIMS, BITS = 3, 9
#: Bits of the document hash below the Hilbert key; the whole fits a double exactly.
TIE_BITS = 52 - DIMS * BITS


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) by the transpose method, vectorised over rows."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        mask = step - 1
        for i in range(n):
            high = (x[i] & step) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] = np.where(high, x[0] ^ mask, x[0] ^ swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        fix = np.where((x[n - 1] & step) != 0, fix ^ (step - 1), fix)
        step >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sign_table(vocab: int, dims: int = DIMS) -> np.ndarray:
    """Fixed +1/-1 projection of hashed token ids, from the bits of a multiplicative hash."""
    ids = np.arange(vocab, dtype=np.uint64) + np.uint64(1)
    h = ids * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([((h >> np.uint64(40 + i)) & np.uint64(1)).astype(np.float32) * 2 - 1 for i in range(dims)], 1)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizers file and their ids."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def load_encoder(path: str, added: dict[str, int]):
    """text -> ids, over a rank file; added tokens are found in the text first."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoder.encode(text, allowed_special="all")


def vector_of(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Token counts, damped by the square root, projected and scaled to unit variance."""
    if not len(ids):
        return np.zeros(signs.shape[1])
    kinds, n = np.unique(ids, return_counts=True)
    w = np.sqrt(n)
    return (w[:, None] * signs[kinds]).sum(0) / np.sqrt((w * w).sum())


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, added: dict[str, int]) -> DataFrame:
    """doc_id, place double (curve position with the tie-breaking hash below it), n_tokens, ids (little-endian uint16)."""

    def run(batches):
        encode = load_encoder(tokenizer, added)
        signs = sign_table(1 << 16)
        for batch in batches:
            docs_ = batch.column("doc_id").cast(pa.int64())
            ids = [np.array(encode(t or ""), dtype=np.uint16) for t in batch.column("text").to_pylist()]
            v = np.array([vector_of(x, signs) for x in ids]).reshape(-1, DIMS)
            cells = np.clip((v + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            tie = (docs_.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
            place = hilbert_key(cells, BITS).astype(np.float64) * 2.0**TIE_BITS + tie.astype(np.float64)
            yield pa.RecordBatch.from_arrays([docs_, pa.array(place), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([np.append(x, np.uint16(end_id)).tobytes() for x in ids], pa.binary())], names=["doc_id", "place", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place double, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, target_bytes: int = 48 << 20, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of documents with their place in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One shuffle by range moves the ids; cut points of the ranges are quantiles
    of the whole light table, their number follows the data, and their token
    totals (one number a range) fix where each range starts in the line.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    encoded = scratch.save(encode_documents(docs, tokenizer, end_id, added or {}), "encoded")
    light = encoded.select("place", "n_tokens")
    total = light.agg(F.sum("n_tokens")).first()[0]
    if total is None:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    n_ranges = int(total * 2 // target_bytes + 1)
    n_ranges = max(n_ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.unique(light.approxQuantile("place", [i / n_ranges for i in range(1, n_ranges)], 1 / (4 * n_ranges))) if n_ranges > 1 else np.array([])

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), side="right").astype(np.int32))

    sums = light.groupBy(range_of("place").alias("r")).agg(F.sum("n_tokens").alias("n")).collect()
    sizes = np.zeros(len(cuts) + 1, dtype=np.int64)
    for row in sums:
        sizes[row["r"]] = row["n"]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def cut(batches):
        at, current = 0, None
        for batch in batches:
            rows: list[tuple] = []
            names = batch.column("doc_id")
            for i, (r, ids) in enumerate(zip(batch.column("r").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                if r != current:
                    at, current = int(starts[r]), r
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    offset = at % seq_len
                    take = min(n - start, seq_len - offset)
                    rows.append((i, start, take, zlib.crc32(wide[start : start + take].tobytes()), n, at // seq_len, offset))
                    start, at = start + take, at + take
            rest = np.array(rows, dtype=np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rest[:, 0])), *(pa.array(rest[:, k]) for k in range(1, 7))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranged = encoded.select("doc_id", "place", "ids", range_of("place").alias("r")).repartition(len(cuts) + 1, "r").sortWithinPartitions("r", "place", "doc_id")
    return ranged.select("doc_id", "r", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
