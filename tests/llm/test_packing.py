import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumaloom.llm import packing as P

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = P.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, place string"


def test_hilbert_neighbours():
    n = 8
    cells = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = P.hilbert_key(cells, 3)
    assert sorted(key) == list(range(n**3))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pieces(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello world, ça va? " * k for k in range(1, 60)] + ["", None, "<|endoftext|> x", "a <|endoftext|><|endoftext|>b <|endof", "same", "same", "word " * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = P.pack(docs, RANKS, seq_len=256, added=ADDED).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or s == max(by_seq)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA), RANKS).count() == 0
    assert P.pack(spark.createDataFrame([(1, None, "x"), (2, "", "x")], SCHEMA), RANKS).count() == 2


def test_ids(spark):
    """Null ids, large ids beside them, repeated ids: every row is packed, under its own id."""
    big = 9007199254740993
    docs = spark.createDataFrame([(None, "a b c", "x"), (big, "d e", "x"), (big, "f", "x"), (None, None, "x")], SCHEMA).coalesce(1)
    rows = P.pack(docs, RANKS, added=ADDED).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in rows) == [(False, big, 2), (False, big, 3), (True, 0, 1), (True, 0, 4)]
    assert sorted(r["offset"] for r in rows)[0] == 0 and sum(r["length"] for r in rows) == 10
