import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lumaloom.llm import sentencepiece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["The quick brown fox", "  a  b\n\nc\td ", "é漢字 emoji 🙂 ok", "", None, "x" * 300, "Straße und Vögel, señor! " * 4, " ", "worthless Ndernt retitioning the of", "a▁b", "1234567 89.5% <s> </s>", "tabs\t\tand\r\nlines"]


@pytest.mark.parametrize("most", [1000, 0])
def test_encode(spark, most):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + TEXTS[:3]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in C.encode(docs, MODEL, most).collect()}
    pieces = C.Pieces(MODEL)
    for i, t in enumerate(texts):
        assert list(got[i]) == (sp.encode(t) if t else []), (i, t)
        if t and C.BLANK not in t:
            assert pieces.decode(got[i]) == t
    coded = C.encode(docs.filter("text not like '%▁%'"), MODEL, most)
    assert all((r["text"] or "") == r["decoded"] for r in C.decode(coded, MODEL).collect())
    assert C.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL, most).count() == 0


def test_folds(spark):
    pieces = spark.createDataFrame([("a", -1.0), ("b", -2.0), ("ab", -2.5), ("bc", -1.0), ("abc", -9.0)], "piece string, score double")
    words = spark.createDataFrame([("abc",), ("abab",), ("zab",)], "word string")
    l = C.lattice(words, pieces, 3)  # noqa: E741
    got = {r["word"]: (r["v"], r["m"]) for r in l.select("word", C.fold_viterbi(F.col("word"), F.col("edges"), 3).alias("v"), C.fold_merge(F.col("word"), F.col("edges")).alias("m")).collect()}
    assert got["abc"] == ([0, 1, 3], [0, 3]) and got["abab"] == ([0, 2, 4], [0, 2, 4]) and got["zab"] == ([0, 1, 3], [0, 1, 3])


def test_query(spark, tmp_path):
    """Against the library: null, large and repeated ids, long texts and words, no text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    big = 9007199254740993
    rows = [(None, "a null id"), (big, TEXTS[2]), (big, "another text of one id"), (3, "word " * 30_000), (4, "abc" * 20_000), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"], r["round_trip"]) for r in C.op1_sentencepiece(spark, str(tmp_path)).collect()))
    want = []
    for i, t in rows:
        ids = sp.encode(t) if t else []
        want.append((i or 0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), True))
    assert got == sorted(want)
