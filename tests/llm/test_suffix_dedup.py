import hashlib
import random

import pytest

from lumaloom.llm import suffix_dedup as S


def brute(texts, n=200):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], []).append((d, i))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + n] = b"\1" * n
    return [(sum(c), bytes(b for b, x in zip(t, c) if not x), len([1 for i, x in enumerate(c) if x and (i == 0 or not c[i - 1])])) for t, c in zip(texts, cover)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(80), prose(45)
    out = [prose(r.randint(1, 300)) for _ in range(30)]
    for i in range(0, 20, 2):
        p = out[i].split()
        out[i] = " ".join(p[: len(p) // 2] + [r.choice([passage, line, passage[5:260], passage + line])] + p[len(p) // 2 :])
    near = out[3].split() + prose(150).split()
    for _ in range(8):
        c = list(near)
        for _ in range(r.randint(0, 5)):
            c[r.randrange(len(c))] = word()
        out.append(" ".join(c))
    return out + ["", "a" * 199, "ab" * 300, "ba" * 150, "x" * 200, "x" * 200, "y" * 450, out[5], out[5]]


@pytest.mark.parametrize("big", [20_000, 3])
def test_matches_brute_force(spark, big):
    texts = corpus(7) + [None]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = {r["doc_id"]: r for r in S.remove_repeats(docs, big).collect()}
    for i, (n, kept, spans) in enumerate(brute([(t or "").encode() for t in texts])):
        if n:
            assert (got[i]["n_removed"], bytes(got[i]["kept"]), got[i]["n_spans"]) == (n, kept, spans), i
        else:
            assert i not in got or got[i]["n_removed"] == 0


def test_query_and_empty(spark, tmp_path):
    t = corpus(3)[4] * 2
    spark.createDataFrame([(1, t), (2, t), (3, "short"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in S.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert rows[1]["n_removed"] == rows[1]["n_bytes"] == len(t.encode()) and rows[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[3]["kept_sha256"] == hashlib.sha256(b"short").hexdigest() and rows[4]["n_bytes"] == 0
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sorter():
    r = random.Random(1)
    s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 150))) for _ in range(200)] + [b"a" * 120 + bytes([c]) for c in (3, 1, 2, 2)] + [b"", b"\0", b"\0\0"]
    assert [s[i] for i in S.deep_shallow_sort(s)] == sorted(s)
    assert all(S.common_prefix(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a in s[:40] for b in s[100:140])


def test_ids(spark, tmp_path):
    """Rows that repeat an id, with the same text or another, and rows without one are documents of their own; large ids stay as they are."""
    t, big = corpus(5)[0] * 9, 9007199254740993
    u = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500))
    long = "".join(random.Random(2).choices("abcdefgh", k=300_000))
    rows = [(None, t), (1, t), (1, t), (big, u), (2, None), (1, "short"), (None, u[:300]), (None, None), (3, "x" * 900), (3, "y" * 50), (4, long), (5, long[1000:1300])]
    spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, row string, d int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op10_suffix_dedup(spark, str(tmp_path)).collect()]
    texts = [(x or "").encode() for _, x in rows]
    want = [(i, len(x), n, spans, hashlib.sha256(kept).hexdigest()) for (i, _), x, (n, kept, spans) in zip(rows, texts, brute(texts))]
    assert sorted(got, key=str) == sorted(want, key=str)
