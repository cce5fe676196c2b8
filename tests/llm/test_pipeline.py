import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = {}
    for i in range(240):
        toxic = i % 4 == 0
        body = [prose(20) for _ in range(4)]
        if toxic:
            body = [b + " " + r.choice(["zzidiot", "zzmoron"]) + " " + word() for b in body]
        texts[i] = "\n".join(body)
    passage = prose(60)
    for i in (1, 2, 3):
        texts[i] += "\n" + passage + " " + prose(3)
    line = prose(9)
    for i in (5, 6):
        texts[i] += "\n" + line
    texts[300], texts[301] = texts[7] + " extra", texts[9]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: {x["doc_id"]: x["text"] for x in df.collect()}
    kept = P.drop_toxic(spark, docs, str(tmp_path))
    clean = {i for i in texts if i % 4 or i == 300}
    left = set(rows(kept))
    assert kept.columns == P.COLUMNS and clean <= left and len(left - clean) <= 9
    lines = rows(P.drop_lines(spark, docs, str(tmp_path)))
    assert lines[5].endswith(line) and not lines[6].endswith(line) and lines[301] == "" and set(lines) == set(texts)
    heads = rows(P.drop_near_copies(spark, docs, str(tmp_path)))
    assert set(heads) == set(texts) - {300, 301}
    cut = rows(P.drop_passages(spark, docs.filter("doc_id < 300"), str(tmp_path)))
    assert all(passage[20:-20] not in cut[i] and len(cut[i]) > 100 for i in (1, 2, 3)) and cut[11] == texts[11]
    out = P.run(spark, str(tmp_path)).collect()
    ids = {x["doc_id"] for x in out}
    assert ids == left
    by = {}
    for x in out:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert all(sum(n for _, n in s) == 2048 for k, s in by.items() if k != max(by))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def test_edge_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, ties, repeated rows, clashing columns: kept, or dropped by the rule."""
    a = " ".join(f"alpha{i} word{i}" for i in range(40))
    long_text = " ".join(f"w{i}x" for i in range(30_000))
    rows = [(None, a, "en", "s", 1, 0.5, "x"), (None, None, None, None, None, None, None), (1, None, "en", "s", 0, 0.5, "x"), (2, "", "en", "s", 0, 0.5, "x"), (3, long_text, "en", "s", 9, 0.5, "x"), (4, a, "en", "s", 9, 0.5, "x"), (4, a, "en", "s", 9, 0.5, "x"), (9007199254740993, a + " more", "en", "s", 9, 0.5, "x")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())
    everything = sorted((r[0] is None, r[0] or 0) for r in rows)
    for stage in (P.drop_toxic, P.drop_lines, P.drop_passages):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == P.COLUMNS and ids(out) == everything
    heads = P.drop_near_copies(spark, docs, str(tmp_path))
    assert heads.columns == P.COLUMNS and ids(heads) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)]
    packed = P.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and sum(r["start"] == 0 for r in packed) == len(rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
