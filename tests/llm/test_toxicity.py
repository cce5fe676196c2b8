import random

from pyspark.sql import functions as F

from lumaloom.llm import toxicity as T


def corpus(n=600):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(30, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["zznasty", "zzvile", "zzawful"]) + r.choice(["", "ly", "er"]))
        rows.append((i, " ".join(words), 0.5))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark, tmp_path):
    rows, labels = corpus()
    rows += [(9000, None, 0.1), (9001, "", 0.1), (9002, "clean words only " * 4000, 0.1)]
    spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in T.op4_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and all(0 <= r["score"] <= 1 for r in got.values())
    test = [i for i in range(600) if got[i]["held_out"]]
    toxic = [i for i in test if i % 5 == 0]
    assert sum(got[i]["predicted"] for i in toxic) >= 0.9 * len(toxic)
    assert sum(got[i]["predicted"] for i in test if i % 5) <= 0.02 * len(test)
    assert not any(got[i]["predicted"] for i in (9000, 9001, 9002))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1)], 1.0)):
        model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in T.score(docs, model).collect()} == {want}
    assert T.score(docs.filter(F.lit(False)), T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_ties_and_repeated_rows(spark):
    """Equal texts score alike, whatever their ids; a row with a null id is scored as well."""
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, rows[7][1]), (None, rows[7][1]), (9007199254740993, rows[7][1])], "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [r["score"] for r in T.score(docs, model).filter((F.col("doc_id") == 7) | F.col("doc_id").isNull() | (F.col("doc_id") > 1000)).collect()]
    assert len(got) == 4 and len(set(got)) == 1
