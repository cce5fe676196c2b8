import re

from lumaloom.llm import license_scan as L

TEXTS = [None, "", "CC BY", "cc, by cc-by\nCC\nBY", "General Public License and the GNU general public license", "all rights reserved reserved", "all rights, rights reserved", "cc", "by cc", "Permission is hereby granted, free of charge, to any person getting a copy of this software", "é cc by é", "Licensed under the Apache License, Version 2.0"]


def brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    at, labels = [], set()
    for p, label in L.BASE:
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_scan(spark):
    docs = spark.createDataFrame([(i % 11, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, label string, template int")
    rows = L.scan(docs).collect()
    assert len(rows) == len(TEXTS)
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"] or -1, r["last_word"] or -1, r["base_labels"]) for r in rows)
    want = []
    for i, t in enumerate(TEXTS):
        n, places, first, last, labels = brute(t)
        want.append((i % 11, n, places, first or -1, last or -1, labels))
    want.sort()
    assert got == want
    labels = {r["doc_id"]: r for r in rows if r["n_words"] > 10}
    assert labels[9]["labels"] == "mit" and 0.6 <= labels[9]["score"] < 1
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_ids(spark):
    """Thousands of places in one text, null and large ids."""
    big = 9007199254740993
    body = "some words before all rights reserved and cc by then general public license " * 5000
    rows = sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in L.scan(spark.createDataFrame([(None, body), (big, "cc by"), (big, "cc")], "doc_id long, text string").coalesce(1)).collect()), key=str)
    n, places, first, last, labels = brute(body)
    assert rows == sorted([(0, n, places, first, last, labels), (big, 2, 1, 0, 0, "cc-by"), (big, 1, 0, None, None, "")], key=str)
