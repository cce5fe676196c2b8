"""Licence detection by diagonal voting.

Every pair of neighbouring words of a text is hashed and joined to the pairs of
the licence templates.  A hit votes for a diagonal (word position minus template
position).  Votes are added up by diagonal, neighbouring diagonals of a template
are merged (an inserted or lost word moves a match by one), and a merged group
that covers enough of its template gives the template's label.  Base phrases are
templates too; they count only where the words on the diagonal are verified to
be the phrase.  Only DataFrame functions are used; the template table is fixed
(a few hundred pairs), so it may be broadcast.

Every text also sends one closing row with its number of words through the same
join, so that one pass over the texts and one exchange by row are enough.

Defined results: null and empty texts have 0 words, no labels (empty strings)
and score 0; repeated rows are scanned each; a phrase across a line break counts;
overlapping places all count; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: The method's own templates: lines that stand in the licences of that name.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under the creative commons attribution", "cc-by"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("provided as is without warranty of any kind", "no-warranty"),
    ("reproduction without permission is prohibited", "reserved"),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Vote of the row that closes a text.
CLOSE = 0


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: F.length(w) > 0)


def template_table(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """hash, template, tpos, label, words, is_base: one row a word pair, and the closing row."""
    rows = [(-1, 0, "", [], False, None, None)]
    for t, (phrase, label, is_base) in enumerate([(p, x, True) for p, x in base] + [(p, x, False) for p, x in templates]):
        words = phrase.split(" ")
        rows += [(t, i, label, words, is_base, words[i], words[i + 1]) for i in range(len(words) - 1)]
    df = spark.createDataFrame(rows, "template int, tpos int, label string, twords array<string>, is_base boolean, a string, b string")
    return df.withColumn("hash", F.when(F.col("template") < 0, F.lit(CLOSE).cast("long")).otherwise(F.xxhash64("a", "b"))).drop("a", "b")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least_cover: float = 0.6, reach: int = 2) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    templates = template_table(spark)
    # a few hundred hashes: places that can meet none of them are not exploded
    known = [r["hash"] for r in templates.select("hash").distinct().collect()]
    longest = max((len(p.split(" ")) for p, _ in BASE), default=2)
    split = docs.select(F.col(key).alias("__id"), F.monotonically_increasing_id().alias("__row"), words_of(F.col(text)).alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    places = F.filter(F.transform(pairs, lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))), lambda x: x["hash"].isin(known))
    # a place takes along the words around it that a base phrase can reach, not the text
    first = lambda pos: F.greatest(pos - (longest - 2), F.lit(0))
    held = F.transform(places, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), F.slice("words", first(x["pos"]) + 1, 2 * longest - 2).alias("near")))
    close = F.array(F.struct(F.size("words").alias("pos"), F.lit(CLOSE).cast("long").alias("hash"), F.slice("words", 1, 0).alias("near")))
    votes = split.select("__id", "__row", F.size("words").alias("count"), F.explode(F.concat(held, close)).alias("x")).select("__id", "__row", "count", "x.*")
    hits = votes.join(F.broadcast(templates), "hash").select(
        "__id", "__row", "template", "tpos", "label", "is_base",
        (F.col("pos") - F.col("tpos")).alias("diagonal"),
        F.size("twords").alias("size"),
        F.when(F.col("template") < 0, F.col("count")).alias("n_words"),
        F.when(F.col("is_base") & (F.col("pos") >= F.col("tpos")), F.slice("near", F.greatest(F.col("pos") - F.col("tpos") - first(F.col("pos")) + 1, F.lit(1)), F.size("twords")) == F.col("twords")).alias("exact"),
    )
    lines = (
        hits.repartition("__row")
        .groupBy("__row", "template", "diagonal")
        .agg(F.first("__id").alias("__id"), F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("size").alias("size"), F.max("n_words").alias("n_words"), F.count("*").alias("votes"), F.collect_set("tpos").alias("met"), F.coalesce(F.bool_or("exact"), F.lit(False)).alias("exact"))
    )
    w = Window.partitionBy("__row", "template").orderBy("diagonal")
    merged = (
        lines.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= reach, 0).otherwise(1))
        .withColumn("bunch", F.sum("new").over(w))
        .groupBy("__row", "template", "bunch")
        .agg(
            F.first("__id").alias("__id"), F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.max("n_words").alias("n_words"),
            (F.size(F.array_distinct(F.flatten(F.collect_list("met")))) / (F.first("size") - 1)).alias("cover"),
            F.count_if(F.col("exact") & (F.col("votes") == F.col("size") - 1)).alias("places"),
            F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first"),
            F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last"),
        )
    )
    own = ~F.col("is_base") & (F.col("template") >= 0) & (F.col("cover") >= least_cover)
    found = F.col("is_base") & (F.col("places") > 0)
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return merged.groupBy("__row").agg(
        F.first("__id").alias(key),
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(found, F.col("places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(found, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(found, F.col("last"))).cast("long").alias("last_word"),
        joined(found).alias("base_labels"),
        joined(found | own).alias("labels"),
        F.coalesce(F.max(F.when(found, F.lit(1.0)).when(own, F.least(F.col("cover"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    ).drop("__row")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
