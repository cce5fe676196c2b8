"""A training corpus in five stages: from raw documents to packed sequences.

Every stage works on the rows that the one before it kept, written as Parquet
and read again.  All but the last return the columns of ``documents``.

Defined results: null and empty texts are clean, without lines, links or repeats,
and pass every stage; a row with a null doc_id passes every stage (only its
toxicity is judged); of rows that repeat a doc_id one stays at the Jaccard
join, the others before it are judged each; ties go to the smallest doc_id; extra
columns of the input are not read; empty tables give no rows; without labels
nothing is toxic.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaloom.llm import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from lumaloom.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    model = toxicity.model_for(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.7").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the first of equal or similar lines stays; a document stays even if all its lines go."""
    return _with_text(line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays; rows without an id stay."""
    heads = jaccard_join.groups(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").select(*COLUMNS)
    # rows that repeat an id are one document: the least of them stays
    many = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    one = kept.join(many, "doc_id", "left_anti").select(*COLUMNS)
    least = kept.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return one.unionByName(least).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings go; a character that loses a byte goes whole."""
    cut = suffix_dedup.remove_repeats(docs).select(F.col("doc_id").alias("__d"), "kept").dropDuplicates(["__d"])

    @F.pandas_udf("string")
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    joined = docs.join(cut.select("__d", decoded("kept").alias("__text")), docs["doc_id"] == F.col("__d"), "left")
    return _with_text(joined.withColumn("text", F.when(F.col("__d").isNull(), F.col("text")).otherwise(F.col("__text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("packing", pack_sequences),
]

#: The stages fit a model, follow a graph and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
