"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.scratch import shared_dir


class Scratch:
    """Written intermediate tables of one run, in the shared folder.

    ``save`` writes a DataFrame and returns it re-read, which cuts lineage in
    a way that survives lost executors.  ``drop`` deletes a table that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps: it does so when the driver's garbage is collected.

        The listener threads keep their last event, and with it the last plan; a tiny query takes its place.
        """
        self.spark.range(1).count()
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            fs.delete(at, True)


def whole_groups(batches, key: str):
    """Batches of pandas frames, sorted by ``key``, cut where it changes, so that no group is split."""
    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        if held and held[0][key].iloc[0] != k[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        change = np.flatnonzero(k != k[-1])
        if len(change):  # all but the last group is complete
            at = change[-1] + 1
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held, pdf = [], pdf.iloc[at:]
        held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
