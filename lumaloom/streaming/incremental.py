"""Structured Streaming: sessions, incremental and versioned derivation with checkpoints, several tables from one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: str, time: str, late: str = "10 minutes") -> DataFrame:
    """A file stream with a watermark; wall-clock times become instants of the session's zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def bursts(events: DataFrame, time: str, by: list[str], gap: str) -> DataFrame:
    """Session windows: one row per burst, closed after ``gap``."""
    return events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, time: str, width: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop; a second call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def derive_incrementally(stream: DataFrame, derive: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Derived rows of new inputs, batch by batch, under ``sink/batch=n``.

    A batch that is tried again replaces its own folder, so nothing is written
    twice.  A failing batch stops the stream and is the first of the next call;
    ``derive`` keeps a bad row from failing its batch by returning the error as a column.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={epoch}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def derive_versioned(listings: DataFrame, versions: dict[str, str], derive: Callable[[str, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Derived rows of the components that are stale, with the state of each (file_id, component) kept in the stream.

    listings(file_id, scan, fingerprint, ...): what scans found.  A component is
    derived when it never was, when its version differs, when its input has
    another fingerprint, or when it failed; one that is unsupported stays so until
    its version changes.  ``derive(component, row)`` gets a frame of one row and
    returns ``value`` (string) and ``status`` (complete, failed or unsupported); an
    exception is a failure of that row, not of its batch.  Of the rows of one file
    in one batch the last scan counts (ties: the largest fingerprint; a null is
    the smallest); a row that is older than the state is left out.  Rows without a
    file_id or a scan are left out; a null fingerprint is never up to date.

    -> file_id, component, scan, version, why, status, value, error.  The state is
    committed with its batch, so a batch that is cut short is derived again as a
    whole, and a sink that replaces or deduplicates batches holds each row once.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(v).alias("version")) for c, v in sorted(versions.items())]))
    rows = listings.filter("file_id is not null and scan is not null").withColumn("__c", wanted).select(*listings.columns, "__c.component", "__c.version")
    kind = dict(listings.dtypes)["file_id"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, place = None, None
        for f in frames:
            # most keys have one row; the last scan counts, then the largest fingerprint
            places = [(int(n), p if isinstance(p, str) else "") for n, p in zip(f["scan"], f["fingerprint"], strict=True)]
            top = max(range(len(places)), key=places.__getitem__)
            if place is None or places[top] > place:
                last, place = f if len(f) == 1 else f.iloc[[top]], places[top]
        (scan, fingerprint), version = place, last["version"].iat[0]
        was = state.get if state.exists else None
        if was is not None and scan < was[0]:
            return
        why = _stale(was, version, fingerprint)
        if why is None:
            state.update((scan, *was[1:]))
            return
        try:
            made = derive(key[1], last)
            status, value, error = made["status"].iat[0], made["value"].iat[0], None
        except Exception as e:  # noqa: BLE001 - the error is the row's result
            status, value, error = "failed", None, f"{type(e).__name__}: {e}"
        state.update((scan, version, fingerprint, status))
        yield pd.DataFrame([(key[0], key[1], scan, version, why, status, value, error)], columns=["file_id", "component", "scan", "version", "why", "status", "value", "error"])

    out = f"file_id {kind}, component string, scan long, version string, why string, status string, value string, error string"
    return rows.groupBy("file_id", "component").applyInPandasWithState(step, out, "scan long, version string, fingerprint string, status string", "append", GroupStateTimeout.NoTimeout)


def _stale(was: tuple | None, version: str, fingerprint: str) -> str | None:
    """Why a component has to be derived, or None if it is up to date."""
    if was is None:
        return "missing"
    _, old_version, old_fingerprint, status = was
    if old_version != version:
        return "version"
    if status == "unsupported":
        return None
    if status != "complete":
        return "failed"
    return None if fingerprint and old_fingerprint == fingerprint else "input"


def derive_versioned_batches(listings: DataFrame, versions: dict[str, str], derive: Callable[[str, pd.DataFrame], pd.DataFrame], sink: str, state: str, checkpoint: str) -> None:
    """:func:`derive_versioned` with its state as a table: what has arrived is derived into ``sink/batch=n``, many rows a call.

    Each batch joins the state that the one before left under ``state/batch=n`` and
    writes its own, so a batch that is cut short is derived again as a whole and
    replaces what it had written.  ``derive(component, rows)`` gets a frame of rows
    and returns as many; if it raises, its rows are derived one by one, so that an
    exception is a failure of its row.
    """
    spark, sink, state = listings.sparkSession, sink.rstrip("/"), state.rstrip("/")
    wanted = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(v).alias("version")) for c, v in sorted(versions.items())]))
    kind = dict(listings.dtypes)["file_id"]
    kept = f"file_id {kind}, component string, scan long, version string, fingerprint string, status string"
    made = "status string, value string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for component, rows in frame.groupby("component", sort=False):
                yield pd.concat([rows.reset_index(drop=True), _derived(derive, component, rows)], axis=1)

    def one(batch: DataFrame, epoch: int) -> None:
        rows = batch.filter("file_id is not null and scan is not null").select(*listings.columns)
        place = F.struct("scan", F.col("fingerprint").isNotNull().alias("known"), F.coalesce("fingerprint", F.lit("")).alias("mark"))
        last = rows.groupBy("file_id").agg(F.max_by(F.struct(*rows.columns), place).alias("r")).select("r.*", wanted.alias("c")).select(*rows.columns, "c.component", "c.version")
        before = spark.read.schema(kept).parquet(f"{state}/batch={epoch - 1}") if epoch else spark.createDataFrame([], kept)
        was = before.select("file_id", "component", *[F.col(c).alias(f"__{c}") for c in ("scan", "version", "fingerprint", "status")])
        same = (F.col("__fingerprint") == F.col("fingerprint")) & (F.col("fingerprint") != "")
        why = (
            F.when(F.col("__scan").isNull(), "missing").when(F.col("scan") < F.col("__scan"), None).when(F.col("__version") != F.col("version"), "version").when(F.col("__status") == "unsupported", None)
            .when(~F.col("__status").eqNullSafe("complete"), "failed").when(~F.coalesce(same, F.lit(False)), "input")
        )
        stale = last.join(was, ["file_id", "component"], "left").withColumn("why", why).filter("why is not null").select(*rows.columns, "component", "version", "why")
        out = f"{sink}/batch={epoch}"
        stale.mapInPandas(run, ", ".join([*[f"`{c}` {t}" for c, t in stale.dtypes], made])).select("file_id", "component", "scan", "version", "why", "fingerprint", "status", "value", "error").write.mode("overwrite").parquet(out)
        # the state after it: what was derived, and else what was there, seen by a newer scan
        new = spark.read.schema(f"{kept}, why string").parquet(out).select("file_id", "component", F.struct("scan", "version", "fingerprint", "status").alias("n"))
        seen = last.select("file_id", "component", F.col("scan").alias("seen"))
        old = before.select("file_id", "component", F.struct("scan", "version", "fingerprint", "status").alias("o"))
        j = old.join(new, ["file_id", "component"], "full").join(seen, ["file_id", "component"], "left")
        after = j.select("file_id", "component", F.coalesce("n.scan", F.greatest("o.scan", "seen")).alias("scan"), *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("version", "fingerprint", "status")])
        after.write.mode("overwrite").parquet(f"{state}/batch={epoch}")

    listings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _derived(derive: Callable[[str, pd.DataFrame], pd.DataFrame], component: str, rows: pd.DataFrame) -> pd.DataFrame:
    """status, value, error of every row."""
    try:
        made = derive(component, rows)
        if len(made) != len(rows):
            raise ValueError(f"{len(made)} rows derived from {len(rows)}")
        return made[["status", "value"]].assign(error=None).reset_index(drop=True)
    except Exception as e:  # noqa: BLE001 - the error is the row's result
        if len(rows) == 1:
            return pd.DataFrame({"status": ["failed"], "value": [None], "error": [f"{type(e).__name__}: {e}"]})
    half = len(rows) // 2
    return pd.concat([_derived(derive, component, rows.iloc[:half]), _derived(derive, component, rows.iloc[half:])], ignore_index=True)


def fan_out(rows: DataFrame, decode: Callable[[pd.DataFrame], Any], consumers: dict[str, tuple[Callable[[pd.DataFrame, Any], pd.DataFrame], str]], folder: str) -> dict[str, DataFrame]:
    """Several derived tables from one pass: each batch is decoded once and every consumer gets what was decoded.

    A consumer is a function of the batch and its decoded form that returns the
    rows of its own table, and their schema.  All rows are written once to
    ``folder``, which must be new, in a part for each consumer; a returned table
    reads its own part and columns only.  A consumer without rows is an empty table.
    """
    names = sorted(consumers)
    tables = {n: to_arrow_schema(StructType.fromDDL(consumers[n][1])) for n in names}
    schema = "consumer string, " + ", ".join(f"`{n}` struct<{consumers[n][1]}>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            batch = arrow.to_pandas()
            decoded = decode(batch)
            for n in names:
                made = pa.Table.from_pandas(consumers[n][0](batch, decoded), tables[n], preserve_index=False).to_batches()
                for part in made:
                    filled = pa.StructArray.from_arrays(part.columns, fields=list(tables[n]))
                    others = [filled if m == n else pa.nulls(len(part), pa.struct(list(tables[m]))) for m in names]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.string()), *others], ["consumer", *names])

    rows.mapInArrow(run, schema).write.partitionBy("consumer").parquet(folder)
    back = rows.sparkSession.read.schema(schema).parquet(folder)
    return {n: back.filter(F.col("consumer") == n).select(f"`{n}`.*") for n in names}
