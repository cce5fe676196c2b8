"""What is known about each file by component: what is up to date, what is to be done, which errors are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M

#: The components that a kind of job leaves behind.
COMPONENTS_OF = {
    "visual_features": ["group_feature"],
    "media_index": ["metadata", "thumbnail"],
    "media_thumbnails": ["thumbnail"],
    "media_quality": ["quality"],
    "raw_quality": ["quality"],
    "video_quality": ["quality"],
}
#: States in which nothing is left to do.
SETTLED = ["complete", "not_requested"]
FIELDS = ["version", "status", "input_fingerprint", "output_path", "output_fingerprint"]


def fingerprint(sha256: Column, size: Column, mtime: Column) -> Column:
    """What identifies a file's content: its digest, else size and time of change."""
    return F.coalesce(sha256, F.concat(F.lit("stat:"), size.cast("string"), F.lit(":"), mtime.cast("string")))


def by_component(states: DataFrame, components: list[str], fields: dict[str, int] | None = None) -> DataFrame:
    """One row a file with a struct for each component (null without a record): a partial aggregate, one shuffle.

    A component has one record a file; among several the greatest counts.  fields:
    how many of ``FIELDS`` are wanted of a component, from the first, all if it is
    not named; as records are ordered by them, fewer are those of the same record.
    """
    record = lambda c: F.struct(*FIELDS[: (fields or {}).get(c, len(FIELDS))])
    return states.filter(F.col("component").isin(components)).groupBy("file_id").agg(*[F.max(F.when(F.col("component") == c, record(c))).alias(c) for c in components])


def why_pending(component: str, state: Column, version: str, mark: Column, algorithm: str, scoring: bool) -> Column:
    """Why a component of a file is to be derived (again): missing, version, status, input, output or value; null if it is not.

    A record of another version never counts.  ``unsupported`` is final, except
    that JPEG XL metadata and thumbnails are tried again.  Quality is not asked for
    where scoring is off (a score of the same input is kept) or for a video as a
    whole; else it needs a score by this algorithm and version.  Thumbnails need a recorded output.
    """
    status, no = state["status"], lambda c: ~F.coalesce(c, F.lit(False))
    complete, same = status == "complete", state["input_fingerprint"].eqNullSafe(mark)
    scored, skipped = F.col("quality_score").isNotNull(), status == "not_requested"
    common = F.when(no(complete), "status").when(~same, "input")
    if component == "quality" and not scoring:
        rest = F.when(skipped, None).otherwise(F.coalesce(common, F.when(~scored, "value")))
    elif component == "quality":
        current = scored & (F.col("quality_algorithm") == algorithm) & (F.col("quality_version") == version)
        rest = F.when(F.col("media_type") == "video", F.when(no(skipped), "status")).otherwise(F.coalesce(common, F.when(no(current), "value")))
    elif component == "thumbnail":
        rest = F.coalesce(common, F.when(no(state["output_path"] != "") | state["output_fingerprint"].isNull(), "output"))
    else:
        rest = common
    again = F.lower("extension") == ".jxl" if component in ("metadata", "thumbnail") else F.lit(False)
    return F.when(state.isNull(), "missing").when(no(state["version"] == version), "version").when((status == "unsupported") & ~again, None).otherwise(rest)


def pending_work(files: DataFrame, states: DataFrame, versions: dict[str, str], algorithm: str = "", scoring: bool = True) -> DataFrame:
    """files with ``pending``: map of each component of ``versions`` that is to be derived, to the reason.

    files(file_id, extension, media_type, sha256, size_bytes, mtime, quality_score,
    quality_algorithm, quality_version, ..); states(file_id, component, version,
    status, input_fingerprint, output_path, output_fingerprint).  One join by file, whatever the number of components.
    """
    mark = fingerprint(F.col("sha256"), F.col("size_bytes"), F.col("mtime"))
    known = by_component(states, list(versions)).select("file_id", F.struct(*versions).alias("__s"))
    reasons = [F.struct(F.lit(c).alias("key"), why_pending(c, F.col("__s")[c], v, mark, algorithm, scoring).alias("value")) for c, v in versions.items()]
    return files.join(known, "file_id", "left").withColumn("pending", F.map_from_entries(F.filter(F.array(*reasons), lambda r: r["value"].isNotNull()))).drop("__s")


def unresolved_errors(errors: DataFrame, states: DataFrame) -> DataFrame:
    """errors(file_id, kind, ..) that still stand.

    One is settled when every component that its kind of job leaves behind has a
    settled record for the file; for ``embeddings``, when there are records and all are.
    Errors without a file or of other kinds always stand.
    """
    embedding, settled = F.col("component").startswith("embedding:"), F.col("status").isin(SETTLED)
    known = states.groupBy("file_id").agg(
        *[F.coalesce(F.bool_and(F.when(F.col("component") == c, settled)), F.lit(False)).alias(f"__{c}") for c in sorted({c for cs in COMPONENTS_OF.values() for c in cs})],
        F.coalesce(F.bool_and(F.when(embedding, settled)), F.lit(False)).alias("__embedding"),
    )
    done = F.when(F.col("kind") == "embeddings", F.col("__embedding"))
    for kind, components in COMPONENTS_OF.items():
        needed = F.lit(True)
        for c in components:
            needed = needed & F.col(f"__{c}")
        done = done.when(F.col("kind") == kind, needed)
    return errors.join(known, "file_id", "left").filter(~F.coalesce(done, F.lit(False))).select(*errors.columns)


def fresh_vectors(vectors: DataFrame, files: DataFrame, states: DataFrame, component: str, version: str) -> DataFrame:
    """vectors(file_id, input_fingerprint, ..) of files in scope and online whose record of the component is complete, of this version and of the vector's own input."""
    record = states.filter((F.col("component") == component) & (F.col("status") == "complete") & (F.col("version") == version)).select("file_id", "input_fingerprint")
    return vectors.join(record, ["file_id", "input_fingerprint"], "left_semi").join(files.filter("in_scope and is_online").select("file_id"), "file_id", "left_semi")
