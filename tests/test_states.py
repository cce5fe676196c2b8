"""Component records: readiness, errors and fresh vectors against row-wise models."""

import itertools

from pyspark.sql import functions as F

from lumaloom.operators import states as S

FILE = "file_id long, extension string, media_type string, sha256 string, size_bytes long, mtime long, quality_score double, quality_algorithm string, quality_version string"
STATE = "file_id long, component string, version string, status string, input_fingerprint string, output_path string, output_fingerprint string"


def model(file, state, component, version, scoring):
    """Whether a record is up to date, as the rules are stated."""
    if state is None or state["version"] != version:
        return False
    retried = file["extension"].lower() == ".jxl" and component in ("metadata", "thumbnail")
    if state["status"] == "unsupported" and not retried:
        return True
    mark = file["sha256"] or f"stat:{file['size_bytes']}:{file['mtime']}"
    done = state["status"] == "complete" and state["input_fingerprint"] == mark
    if component == "metadata":
        return done
    if component == "thumbnail":
        return done and bool(state["output_path"]) and state["output_fingerprint"] is not None
    if not scoring:
        return state["status"] == "not_requested" or (done and file["quality_score"] is not None)
    if file["media_type"] == "video":
        return state["status"] == "not_requested"
    return done and file["quality_score"] is not None and file["quality_algorithm"] == "a" and file["quality_version"] == version


def test_readiness_of_every_combination(spark):
    kinds = [(".JXL", "image"), (".png", "image"), (".mp4", "video")]
    scores = [(None, None, None), (0.5, "a", "q2"), (0.5, "a", "q1"), (0.5, None, None)]
    records = [None, *itertools.product(["v", "q2"], ["complete", "unsupported", "not_requested", "failed", None], ["h", "stat:5:7", None], [("", "m"), ("p", None), ("p", "m"), (None, "m")])]
    files, states = [], []
    for (ext, media), sha, score, record in itertools.product(kinds, ["h", None], scores, records):
        key = len(files)
        files.append((key, ext, media, sha, 5, 7, *score))
        if record:
            version, status, mark, output = record
            states += [(key, c, version, status, mark, *output) for c in ("metadata", "thumbnail", "quality")]
    versions = {"metadata": "v", "thumbnail": "v", "quality": "q2"}
    names = [f.split()[0] for f in STATE.split(", ")]
    by = {(s[0], s[1]): dict(zip(names, s, strict=True)) for s in states}
    fields = [f.split()[0] for f in FILE.split(", ")]
    for scoring in (True, False):
        got = S.pending_work(spark.createDataFrame(files, FILE), spark.createDataFrame(states, STATE), versions, "a", scoring).select("file_id", F.map_keys("pending").alias("p")).collect()
        assert len(got) == len(files)
        for row in got:
            f = dict(zip(fields, files[row["file_id"]], strict=True))
            assert set(row["p"]) == {c for c, v in versions.items() if not model(f, by.get((row["file_id"], c)), c, v, scoring)}, f


def test_errors_stand_until_every_component_is_settled(spark):
    states = [(1, "metadata", "complete"), (1, "thumbnail", "not_requested"), (2, "metadata", "complete"), (3, "metadata", "complete"), (3, "thumbnail", "failed"), (4, "embedding:a", "complete"), (4, "embedding:b", "failed"), (5, "embedding:a", "complete"), (1, "quality", None)]
    errors = [(1, "media_index", "x"), (2, "media_index", "x"), (3, "media_index", "x"), (1, "media_thumbnails", "x"), (1, "media_quality", "x"), (4, "embeddings", "x"), (5, "embeddings", "x"), (1, "embeddings", "x"), (None, "media_index", "x"), (1, "scan", "x"), (1, None, "x")]
    e, s = spark.createDataFrame(errors, "file_id long, kind string, note string"), spark.createDataFrame(states, "file_id long, component string, status string")
    left = {(r[0], r[1]) for r in S.unresolved_errors(e, s).collect()}
    assert left == {(2, "media_index"), (3, "media_index"), (1, "media_quality"), (4, "embeddings"), (1, "embeddings"), (None, "media_index"), (1, "scan"), (1, None)}
    assert S.unresolved_errors(e, s.limit(0)).count() == len(errors) and S.unresolved_errors(e.limit(0), s).count() == 0


def test_fresh_vectors_need_the_record_of_their_input(spark):
    v = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "a")], "file_id long, input_fingerprint string")
    f = spark.createDataFrame([(i, i != 5, i != 6) for i in range(1, 7)], "file_id long, in_scope boolean, is_online boolean")
    rows = [(1, "e", "v", "complete", "a"), (2, "e", "old", "complete", "a"), (3, "e", "v", "complete", "a"), (4, "e", "v", "complete", None), (5, "e", "v", "complete", "a"), (6, "e", "v", "complete", "a"), (2, "other", "v", "complete", "a")]
    s = spark.createDataFrame(rows, "file_id long, component string, version string, status string, input_fingerprint string")
    assert [r["file_id"] for r in S.fresh_vectors(v, f, s, "e", "v").collect()] == [1]


def test_first_fields_of_records_are_those_of_the_greatest_record(spark):
    """Fewer fields cross the exchange, and they are the ones of the record that counts."""
    import random

    from lumaloom.operators.states import FIELDS, by_component

    rng = random.Random(5)
    rows = [(rng.randrange(20), rng.choice("ab"), *[rng.choice([None, "", "x", "y"]) for _ in FIELDS]) for _ in range(200)]
    states = spark.createDataFrame(rows, "file_id long, component string, " + ", ".join(f"{f} string" for f in FIELDS))
    few = by_component(states, ["a", "b"], {"a": 2, "b": 4})
    assert few.schema["a"].dataType.names == FIELDS[:2] and few.schema["b"].dataType.names == FIELDS[:4]
    full = {r["file_id"]: r for r in by_component(states, ["a", "b"]).collect()}
    for r in few.collect():
        for c, n in (("a", 2), ("b", 4)):
            assert (r[c] and tuple(r[c])) == (full[r["file_id"]][c] and tuple(full[r["file_id"]][c])[:n])
