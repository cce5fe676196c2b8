"""Scalar functions (S-1..34) and media sources (FLT-13, SRC-10/11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import metrics as X
from ..functions import times as T
from . import aggregate_queries as A
from .catalog import load
from .registry import query


@query("s_1_path_parts", "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages", views=False)
def s_1(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", M.parent_folder(u).alias("parent"), M.base_name(u).alias("base"))


@query("s_1_stem_extension", "SELECT file_id, substr(filename, 1, length(filename) - length(extension)) AS stem, extension FROM file")
def s_1b(spark, d):
    p = F.col("relative_path")
    return load(spark, d, "file").select("file_id", M.stem(p).alias("stem"), M.extension(p).alias("extension"))


@query("s_2_casefold", "SELECT file_id, lower(relative_path) AS folded FROM file")
def s_2(spark, d):
    return load(spark, d, "file").select("file_id", F.lower("relative_path").alias("folded"))


@query("s_3_literal_like", "SELECT page_id FROM pages WHERE contains(url, '%') OR contains(url, '_')", views=False)
def s_3(spark, d):
    return load(spark, d, "pages").filter(F.col("url").contains("%") | F.col("url").contains("_")).select("page_id")


@query("s_4_hamming", "SELECT file_id, CAST(bit_count(xor(CAST('0x' || substr(a, 1, 8) AS BIGINT), CAST('0x' || substr(b, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a, 9, 8) AS BIGINT), CAST('0x' || substr(b, 9, 8) AS BIGINT))) AS INT) AS distance FROM (SELECT file_id, substr(sha256, 1, 16) AS a, substr(sha256, 17, 16) AS b FROM file)")
def s_4(spark, d):
    return load(spark, d, "file").select("file_id", X.hamming_hex(F.substring("sha256", 1, 16), F.substring("sha256", 17, 16)).alias("distance"))


@query("s_5_6_array_distances", "SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(CAST(embedding[i] AS DOUBLE) - 0.1, 2))) / 64), 9) AS rmse, round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE) - 0.1))), 9) AS l1 FROM embeddings", views=False)
def s_5_6(spark, d):
    v, w = F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.1), 64)
    return load(spark, d, "embeddings").select("vec_id", F.round(X.rmse(v, w), 9).alias("rmse"), F.round(X.l1(v, w), 9).alias("l1"))


@query("s_7_8_visual_gates", "WITH m AS (SELECT job_id, CAST(job_id % 40 AS INT) AS ham, seconds / 100 AS err, (job_id % 13) / 13.0 AS hist FROM job) SELECT job_id, greatest(0.0, 1 - (ham / 64.0 + err + hist / 2) / 3) AS similarity, ham <= 8 AND err <= 0.16 AND hist <= 0.18 AS same, (CASE WHEN ham >= 28 THEN 1 ELSE 0 END + CASE WHEN err >= 0.85 THEN 1 ELSE 0 END + CASE WHEN hist >= 0.60 THEN 1 ELSE 0 END) >= 2 AS veto FROM m")
def s_7_8(spark, d):
    h, e, c = (F.col("job_id") % 40).cast("int"), F.col("seconds") / 100, (F.col("job_id") % 13) / F.lit(13.0)
    return load(spark, d, "job").select("job_id", X.visual_similarity(h, e, c).alias("similarity"), X.visual_match(h, e, c).alias("same"), X.burst_veto(h, e, c).alias("veto"))


@query("s_9_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) / n)), 6) AS length, round(CAST(embedding[1] AS DOUBLE) / sqrt(n), 6) AS first FROM (SELECT *, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM embeddings) WHERE n > 0", views=False)
def s_9(spark, d):
    u = load(spark, d, "embeddings").select("vec_id", X.normalized(F.col("embedding")).alias("u")).filter("u is not null")
    return u.select("vec_id", F.round(X.dot(F.col("u"), F.col("u")), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first"))


@query("s_10_half_precision")
def s_10(spark, d):
    """Values rounded through 16-bit floats, as they are stored (no SQL type for it)."""
    @F.pandas_udf("array<float>")
    def half(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x).astype(np.float16).astype(np.float32))

    return load(spark, d, "embeddings").select("vec_id", half("embedding").alias("stored"))


@query("s_12_13_14_capture_times", """WITH b AS (SELECT asset_id, TRY_CAST(capture_time AS TIMESTAMP) AS w, CASE WHEN asset_id % 13 = 0 THEN 'file_time' ELSE capture_time_kind END AS kind,
 CASE asset_id % 4 WHEN 0 THEN 10800 WHEN 1 THEN -19800 WHEN 2 THEN 0 END AS o FROM asset WHERE capture_time IS NOT NULL)
 SELECT asset_id, epoch_us(w) AS wall_us, CAST(1000000 AS BIGINT) AS precision_us, CASE WHEN kind = 'exif_offset' AND o IS NOT NULL THEN 'absolute' WHEN kind = 'exif_local_unknown' AND o IS NULL THEN 'local' END AS semantics,
 CASE WHEN kind = 'exif_offset' THEN epoch_us(w) / 1e6 - o WHEN kind = 'exif_local_unknown' AND o IS NULL THEN epoch_us(w) / 1e6 + 62135683200 END AS seconds FROM b""")
def s_12(spark, d):
    """Displayed clock, precision, and the axis that makes times comparable; offsets and kinds are mixed."""
    a = F.col("asset_id")
    zone = F.when(a % 4 == 0, "+03:00").when(a % 4 == 1, "-05:30").when(a % 4 == 2, "Z").otherwise("")
    v, k = F.concat("capture_time", zone), F.when(a % 13 == 0, "file_time").otherwise(F.col("capture_time_kind"))
    seconds = T.capture_seconds(v, k)
    return load(spark, d, "asset").filter("capture_time is not null").select("asset_id", T.wall_clock_us(v).alias("wall_us"), T.precision_us(v).alias("precision_us"), F.when(seconds.isNotNull(), T.semantics(k)).alias("semantics"), seconds.alias("seconds"))


@query("s_15_exif_time", "SELECT job_id, CASE WHEN job_id % 9 = 0 THEN 'unknown' ELSE strftime(stamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN job_id % 4 = 0 THEN '.' || CAST(job_id % 1000 AS STRING) ELSE '' END || CASE WHEN job_id % 5 = 0 THEN '+02:00' WHEN job_id % 5 = 1 THEN '+00:00' ELSE '' END END AS value FROM job")
def s_15(spark, d):
    j = F.col("job_id")
    raw = F.when(j % 9 == 0, "unknown").otherwise(F.date_format("stamp", "yyyy:MM:dd HH:mm:ss"))
    sub = F.when(j % 4 == 0, (j % 1000).cast("string"))
    zone = F.when(j % 5 == 0, "+02:00").when(j % 5 == 1, "Z")
    return load(spark, d, "job").select("job_id", T.exif_time(raw, sub, zone).alias("value"))


_EXIF = "CASE WHEN json_valid(text) THEN json_extract_string(text, '$.exif.{}') END".format


@query("s_16_best_precision", f"""WITH m AS (SELECT asset_id, file_id, is_online, relative_path, {_EXIF('DateTimeOriginal')} AS o, {_EXIF('SubSecTimeOriginal')} AS so, {_EXIF('OffsetTimeOriginal')} AS z, {_EXIF('DateTime')} AS t, {_EXIF('SubSecTime')} AS s FROM file JOIN metadata USING (file_id)),
 c AS (SELECT *, coalesce(o, t) AS v, CASE WHEN o IS NOT NULL THEN so ELSE s END AS sub FROM m WHERE coalesce(o, t) IS NOT NULL), k AS (SELECT *, CAST(1000000 // 10 ** coalesce(length(sub), 0) AS BIGINT) AS p FROM c)
 SELECT asset_id, replace(substr(v, 1, 10), ':', '-') || 'T' || substr(v, 12) || CASE WHEN CAST(sub AS INT) > 0 THEN '.' || rpad(sub, 6, '0') ELSE '' END || coalesce(z, '') AS value, CASE WHEN z IS NULL THEN 'exif_local_unknown' ELSE 'exif_offset' END AS kind, p AS precision_us
 FROM k QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY p, CASE WHEN is_online THEN 0 ELSE 1 END, relative_path, file_id) = 1""")
def s_16(spark, d):
    """The finest moment that an asset's files record; the first file's among equals."""
    from ..functions.pixels import held

    # text is parsed once a file, the moment told once
    text = held(load(spark, d, "metadata"), {"exif": F.from_json("text", "exif map<string,string>")["exif"]}).select("file_id", "exif")
    text = held(text, {"moment": T.exif_moment(F.col("exif"))}).select("file_id", "moment")
    j = load(spark, d, "file").join(text.filter("moment is not null"), "file_id")
    best = j.groupBy("asset_id").agg(F.min_by("moment", F.struct("moment.precision_us", ~F.col("is_online"), "relative_path", "file_id")).alias("m"))
    return best.select("asset_id", "m.value", "m.kind", "m.precision_us")


@query("s_17_wall_delta", "SELECT job_id, abs(epoch_us(stamp) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 1e6 AS delta FROM job")
def s_17(spark, d):
    t = F.date_format("stamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    delta = F.abs(T.wall_clock_us(t) - T.wall_clock_us(F.lit("2024-01-15T00:00:00"))) / 1e6
    return load(spark, d, "job").select("job_id", F.coalesce(delta, F.lit(float("inf"))).alias("delta"))


@query("s_18_gps_decimal", """WITH g AS (SELECT file_id, CASE WHEN file_id % 13 <> 0 THEN (CASE WHEN file_id % 2 = 0 THEN 1 ELSE -1 END) * (file_id % 90 + (file_id % 60) / 60.0::DOUBLE + (file_id % 5999) / 100.0::DOUBLE / 3600) END AS latitude, CASE WHEN file_id % 5 <> 0 THEN (file_id % 9000 / 10.0::DOUBLE) * CASE WHEN file_id % 3 = 0 THEN -1 ELSE 1 END END AS altitude_m, file_id % 24 AS h, file_id % 59 AS m, file_id % 7 AS s FROM file)
 SELECT file_id, latitude, altitude_m, '2024:05:06T' || lpad(CAST(h AS STRING), 2, '0') || ':' || lpad(CAST(m AS STRING), 2, '0') || ':' || lpad(CAST(s AS STRING), 2, '0') || CASE WHEN file_id % 2 = 0 THEN '.5' ELSE '' END AS timestamp FROM g""")
def s_18(spark, d):
    """Degrees, minutes and seconds as rationals, altitude below the sea, time of the fix."""
    f = F.col("file_id")
    text = lambda c: c.cast("string")
    over = lambda n, k: F.concat(text(n), F.lit(f"/{k}"))
    gps = F.struct(
        F.array(over(f % 90, 1), F.when(f % 13 == 0, "1/0").otherwise(text(f % 60)), over(f % 5999, 100)).alias("GPSLatitude"), F.when(f % 2 == 0, "n").otherwise("s").alias("GPSLatitudeRef"),
        F.array(F.lit("1"), F.lit("2")).alias("GPSLongitude"), F.lit("E").alias("GPSLongitudeRef"), F.when(f % 5 == 0, "deep").otherwise(over(f % 9000, 10)).alias("GPSAltitude"), F.when(f % 3 == 0, "1").otherwise("0").alias("GPSAltitudeRef"),
        F.lit(None).cast("string").alias("GPSImgDirection"), F.lit("2024:05:06").alias("GPSDateStamp"), F.array(text(f % 24), over(f % 59, 1), F.concat(text(f % 7), F.when(f % 2 == 0, ".5").otherwise(".0"))).alias("GPSTimeStamp"),
    )
    return load(spark, d, "file").select("file_id", M.gps_position(gps).alias("g")).select("file_id", "g.latitude", "g.altitude_m", "g.timestamp")


@query("s_19_mercator", "WITH p AS (SELECT file_id, (file_id % 3600) / 10.0 - 180 AS lon, (file_id % 1790) / 10.0 - 89 AS lat FROM file) SELECT file_id, round((lon + 180) / 360, 9) AS x, round((1 - ln(tan(pi() / 4 + radians(least(greatest(lat, -85.0), 85.0)) / 2)) / pi()) / 2, 9) AS y FROM p")
def s_19(spark, d):
    lon, lat = (F.col("file_id") % 3600) / F.lit(10.0) - 180, (F.col("file_id") % 1790) / F.lit(10.0) - 89
    return load(spark, d, "file").select("file_id", F.round(X.mercator_x(lon), 9).alias("x"), F.round(X.mercator_y(lat), 9).alias("y"))


@query("s_20_fingerprints", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'stat:' || size_bytes || ':' || file_id ELSE sha256 END AS fingerprint, sha256(sha256 || '|' || 'model-1' || '|' || size_bytes) AS derived FROM file")
def s_20(spark, d):
    sha = F.when(F.col("file_id") % 3 != 0, F.col("sha256"))
    return load(spark, d, "file").select("file_id", F.coalesce(sha, F.concat_ws(":", F.lit("stat"), F.col("size_bytes").cast("string"), F.col("file_id").cast("string"))).alias("fingerprint"), F.sha2(F.concat_ws("|", "sha256", F.lit("model-1"), F.col("size_bytes").cast("string")), 256).alias("derived"))


@query("s_21_sample_times", "WITH n AS (SELECT file_id, duration, CAST(least(greatest(ceil(duration * 2.0), 2), 32) AS INT) AS n FROM file WHERE duration IS NOT NULL) SELECT file_id, n, CAST(i AS INT) AS sample, duration * (i + 0.5) / n AS seconds FROM n, LATERAL (SELECT unnest(range(0, n)) AS i)")
def s_21(spark, d):
    f = load(spark, d, "file").filter("duration is not null").withColumn("n", X.sample_count(F.col("duration"), 2.0, 2, 32))
    return f.select("file_id", "n", F.posexplode(X.sample_times(F.col("duration"), F.col("n"))).alias("sample", "seconds"))


@query("s_22_technical_quality", """WITH m AS (SELECT job_id, seconds AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM job), p AS (SELECT job_id, round_even(least(greatest((2.0 + v * CAST(0.26 AS DOUBLE) - 2.0) / 26.0, 0.0), 1.0), 6) AS focus, round_even(1.0 - least(greatest((k / 1000 + v / 1000) / CAST(0.2 AS DOUBLE), 0.0), 1.0), 6) AS exposure,
 round_even(least(greatest((8.0 + k * CAST(0.56 AS DOUBLE) - 8.0) / 56.0, 0.0), 1.0), 6) AS contrast, round_even(1.0 - least(greatest(v * CAST(0.36 AS DOUBLE) / 18.0, 0.0), 1.0), 6) AS noise FROM m) SELECT *, round_even(0.35 * focus + 0.30 * exposure + 0.20 * contrast + 0.15 * noise, 6) AS score FROM p""")
def s_22(spark, d):
    """Four components of measures that an event carries, and their weighted score (measures of a step that leaves no ties at the last place)."""
    v, k = F.col("seconds"), F.get_json_object("props", "$.k").cast("double")
    return load(spark, d, "job").select("job_id", X.technical_quality(2.0 + v * 0.26, k / 1000, v / 1000, 8.0 + k * 0.56, v * 0.36).alias("q")).select("job_id", "q.*")


@query("s_23_compression_metrics", """WITH p AS (SELECT file_id, size_bytes AS r, CASE WHEN file_id % 40 = 0 THEN 0 ELSE CAST(floor(size_bytes * (file_id % 97) / 100.0) AS BIGINT) END AS c, CASE WHEN file_id % 10 = 0 THEN 0.0 ELSE CAST(file_id % 700 AS DOUBLE) / 8 END AS mse FROM file)
 SELECT file_id, CASE WHEN c <> 0 THEN round_even(CAST(r AS DOUBLE) / c, 3) END AS ratio, CASE WHEN r <> 0 THEN round_even(CAST(c AS DOUBLE) / r * 100, 2) END AS compressed_percent, CASE WHEN mse > 0 THEN round_even(10 * log10(65025.0 / mse), 3) END AS psnr FROM p""")
def s_23(spark, d):
    """Ratio, percent of the reference and PSNR, rounded as they are shown; null where a size or the error is zero."""
    f, r = F.col("file_id"), F.col("size_bytes")
    c = F.when(f % 40 == 0, 0).otherwise(F.floor(r * (f % 97) / F.lit(100.0)).cast("long"))
    mse = F.when(f % 10 == 0, 0.0).otherwise((f % 700).cast("double") / 8)
    return load(spark, d, "file").select("file_id", *[x.alias(n) for n, x in zip(("ratio", "compressed_percent", "psnr"), X.compression_metrics(r, c, mse), strict=True)])


@query("s_24_estimates", """WITH p AS (SELECT file_id, size_bytes, CASE file_id % 5 WHEN 0 THEN 'copy' WHEN 1 THEN 'move' WHEN 2 THEN 'delete' ELSE 'compress' END AS op, CASE WHEN file_id % 3 = 0 THEN 'av1' ELSE 'jpeg-xl' END AS codec, CASE file_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 60 WHEN 2 THEN 40 ELSE 75 END AS q, file_id % 7 < 3 AS rep, CASE file_id % 9 WHEN 0 THEN 0.001 WHEN 1 THEN 0.42 WHEN 2 THEN 7.0 END AS own FROM file),
 o AS (SELECT *, CASE WHEN size_bytes = 0 THEN 0 ELSE CAST(greatest(1, floor(size_bytes * CAST(CASE WHEN own IS NOT NULL THEN least(greatest(own, 0.01), 1.0) WHEN codec = 'av1' THEN 0.5 WHEN q = 80 THEN 0.5 WHEN q = 40 THEN 0.25 ELSE 0.35 END AS DOUBLE))) AS BIGINT) END AS output_bytes FROM p)
 SELECT file_id, output_bytes, CASE op WHEN 'delete' THEN -size_bytes WHEN 'copy' THEN size_bytes WHEN 'move' THEN 0 ELSE output_bytes - CASE WHEN rep THEN size_bytes ELSE 0 END END AS delta FROM o""")
def s_24(spark, d):
    """Size after compression by codec and quality, and what each operation adds to the store."""
    f, size = F.col("file_id"), F.col("size_bytes")
    op = F.when(f % 5 == 0, "copy").when(f % 5 == 1, "move").when(f % 5 == 2, "delete").otherwise("compress")
    codec = F.when(f % 3 == 0, "av1").otherwise("jpeg-xl")
    quality = F.when(f % 4 == 0, 80.0).when(f % 4 == 1, 60.0).when(f % 4 == 2, 40.0).otherwise(75.0)
    own = F.when(f % 9 == 0, 0.001).when(f % 9 == 1, 0.42).when(f % 9 == 2, 7.0)
    out = X.estimated_bytes(size, codec, quality, own)
    return load(spark, d, "file").select("file_id", out.alias("output_bytes"), X.storage_delta(size, out, op, f % 7 < 3).alias("delta"))


@query("s_25_group_ids", "SELECT group_id, substr(sha256('strict-group-v1:' || string_agg(CAST(asset_id AS STRING), '|' ORDER BY CAST(asset_id AS STRING))), 1, 24) AS digest FROM asset WHERE group_id IS NOT NULL GROUP BY group_id")
def s_25(spark, d):
    g = load(spark, d, "asset").filter("group_id is not null").groupBy("group_id").agg(F.array_sort(F.collect_list(F.col("asset_id").cast("string"))).alias("x"))
    return g.select("group_id", F.substring(F.sha2(F.concat(F.lit("strict-group-v1:"), F.array_join("x", "|")), 256), 1, 24).alias("digest"))


@query("s_26_selection_digest", "SELECT asset_id, sha256('[' || string_agg(CAST(file_id AS STRING), ',' ORDER BY file_id) || ']') AS digest FROM file GROUP BY asset_id")
def s_26(spark, d):
    """The digest of a selection is defined on its sorted list; here every asset's files are one."""
    g = load(spark, d, "file").groupBy("asset_id").agg(F.array_sort(F.collect_list("file_id")).alias("x"))
    return g.select("asset_id", F.sha2(F.to_json("x"), 256).alias("digest"))


@query("s_27_targets", "SELECT file_id, CASE WHEN folder = '' THEN 'export' ELSE 'export/' || folder END || '/' || substr(filename, 1, length(filename) - length(extension)) || '_web' || substr(filename, length(filename) - length(extension) + 1) AS target FROM file")
def s_27(spark, d):
    from ..operators.planning import target_path

    return load(spark, d, "file").select("file_id", target_path(F.col("relative_path"), "export", "{stem}_web{ext}").alias("target"))


@query("s_28_path_safety", r"SELECT page_id, CASE WHEN regexp_matches(url, '(^|/)\.\.(/|$)') THEN 'parent' WHEN regexp_matches(url, '[<>:\"|?*]') THEN 'character' END AS problem FROM pages", views=False)
def s_28(spark, d):
    from ..operators.planning import path_problem

    return load(spark, d, "pages").select("page_id", path_problem(F.col("url")).alias("problem"))


@query("s_29_tolerant_json", "SELECT job_id, CASE WHEN job_id % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM job")
def s_29(spark, d):
    text = F.when(F.col("job_id") % 11 == 0, "{broken").otherwise(F.col("props"))
    return load(spark, d, "job").select("job_id", F.from_json(text, "k int")["k"].alias("k"))


@query("s_30_conflict_policy", "SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'replace' WHEN job_id % 2 = 0 THEN 'skip' ELSE 'rename' END AS policy FROM job")
def s_30(spark, d):
    policy = F.when(F.col("job_id") % 3 == 0, "replace")
    legacy = F.col("job_id") % 2 != 0  # rename_on_conflict
    return load(spark, d, "job").select("job_id", F.coalesce(policy, F.when(legacy, "rename").otherwise("skip")).alias("policy"))


@query("s_31_calendar_buckets", """WITH j AS (SELECT job_id, CAST(stamp AS TIMESTAMP) AS t, CASE job_id % 5 WHEN 0 THEN 31536000 WHEN 1 THEN 7776000 WHEN 2 THEN 2592000 WHEN 3 THEN 604800 ELSE 1 END::BIGINT AS i FROM job),
 b AS (SELECT *, CASE i WHEN 31536000 THEN date_trunc('year', t) WHEN 7776000 THEN date_trunc('quarter', t) WHEN 2592000 THEN date_trunc('month', t) END AS c, CASE i WHEN 31536000 THEN INTERVAL 12 MONTH WHEN 7776000 THEN INTERVAL 3 MONTH ELSE INTERVAL 1 MONTH END AS step, epoch_us(t) // (i * 1000000) * (i * 1000000) AS f FROM j)
 SELECT CAST(i AS INT) AS interval_s, coalesce(epoch_us(CAST(c AS TIMESTAMP)), f) AS start_us, coalesce(epoch_us(CAST(c + step AS TIMESTAMP)), f + i * 1000000) AS end_us, count(*) AS n FROM b GROUP BY ALL""")
def s_31(spark, d):
    """Buckets of calendar years, quarters and months, or of fixed length, by interval."""
    from ..operators.lod import bucket_bounds

    j = F.col("job_id")
    interval = F.when(j % 5 == 0, 31536000).when(j % 5 == 1, 7776000).when(j % 5 == 2, 2592000).when(j % 5 == 3, 604800).otherwise(1)
    start, end = bucket_bounds(F.unix_micros(F.col("stamp").cast("timestamp")), interval.cast("long") * 1_000_000)
    return load(spark, d, "job").select(interval.alias("interval_s"), start.alias("start_us"), end.alias("end_us")).groupBy("interval_s", "start_us", "end_us").agg(F.count("*").alias("n"))


@query("s_32_bucket_interval", "WITH span AS (SELECT (epoch_us(max(stamp)) - epoch_us(min(stamp))) * 92.0 / 1200 AS target FROM job), l AS (SELECT unnest([1000000, 60000000, 3600000000, 21600000000, 86400000000, 604800000000]) AS step) SELECT step AS interval_us FROM l, span ORDER BY abs(ln(step / target)), step LIMIT 1")
def s_32(spark, d):
    from ..operators.lod import LADDER_US, bucket_interval

    t = load(spark, d, "job").agg(F.min(F.unix_micros(F.col("stamp").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("stamp").cast("timestamp"))).alias("b"))
    return t.select(bucket_interval(F.col("b") - F.col("a"), 1200, LADDER_US).alias("interval_us"))


@query("s_33_encoder_distance", "SELECT job_id, round_even((100 - least(q, 100.0)) * 1.5 / 40, 4) AS distance, round_even(least(greatest(100 - q / 25 * 40 / 1.5, 0.0), 100.0), 2) AS quality FROM (SELECT job_id, CAST(job_id % 111 AS DOUBLE) AS q FROM job)")
def s_33(spark, d):
    q = (F.col("job_id") % 111).cast("double")
    return load(spark, d, "job").select("job_id", X.quality_to_distance(q).alias("distance"), X.distance_to_quality(q / 25).alias("quality"))


_KIND_SQL = "CASE kind WHEN 'view' THEN 'media_index' WHEN 'click' THEN 'media_thumbnails' WHEN 'purchase' THEN 'media_quality' WHEN 'signup' THEN 'embeddings' ELSE 'export' END"


@query("s_34_eta", f"""WITH {A.TIMED_SQL}, j AS (SELECT job_id, status, kind, 100 AS total, CASE WHEN job_id % 3 = 0 THEN 0 ELSE job_id % 130 END AS done, epoch_us(stamp) AS started, CASE WHEN job_id % 11 = 0 THEN seconds - 5 END AS step FROM job)
 SELECT job_id, CASE WHEN step IS NOT NULL THEN greatest(0.0, step) WHEN total > done AND done > 0 THEN (total - done) * greatest(CAST(0.001 AS DOUBLE), (1706745600000000 - started) / 1e6) / done
  ELSE greatest(1.0, greatest(1, total - done) * CASE kind WHEN 'view' THEN {A._rate('metadata.processing')} WHEN 'click' THEN {A._rate('thumbnail.image')} WHEN 'purchase' THEN {A._rate('quality.image')} WHEN 'signup' THEN {A._rate('embedding.image')} ELSE 0.0 END) END AS eta FROM j WHERE status IN ('pending', 'running')""")
def s_34(spark, d):
    """Time left of jobs at a moment: by their step, by their pace, or by the rates of the latest jobs."""
    from ..operators.estimates import job_seconds

    j = F.col("job_id")
    jobs = load(spark, d, "job").filter("status in ('pending', 'running')").select(
        "job_id", "status", F.expr(_KIND_SQL).alias("kind"), F.lit(100).alias("total"), F.when(j % 3 == 0, 0).otherwise(j % 130).alias("completed"), F.col("stamp").cast("timestamp").alias("started"), F.when(j % 11 == 0, F.col("seconds") - 5).alias("eta"),
    )
    return job_seconds(jobs, A.rates_of(spark, d), F.timestamp_seconds(F.lit(1706745600))).select("job_id", F.col("seconds").alias("eta"))


@query("flt_13_valid_gps", "SELECT job_id, k <= 80 AND job_id % 5 <> 0 AS valid FROM (SELECT job_id, CAST(json_extract_string(props, '$.k') AS INT) + 10 AS k FROM job)")
def flt_13(spark, d):
    lat = F.when(F.col("job_id") % 5 == 0, "none").otherwise((F.get_json_object("props", "$.k").cast("int") + 20).cast("string"))
    ok = M.valid_gps(lat, F.lit(10.0))
    return load(spark, d, "job").select("job_id", ok.alias("valid"))


@query("src_11_probe_json", "SELECT job_id, CASE WHEN job_id % 2 = 0 THEN CAST(job_id % 30 AS DOUBLE) ELSE seconds END AS duration, 'hevc' AS codec FROM job")
def src_11(spark, d):
    """First video stream; the container's duration where the stream has none."""
    own = F.when(F.col("job_id") % 2 == 0, F.concat(F.lit(', "duration": "'), (F.col("job_id") % 30).cast("string"), F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "hevc"'), own, F.lit('}], "format": {"duration": "'), F.col("seconds").cast("string"), F.lit('"}}'))
    j = F.from_json(text, "streams array<struct<codec_type: string, codec_name: string, duration: string>>, format struct<duration: string>")
    video = F.element_at(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), 1)
    return load(spark, d, "job").select("job_id", F.coalesce(video["duration"], j["format"]["duration"]).try_cast("double").alias("duration"), video["codec_name"].alias("codec"))
