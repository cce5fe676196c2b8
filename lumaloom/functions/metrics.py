"""Column builders for distances, scores and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming_hex(a: Column, b: Column) -> Column:
    """Hamming distance of two 64-bit hashes in hex, by halves (no signed overflow)."""
    half = lambda c, at: F.conv(F.substring(F.lpad(c, 16, "0"), at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def rmse(a: Column, b: Column) -> Column:
    """Root mean squared difference; infinite for empty arrays or other lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), F.lit(float("inf"))).otherwise(F.sqrt(total / F.size(a)))


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit vector; null for empty, zero or non-finite ones."""
    length = F.sqrt(dot(v, v))
    return F.when((length > 0) & (length < float("inf")), F.transform(v, lambda x: x.cast("double") / length))


def visual_similarity(ham: Column, err: Column, hist: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - (ham / 64 + err + hist / 2) / 3)


def visual_match(ham: Column, err: Column, hist: Column) -> Column:
    """Gates: hash, luma and histogram all close."""
    return (ham <= 8) & (err <= 0.16) & (hist <= 0.18)


def burst_veto(ham: Column, err: Column, hist: Column) -> Column:
    """At least two of three strong differences."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return one(ham >= 28) + one(err >= 0.85) + one(hist >= 0.60) >= 2


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sample_count(duration: Column, fps: float, least: int, most: int) -> Column:
    return F.least(F.greatest(F.ceil(duration * fps), F.lit(least)), F.lit(most)).cast("int")


def sample_times(duration: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (i + 0.5) / n)


def top_quartile_mean(scores: Column) -> Column:
    """Mean of the best quarter, at least one; null without scores."""
    top = F.slice(F.sort_array(scores, False), 1, F.ceil(F.size(scores) * 0.25).cast("int"))
    return F.when(F.size(scores) > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top))


def video_score(scores: Column, requested: Column) -> tuple[Column, Column]:
    """(score, partial): the mean of the best quarter if three quarters of the requested samples succeeded; partial if not all did."""
    enough = F.size(scores) >= F.ceil(requested * 0.75)
    return F.when(enough, top_quartile_mean(scores)), enough & (F.size(scores) < requested)


def compression_metrics(reference: Column, compressed: Column, mse: Column) -> tuple[Column, Column, Column]:
    """(ratio, compressed percent, PSNR) with 3, 2 and 3 places."""
    return F.when(compressed != 0, F.bround(reference / compressed, 3)), F.when(reference != 0, F.bround(compressed / reference * 100, 2)), F.bround(psnr(mse), 3)


def estimated_bytes(size: Column, codec: Column, quality: Column, ratio: Column | None = None) -> Column:
    """Size after compression: by a profile's own ratio (held to 0.01..1) where it has one, else by what the codec's quality usually leaves; at least one byte of a file that is not empty."""
    q = F.bround(quality).cast("int")
    usual = F.when(codec == "jpeg-xl", F.when(q == 80, 0.5).when(q == 60, 0.35).when(q == 40, 0.25).otherwise(0.35)).otherwise(0.5)
    left = usual if ratio is None else F.when(ratio.isNull(), usual).otherwise(clamp(ratio, 0.01, 1.0))
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size * left))).cast("long")


def storage_delta(size: Column, output: Column, operation: Column, replace: Column) -> Column:
    """Bytes that an operation adds; a compression that replaces its source gives the source's bytes back."""
    return F.when(operation == "delete", -size).when(operation == "copy", size).when(operation == "move", 0).otherwise(output - F.when(replace, size).otherwise(0)).cast("long")


def technical_quality(focus_gradient: Column, underexposed: Column, overexposed: Column, contrast_stddev: Column, noise_mad: Column) -> Column:
    """struct<focus, exposure, contrast, noise, score> in 0..1, six places each, from measures of a picture's brightness; null where a measure is."""
    unit = lambda x: F.when(x.isNotNull(), clamp(x, 0.0, 1.0))
    parts = {
        "focus": unit((focus_gradient - 2.0) / 26.0),
        "exposure": 1.0 - unit((underexposed + overexposed) / 0.20),
        "contrast": unit((contrast_stddev - 8.0) / 56.0),
        "noise": 1.0 - unit(noise_mad / 18.0),
    }
    parts = {k: F.bround(v, 6) for k, v in parts.items()}
    score = 0.35 * parts["focus"] + 0.30 * parts["exposure"] + 0.20 * parts["contrast"] + 0.15 * parts["noise"]
    return F.struct(*[v.alias(k) for k, v in parts.items()], F.bround(score, 6).alias("score"))


def psnr(mse: Column) -> Column:
    return F.when(mse > 0, 10 * F.log10(F.lit(65025.0) / mse))


def quality_to_distance(quality: Column) -> Column:
    """Encoder distance of a 0-100 quality: 1.5 at 60, to four places."""
    return F.bround((100 - clamp(quality, 0, 100)) * 1.5 / 40, 4)


def distance_to_quality(distance: Column) -> Column:
    return F.bround(clamp(100 - distance * 40 / 1.5, 0, 100), 2)


def mercator_x(lon: Column) -> Column:
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    """World y in 0..1; latitudes are clamped to 85 degrees."""
    r = F.radians(clamp(lat, -85.0, 85.0))
    return (1 - F.ln(F.tan(F.lit(3.141592653589793) / 4 + r / 2)) / 3.141592653589793) / 2


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(3.141592653589793 * (1 - 2 * y))))
