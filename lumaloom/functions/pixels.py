"""Column builders over pixel grids: arrays of whole numbers 0 to 255, row by row.

A grid is an array and its width; colours are three grids.  Everything is made
of higher-order functions, so it stays in compiled code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of 65536 that red, green and blue have in the luma of ITU-R 601.
RED, GREEN, BLUE = 19595, 38470, 7471


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey grid of three colour grids."""
    part = F.zip_with(F.zip_with(red, green, lambda r, g: r * RED + g * GREEN), blue, lambda rg, b: rg + b * BLUE)
    return F.transform(part, lambda s: F.shiftright((s + 32768).cast("int"), 16))


def triangle(x: Column) -> Column:
    """Bilinear kernel: reaches one step."""
    return F.greatest(1 - F.abs(x), F.lit(0.0))


def lanczos(x: Column) -> Column:
    """Windowed sinc that reaches three steps."""
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v * 3.141592653589793) / (v * 3.141592653589793))
    return F.when(F.abs(x) < 3, sinc(x) * sinc(x / 3)).otherwise(0.0)


#: kernel -> how far it reaches.
REACH: dict[Callable, int] = {triangle: 1, lanczos: 3}


def _taps(size: Column, target: int, kernel: Callable) -> Column:
    """array<struct<start, w>>: for every output place the input places it is made of, and how much of each, not yet adding up to one.

    The kernel is as wide as an output place if the grid shrinks, so every input counts.
    """
    scale = size / F.lit(float(target))
    wide = F.greatest(scale, F.lit(1.0))
    reach = F.lit(float(REACH[kernel])) * wide
    places = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.struct(
        ((i + 0.5) * scale).alias("centre"), F.greatest(F.floor((i + 0.5) * scale - reach + 0.5), F.lit(0)).cast("int").alias("start"), F.least(F.floor((i + 0.5) * scale + reach + 0.5), size).cast("int").alias("end")))
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.transform(F.sequence(p["start"], F.greatest(p["end"] - 1, p["start"])), lambda j: kernel((j - p["centre"] + 0.5) / wide)).alias("w")))


def _shares(taps: Column) -> Column:
    """Taps that add up to one."""
    summed = F.transform(taps, lambda t: F.struct(t["start"].alias("start"), t["w"].alias("w"), F.aggregate(t["w"], F.lit(0.0), lambda a, w: a + w).alias("total")))
    return F.transform(summed, lambda t: F.struct(t["start"].alias("start"), F.transform(t["w"], lambda w: w / t["total"]).alias("w")))


def _pixel(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once a row.

    The optimiser moves a column into the one place that names it; inside a lambda
    that would work it out for every element.  It does not move what a generator makes.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def resized(df: DataFrame, grids: dict[str, str], width: str, target_width: int, target_height: int, kernel: Callable = triangle) -> DataFrame:
    """df with grids at another size, {new column: column}: rows first, then columns, whole numbers after each.

    Each step is a column of its own: lambdas of one step do not repeat those of the one before.
    """
    first = next(iter(grids.values()))
    out = held(df, {"__height": (F.size(first) / F.col(width)).cast("int")})
    out = held(out, {"__taps_across": _taps(F.col(width), target_width, kernel), "__taps_down": _taps(F.col("__height"), target_height, kernel)})
    out = held(out, {"__across": _shares(F.col("__taps_across")), "__down": _shares(F.col("__taps_down"))})
    lines, places = F.sequence(F.lit(0), F.col("__height") - 1), F.sequence(F.lit(1), F.lit(target_width))

    def weighed(grid: str, shares: Column, index: Callable) -> Column:
        # pixels are read one by one: cutting a slice would copy the grid each time
        parts = F.transform(shares, lambda w, i: F.element_at(grid, index(i).cast("int")) * w)
        return _pixel(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))

    def rows(grid: str) -> Column:
        return F.flatten(F.transform(lines, lambda y: F.transform("__across", lambda s: weighed(grid, s["w"], lambda i: y * F.col(width) + s["start"] + i + 1))))

    def columns(flat: str) -> Column:
        return F.flatten(F.transform("__down", lambda s: F.transform(places, lambda x: weighed(flat, s["w"], lambda i: (s["start"] + i) * target_width + x))))

    wide = {f"__rows_{n}": rows(c) for n, c in grids.items()}
    out = held(out, wide)
    down = {n: columns(f"__rows_{n}") for n in grids}
    return held(out, down).drop("__height", "__taps_across", "__taps_down", "__across", "__down", *wide)


def gradient_bits(grid: Column, ties: bool = False) -> Column:
    """Of a grid 9 wide and 8 high: whether each pixel is brighter than its right neighbour (or, with ``ties``, as bright)."""
    place = F.sequence(F.lit(0), F.lit(63))
    at = lambda i: F.element_at(grid, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int"))
    right = lambda i: F.element_at(grid, (F.floor(i / 8) * 9 + i % 8 + 2).cast("int"))
    return F.transform(place, lambda i: (at(i) >= right(i) if ties else at(i) > right(i)).cast("int"))


def hex_hash(bits: Column) -> Column:
    """64 bits as 16 hex digits, the first bit highest."""
    nibble = lambda i: F.aggregate(F.slice(bits, i * 4 + 1, 4), F.lit(0), lambda a, b: a * 2 + b)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lower(F.hex(nibble(i).cast("long")))), "")


def standardised(grid: Column) -> Column:
    """Brightness 0 to 1 less its mean, over its deviation (1 for an even grid), to six places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(grid, start, lambda a, p: F.struct((a["n"] + 1).alias("n"), (a["s"] + p).alias("s"), (a["q"] + p * p).alias("q")))
    facts = F.struct((sums["s"] / sums["n"]).alias("mean"), F.sqrt((sums["n"] * sums["q"] - sums["s"] * sums["s"]) / (sums["n"] * sums["n"])).alias("spread"))
    one = F.transform(F.array(facts), lambda f: F.transform(grid, lambda p: F.bround((p - f["mean"]) / F.when(f["spread"] == 0, 255.0).otherwise(f["spread"]), 6)))
    return F.element_at(one, 1)


def histogram_counts(grid: Column, bins: int) -> Column:
    """Number of a grid's pixels in each of ``bins`` equal ranges."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(grid, lambda p: F.floor(p * bins / 256) == i)))


def histogram(grid: Column, bins: int) -> Column:
    """Share of a grid's pixels in each of ``bins`` equal ranges, to six places."""
    return F.transform(histogram_counts(grid, bins), lambda n: F.bround(n / F.size(grid), 6))


def visual_features(df: DataFrame, red: str, green: str, blue: str, width: str) -> DataFrame:
    """df with dhash (16 hex digits), luma (16 x 16, standardised) and color_hist (3 x 8 shares of a 32 x 32 picture)."""
    out = held(df, {"__grey": luma(F.col(red), F.col(green), F.col(blue))})
    out = resized(out, {"__hash": "__grey"}, width, 9, 8, lanczos)
    out = resized(out, {"__luma": "__grey"}, width, 16, 16)
    out = resized(out, {"__red": red, "__green": green, "__blue": blue}, width, 32, 32)
    out = held(out, {"__bits": gradient_bits(F.col("__hash"))})
    found = {"dhash": hex_hash(F.col("__bits")), "luma": standardised(F.col("__luma")), "color_hist": F.concat(*[histogram(F.col(c), 8) for c in ("__red", "__green", "__blue")])}
    return out.withColumns(found).drop("__grey", "__hash", "__luma", "__red", "__green", "__blue", "__bits")


def identity_features(df: DataFrame, red: str, green: str, blue: str, width: str) -> DataFrame:
    """df with what two pictures are held against each other by: small_red, small_green, small_blue (32 x 32) and bits (64, by the smaller picture's grey)."""
    out = resized(df, {"small_red": red, "small_green": green, "small_blue": blue}, width, 32, 32)
    out = held(out, {"__grey": luma(F.col("small_red"), F.col("small_green"), F.col("small_blue")), "__side": F.lit(32)})
    out = resized(out, {"__hash": "__grey"}, "__side", 9, 8)
    return out.withColumn("bits", gradient_bits(F.col("__hash"), ties=True)).drop("__grey", "__side", "__hash")


def mean_squared_error(left: list[Column], right: list[Column]) -> Column:
    """Over all pixels and channels; null for grids of different sizes."""
    total = sum((F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, d: s + d) for a, b in zip(left, right)), F.lit(0).cast("long"))
    return F.when(F.size(left[0]) == F.size(right[0]), total / (F.size(left[0]) * len(left)))


def oriented(grid: Column, width: Column, orientation: Column) -> Column:
    """The picture upright, from how its camera was held: the eight mirrored and turned readings; 5 to 8 change sides."""
    height = (F.size(grid) / width).cast("int")
    turned = orientation.between(5, 8)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    # where output (x, y) lies in the input
    sources = {2: lambda x, y: (width - 1 - x, y), 3: lambda x, y: (width - 1 - x, height - 1 - y), 4: lambda x, y: (x, height - 1 - y), 5: lambda x, y: (y, x), 6: lambda x, y: (y, height - 1 - x), 7: lambda x, y: (width - 1 - y, height - 1 - x), 8: lambda x, y: (width - 1 - y, x)}

    def pixel(i: Column) -> Column:
        x, y = (i % w).cast("int"), F.floor(i / w).cast("int")
        index = y * width + x
        for code, of in sources.items():
            sx, sy = of(x, y)
            index = F.when(orientation == code, sy * width + sx).otherwise(index)
        return F.element_at(grid, (index + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), w * h - 1), pixel)


def difference_map(left: list[Column], right: list[Column]) -> tuple[Column, Column]:
    """(map, maximum): how far each pixel is off, on a logarithmic scale of 0 to 255, and the largest mean square of a pixel."""
    squares = [F.zip_with(a, b, lambda x, y: (x - y) * (x - y)) for a, b in zip(left, right)]
    total = squares[0]
    for more in squares[1:]:
        total = F.zip_with(total, more, lambda x, y: x + y)
    each = F.transform(total, lambda s: s / F.lit(float(len(left))))
    top = F.array_max(each)
    return F.transform(each, lambda e: F.when(top > 0, F.rint(F.log1p(e) / F.log1p(top) * 255)).otherwise(0).cast("int")), top
