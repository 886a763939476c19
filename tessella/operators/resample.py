"""Resizing: integer nearest neighbour, and separable resampling with ten filters.

A weight table (dst, src, w) has a few rows for each line of the result. It depends on the sizes alone, is made on the driver
and broadcast: at most MOST_WEIGHTS rows, beyond which it is joined by key. Each pass is a join and a grouped sum
that is aggregated in part before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.color import clamp
from tessella.operators.geometry import crop

MOST_WEIGHTS = 1_000_000


def sinc(t: float) -> float:
    return math.sin(t * math.pi) / (t * math.pi) if t else 1.0


def cubic(t: float, b: float, c: float) -> float:
    """The family of cubic filters with two parameters."""
    t = abs(t)
    if t < 1:
        return ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t**2 + 6 - 2 * b) / 6
    return ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t**2 + (-12 * b - 48 * c) * t + 8 * b + 24 * c) / 6 if t < 2 else 0.0


#: name -> (function, radius)
FILTERS: dict[str, tuple[Callable[[float], float], float]] = {
    "nearest": (lambda t: 1.0 if -0.5 < t <= 0.5 else 0.0, 1.0),
    "linear": (lambda t: max(0.0, 1 - abs(t)), 1.0),
    "cosine": (lambda t: (math.cos(math.pi * t) + 1) / 2 if abs(t) < 1 else 0.0, 1.0),
    "hermite": (lambda t: (2 * abs(t) - 3) * t * t + 1 if abs(t) < 1 else 0.0, 1.0),
    "quadratic": (lambda t: 0.75 - t * t if abs(t) < 0.5 else (abs(t) - 1.5) ** 2 / 2 if abs(t) < 1.5 else 0.0, 1.5),
    "gaussian": (lambda t: math.exp(-2 * t * t) * math.sqrt(2 / math.pi), 1.25),
    "spline": (lambda t: cubic(t, 1, 0), 2.0),
    "lanczos": (lambda t: sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0, 3.0),
    "mitchell": (lambda t: cubic(t, 1 / 3, 1 / 3), 2.0),
    "catmullrom": (lambda t: cubic(t, 0, 0.5), 2.0),
}
#: The names of the resize operator's filters.
RESIZE = {"bilinear": "linear", "bicubic": "catmullrom", "lanczos": "lanczos"}


def weights(src: int, dst: int, kind: str, start: int = 0) -> list[tuple[int, int, float]]:
    """(dst, src, w) for `dst` places over `src` source places from `start` on; sources beyond the edge count for the edge.

    Weights aren't scaled to add up to 1; a place without any gets its nearest source."""
    f, radius = FILTERS[kind]
    if src == 1:
        return [(i, start, 1.0) for i in range(dst)]
    scale = dst / src
    shrink = min(1.0, scale)
    reach, out = radius / shrink, []
    for i in range(dst):
        centre = start - 0.5 + (i + 0.5) / scale
        sums: dict[int, float] = {}
        for j in range(math.floor(centre - reach), math.ceil(centre + reach) + 1):
            if w := f((centre - j) * shrink) * shrink:
                at = max(start, min(start + src - 1, j))
                sums[at] = sums.get(at, 0.0) + w
        out += [(i, j, w) for j, w in sums.items()] or [(i, max(start, min(start + src - 1, math.floor(centre))), 1.0)]
    return out


def weight_table(spark: SparkSession, *args) -> DataFrame:
    rows = weights(*args)
    table = spark.createDataFrame(rows, "_dst int, _src int, _w double")
    return F.broadcast(table) if len(rows) <= MOST_WEIGHTS else table


def one_way(pixels: DataFrame, axis: str, table: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    other = "y" if axis == "x" else "x"
    joined = pixels.join(table, F.col(axis) == F.col("_src"))
    # sums are cut to nine places: their last bits depend on the order of the rows
    return joined.groupBy("image_id", other, F.col("_dst").alias(axis)).agg(*(F.round(F.sum(F.col(c) * F.col("_w")), 9).alias(c) for c in channels))


def resample(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], kind: str, channels: tuple[str, ...] = ("a", "r", "g", "b"), start: tuple[int, int] = (0, 0)) -> DataFrame:
    """The rectangle of `size` at `start`, resampled to `to`: first down, then across; rounded half to even once. All images are of
    that size (`resize_sized` takes any); a pixel beyond the rectangle has no weight."""
    spark = pixels.sparkSession
    down = one_way(pixels.select("image_id", "x", "y", *channels), "y", weight_table(spark, size[1], to[1], kind, start[1]), channels)
    across = one_way(down, "x", weight_table(spark, size[0], to[0], kind, start[0]), channels)
    return across.select("image_id", "x", "y", *(clamp(F.bround(F.round(F.col(c), 6))).alias(c) for c in channels))


def nearest(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], channels: tuple[str, ...] = ("a", "r", "g", "b")) -> DataFrame:
    """Source place (i * ((src << 16) div dst)) >> 16 by whole numbers: each source place has a range of results, so that a
    pixel is copied as often as it shows and nothing is shuffled."""
    spark, out = pixels.sparkSession, pixels.select("image_id", "x", "y", *channels)
    for axis, src, dst in (("x", size[0], to[0]), ("y", size[1], to[1])):
        step = (src << 16) // dst
        table = spark.createDataFrame([(i, i * step >> 16) for i in range(dst)], "_dst int, _src int")
        out = out.join(F.broadcast(table) if dst <= MOST_WEIGHTS else table, F.col(axis) == F.col("_src")).withColumn(axis, F.col("_dst")).drop("_dst", "_src")
    return out


def resize(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], how: str = "bilinear", **more) -> DataFrame:
    """how: nearest, bilinear, bicubic or lanczos. The same size gives the pixels as they are."""
    if size == to:
        return pixels
    return nearest(pixels, size, to, **more) if how == "nearest" else resample(pixels, size, to, RESIZE.get(how, how), **more)


#: Different sizes of images that are resized in one call.
MOST_SIZES = 1000


def resize_sized(pixels: DataFrame, to: tuple[int, int], how: str = "bilinear", **more) -> DataFrame:
    """Images of any sizes to one: those of a size are resized together. The sizes, MOST_SIZES at most, are found by an aggregate."""
    from tessella.operators.geometry import sizes

    known = sizes(pixels)
    found = sorted((r.width, r.height) for r in known.select("width", "height").distinct().limit(MOST_SIZES + 1).collect())
    if len(found) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} sizes of images")
    out, placed = None, pixels.join(known, "image_id") if len(found) > 1 else pixels
    for w, h in found:
        own = placed.where((F.col("width") == w) & (F.col("height") == h)).drop("width", "height") if len(found) > 1 else placed
        one = resize(own, (w, h), to, how, **more)
        out = one if out is None else out.unionByName(one)
    return pixels if out is None else out


def fit_size(size: tuple[int, int], box: tuple[int, int]) -> tuple[int, int]:
    """The largest size of the same proportions within the box, at least one pixel each way."""
    scale = min(box[0] / size[0], box[1] / size[1])
    return max(1, round(size[0] * scale)), max(1, round(size[1] * scale))


def resize_to_fit(pixels: DataFrame, size: tuple[int, int], box: tuple[int, int], how: str = "bilinear", **more) -> DataFrame:
    return resize(pixels, size, fit_size(size, box), how, **more)


def mip_sizes(size: tuple[int, int], levels: int = 0) -> list[tuple[int, int]]:
    """Sizes of all levels, the first being the image; levels 0: down to one pixel."""
    most = max(size).bit_length()
    return [(max(1, size[0] >> i), max(1, size[1] >> i)) for i in range(min(levels, most) if levels else most)]


def mipmaps(pixels: DataFrame, size: tuple[int, int], levels: int = 0, how: str = "bilinear", channels: tuple[str, ...] = ("a", "r", "g", "b")) -> DataFrame:
    """All levels with their number; each is made from the full image."""
    out = None
    for i, to in enumerate(mip_sizes(size, levels)):
        one = resize(pixels.select("image_id", "x", "y", *channels), size, to, how, channels=channels).withColumn("level", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def stretch_rect(source: DataFrame, target: DataFrame, rect: tuple[int, int, int, int], to: tuple[int, int, int, int], how: str = "bilinear", channels: tuple[str, ...] = ("a", "r", "g", "b")) -> DataFrame:
    """A rectangle of source resampled into one of target."""
    from tessella.operators.geometry import copy_rect

    x, y, w, h = rect
    part = resize(crop(source, x, y, w, h), (w, h), (to[2], to[3]), how, channels=channels)
    return copy_rect(part, target, 0, 0, to[2], to[3], to[0], to[1])
