"""Neighbourhood operators: convolution, minimum, maximum, median and morphology, edges clamped.

Neighbours come from two windows, along rows (image, y) and along columns (image, x). So no pixel is copied k * k times, a
large image is spread over its rows and columns, and a window holds one row or column. Images must be dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import GRAY, clamp

#: Kernel rows, divisor and bias (a fraction of the channel's range) of the named filters.
KERNELS = {
    "average3": ([[1, 1, 1], [1, 1, 1], [1, 1, 1]], 9, 0.0),
    "average5": ([[1] * 5] * 5, 25, 0.0),
    "gauss3": ([[1, 2, 1], [2, 4, 2], [1, 2, 1]], 16, 0.0),
    "gauss5": ([[1, 4, 6, 4, 1], [4, 16, 24, 16, 4], [6, 24, 36, 24, 6], [4, 16, 24, 16, 4], [1, 4, 6, 4, 1]], 256, 0.0),
    "sobel_horz": ([[1, 2, 1], [0, 0, 0], [-1, -2, -1]], 1, 0.0),
    "sobel_vert": ([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], 1, 0.0),
    "prewitt_horz": ([[1, 1, 1], [0, 0, 0], [-1, -1, -1]], 1, 0.0),
    "prewitt_vert": ([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], 1, 0.0),
    "kirsh_horz": ([[5, 5, 5], [-3, 0, -3], [-3, -3, -3]], 1, 0.0),
    "kirsh_vert": ([[5, -3, -3], [5, 0, -3], [5, -3, -3]], 1, 0.0),
    "laplace3": ([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]], 1, 0.0),
    "laplace5": ([[-1] * 5, [-1] * 5, [-1, -1, 24, -1, -1], [-1] * 5, [-1] * 5], 1, 0.0),
    "sharpen3": ([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]], 1, 0.0),
    "sharpen5": ([[-1] * 5, [-1] * 5, [-1, -1, 25, -1, -1], [-1] * 5, [-1] * 5], 1, 0.0),
    "glow5": ([[1, 2, 2, 2, 1], [2, 0, 0, 0, 2], [2, 0, -20, 0, 2], [2, 0, 0, 0, 2], [1, 2, 2, 2, 1]], 8, 0.0),
    "edge_enhance3": ([[-1, -2, -1], [-2, 16, -2], [-1, -2, -1]], 4, 0.0),
    "trace_contour3": ([[-6, -6, -2], [-1, 32, -1], [-6, -2, -6]], 4, 240 / 255),
    "negative3": ([[0, 0, 0], [0, -1, 0], [0, 0, 0]], 1, 1.0),
    "emboss3": ([[2, 0, 0], [0, -1, 0], [0, 0, -1]], 1, 0.5),
}


def across():
    return Window.partitionBy("image_id", "y").orderBy("x")


def down():
    return Window.partitionBy("image_id", "x").orderBy("y")


def shifted(value: Column, by: int, window) -> Column:
    """The value `by` places on, that of the edge beyond it."""
    step = F.lag if by < 0 else F.lead
    return F.coalesce(*(step(value, n).over(window) for n in range(abs(by), 0, -1)), value) if by else value


def gap(axis: str, window) -> Column:
    """How far the pixel before lies along an axis; 1 for the first."""
    return F.coalesce(F.col(axis) - F.lag(axis).over(window), F.lit(1))


def checked(value: Column, *gaps: Column) -> Column:
    """The value, or an error if pixels are missing or repeated: neighbours are found by their order, so an image must be whole."""
    wrong = F.lit(False)
    for g in gaps:
        wrong = wrong | (g != 1)
    return F.when(wrong, F.raise_error(F.lit("an image has missing or repeated pixels"))).otherwise(value)


def convolve(pixels: DataFrame, kernel: list[list[int]], divisor: int = 1, bias: float = 0.0, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Sums of whole numbers, scaled and rounded half to even once; other columns, alpha among them, stay. An image without some
    of its pixels is an error."""
    k = len(kernel)
    half, out = k // 2, pixels
    rows = {(c, i): sum((w * shifted(F.col(c).cast("long"), j - half, across()) for j, w in enumerate(row) if w), F.lit(0).cast("long")) for c in channels for i, row in enumerate(kernel) if any(row)}
    out = out.withColumns({f"_{c}{i}": v for (c, i), v in rows.items()} | {"_gap": gap("x", across())})
    total = {c: sum((shifted(F.col(f"_{c}{i}"), i - half, down()) for i in range(k) if (c, i) in rows), F.lit(0).cast("long")) for c in channels}
    scaled = {c: checked(clamp(F.bround(v / max(1, divisor) + bias * 255)), F.col("_gap"), gap("y", down())) for c, v in total.items()}
    return out.withColumns(scaled).select(*pixels.columns)


def filtered(pixels: DataFrame, name: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    return convolve(pixels, *KERNELS[name], channels=channels)


def neighbours(pixels: DataFrame, value: Column, offsets: list[tuple[int, int]]) -> DataFrame:
    """pixels with _around: the values at (dx, dy), rows first, edges clamped. An image without some of its pixels is an error."""
    out = pixels
    by_row = {}
    for dx, dy in offsets:
        by_row.setdefault(dy, []).append(dx)
    out = out.withColumn("_v", value)
    out = out.withColumns({f"_row{i}": F.array(*(shifted(F.col("_v"), dx, across()) for dx in sorted(dxs))) for i, (_, dxs) in enumerate(sorted(by_row.items()))} | {"_gap": gap("x", across())})
    around = F.concat(*(shifted(F.col(f"_row{i}"), dy, down()) for i, dy in enumerate(sorted(by_row))))
    return out.withColumn("_around", checked(around, F.col("_gap"), gap("y", down()))).drop("_v", "_gap", *(f"_row{i}" for i in range(len(by_row))))


def square(size: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-(size // 2), size - size // 2) for dx in range(-(size // 2), size - size // 2)]


def rank(pixels: DataFrame, which: str, size: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The whole pixel of smallest, middle or largest luminance around; among equal ones the first in scanning order (min, max)
    or by place (median)."""
    weight = dict(zip(("r", "g", "b"), GRAY)) if len(channels) == 3 else {channels[0]: 1.0}
    light = sum((F.col(c) * weight[c] for c in channels), F.lit(0.0))
    out = neighbours(pixels, F.struct(light.alias("light"), *channels), square(size))
    sign = -1 if which == "max" else 1
    ordered = F.transform("_around", lambda p, i: F.struct((sign * p["light"]).alias("l"), i.alias("i"), p.alias("p")))
    found = F.array_sort(ordered)[size * size // 2] if which == "median" else F.array_min(ordered)
    return out.withColumn("_best", found["p"]).withColumns({c: F.col("_best")[c] for c in channels}).select(*pixels.columns)


def morphology(pixels: DataFrame, strel: list[list[int]], erode: bool, channel: str = "g") -> DataFrame:
    """Binary erosion or dilation by a structuring element [x][y] of 0 and 1, anchored at its middle; output 0 or 255."""
    w, h = len(strel), len(strel[0])
    ones = [(i - w // 2, j - h // 2) for i in range(w) for j in range(h) if strel[i][j]]
    out = neighbours(pixels, F.col(channel) > 0, ones)
    hit = F.forall("_around", lambda v: v) if erode else F.exists("_around", lambda v: v)
    return out.withColumn(channel, F.when(hit, 255).otherwise(0)).select(*pixels.columns)


def opened(pixels: DataFrame, strel: list[list[int]], channel: str = "g") -> DataFrame:
    return morphology(morphology(pixels, strel, True, channel), strel, False, channel)


def closed(pixels: DataFrame, strel: list[list[int]], channel: str = "g") -> DataFrame:
    return morphology(morphology(pixels, strel, False, channel), strel, True, channel)
