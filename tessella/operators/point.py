"""Point transforms: one projection each. Channels are integers 0..255; computed as fractions, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import from_float, gray, to_float

RGB = ("r", "g", "b")


def transform(pixels: DataFrame, f, channels: tuple[str, ...] = RGB) -> DataFrame:
    """f: column of fractions to column of fractions, applied to each channel."""
    return pixels.withColumns({c: from_float(f(to_float(c))) for c in channels})


def invert(pixels: DataFrame, channels=RGB) -> DataFrame:
    return transform(pixels, lambda v: 1 - v, channels)


def contrast_brightness(pixels: DataFrame, contrast: float, brightness: float, channels=RGB) -> DataFrame:
    """Both in percent."""
    return transform(pixels, lambda v: v * (1 + contrast / 100) + brightness / 100, channels)


def gamma(pixels: DataFrame, by: dict[str, float]) -> DataFrame:
    return pixels.withColumns({c: from_float(F.pow(to_float(c), F.lit(1 / g))) for c, g in by.items()})


def threshold(pixels: DataFrame, by: dict[str, float]) -> DataFrame:
    return pixels.withColumns({c: F.when(to_float(c) >= t, 255).otherwise(0) for c, t in by.items()})


def levels(pixels: DataFrame, black: float, white: float, mid: float = 1.0, channels=RGB) -> DataFrame:
    """Below black 0; else the place between black and white to the power 1 / mid."""
    at = lambda v: (v - black) / (white - black)
    return transform(pixels, lambda v: F.when(v > black, F.pow(at(v), F.lit(1 / mid))).otherwise(0.0), channels)


def premultiply(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: from_float(to_float(c) * to_float("a")) for c in RGB})


def unpremultiply(pixels: DataFrame) -> DataFrame:
    """Where alpha is 0, colours are 0."""
    return pixels.withColumns({c: from_float(F.when(F.col("a") > 0, to_float(c) / F.nullif(to_float("a"), F.lit(0.0))).otherwise(0.0)) for c in RGB})


def fill_channel(pixels: DataFrame, channel: str, value: int | float) -> DataFrame:
    """An integer is set as it is, a fraction scaled and rounded."""
    return pixels.withColumn(channel, from_float(F.lit(value)) if isinstance(value, float) else F.lit(value))


def to_gray(pixels: DataFrame, name: str = "gray") -> DataFrame:
    return pixels.withColumn(name, gray())


def point(pixels: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Any expressions over a pixel's columns."""
    return pixels.withColumns(columns)
