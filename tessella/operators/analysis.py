"""Aggregates over pixels: histograms, Otsu's threshold, error metrics, skew."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import arrow
from tessella.functions.color import gray


def histogram(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a"), with_gray: bool = True) -> DataFrame:
    """(image_id, channel, bin, n) of the bins that occur; one pass over the pixels for all channels."""
    values = [F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("bin")) for c in channels]
    if with_gray:
        values.append(F.struct(F.lit("gray").alias("channel"), gray().alias("bin")))
    return pixels.select("image_id", F.explode(F.array(*values)).alias("v")).groupBy("image_id", "v.channel", "v.bin").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame, channel: str = "g") -> DataFrame:
    """(image_id, level): the first level of largest variance between the classes below it and from it on; 0 if there is
    none. After the 256-bin histogram an image is 256 rows at most."""
    bins = pixels.groupBy("image_id", F.col(channel).alias("bin")).agg(F.count("*").alias("n"))
    below = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("image_id")
    sums = bins.select(
        "image_id", "bin",
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("w"), F.coalesce(F.sum((F.col("bin") + 1) * F.col("n")).over(below), F.lit(0)).alias("s"),
        F.sum("n").over(every).alias("total"), F.sum((F.col("bin") + 1) * F.col("n")).over(every).alias("sum"),
        F.lag("bin").over(Window.partitionBy("image_id").orderBy("bin")).alias("before"),
    )
    # the classes change only where a bin occurs: of equal levels the first is the one after the bin before
    top = (F.col("sum") * F.col("w") - F.col("s") * F.col("total")).cast("double")
    spread = F.when((F.col("w") > 0) & (F.col("w") < F.col("total")), top * top / (F.col("w") * (F.col("total") - F.col("w"))).cast("double")).otherwise(0.0)
    first = F.coalesce(F.col("before") + 1, F.lit(0))
    best = sums.select("image_id", F.round(spread, 6).alias("v"), first.alias("level")).groupBy("image_id").agg(F.max(F.struct("v", (-F.col("level")).alias("l"))).alias("m"))
    return best.select("image_id", F.when(F.col("m.v") > 0, -F.col("m.l")).otherwise(0).cast("int").alias("level"))


def binarize(pixels: DataFrame, levels: DataFrame, channel: str = "g") -> DataFrame:
    """255 from an image's level on, else 0."""
    return pixels.join(levels, "image_id").withColumn(channel, F.when(F.col(channel) >= F.col("level"), 255).otherwise(0)).drop("level")


def error_metrics(first: DataFrame, second: DataFrame, channels: tuple[str, ...] = ("a", "r", "g", "b"), top: int = 255) -> DataFrame:
    """(image_id, mae, pae, mse, rmse, psnr) of images of one size; a psnr of 1e6 stands for equal images."""
    both = first.alias("f").join(second.alias("s"), ["image_id", "x", "y"])
    gaps = [F.abs(F.col(f"f.{c}") - F.col(f"s.{c}")).cast("long") for c in channels]
    sums = both.groupBy("image_id").agg(F.sum(sum(gaps[1:], gaps[0])).alias("d"), F.sum(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])).alias("q"), F.max(F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("m"), (F.count("*") * len(channels)).alias("n"))
    out = sums.select("image_id", (F.col("d") / F.col("n")).alias("mae"), F.col("m").cast("double").alias("pae"), (F.col("q") / F.col("n")).alias("mse"))
    rmse = F.sqrt("mse")
    return out.withColumns({"rmse": rmse, "psnr": F.when(rmse < 0.0001, 1e6).otherwise(20 * F.log10(top / F.nullif(rmse, F.lit(0.0))))})


def distinct_colors(pixels: DataFrame, channels: tuple[str, ...] = ("a", "r", "g", "b")) -> DataFrame:
    return pixels.select("image_id", *channels).distinct().groupBy("image_id").agg(F.count("*").alias("n_colors"))


def skew_angle(pixels: DataFrame, most: int = 10, level: int = 128, channel: str = "g", best: int = 20, step: float = 0.1) -> DataFrame:
    """(image_id, angle): mean angle of the `best` lines that get most votes. A dark pixel above a light one (none counts as
    light) votes for a line at each step of angles; votes are whole distances."""
    under = F.lead(channel).over(Window.partitionBy("image_id", "x").orderBy("y"))
    edge = pixels.withColumn("_under", under).where((F.col(channel) < level) & (F.coalesce(F.col("_under"), F.lit(255)) >= level))
    steps = int(2 * most / step) + 1
    turns = np.radians(np.arange(steps) * step - most)
    cos, sin = np.cos(turns), np.sin(turns)

    def angle(x: np.ndarray, y: np.ndarray, cells: int = 2_000_000) -> float:
        whole = lambda x, y, at: np.floor(np.round(y * cos[at] - x * sin[at], 6)).astype(np.int64)
        corners = np.array([whole(u, v, slice(None)) for u in (x.min(), x.max()) for v in (y.min(), y.max())])
        low, span = int(corners.min()), int(corners.max() - corners.min()) + 1
        lines, votes, turns_, rows = [], [], max(1, cells // span), max(1, cells // steps)
        for first in range(0, steps, turns_):  # some angles at a time, as an image may be tall
            at = np.arange(first, min(steps, first + turns_))
            n = np.zeros(at.size * span, np.int64)
            for lo in range(0, len(x), rows):
                place = whole(x[lo : lo + rows, None], y[lo : lo + rows, None], at) - low
                n += np.bincount((np.arange(at.size) * span + place).ravel(), minlength=n.size)
            least = np.partition(n, -best)[-best] if n.size > best else 0
            found = np.flatnonzero(n >= max(least, 1))
            found = found[np.argsort(-n[found], kind="stable")][:best]
            lines.append(at[found // span])
            votes.append(n[found])
        # the most votes first, then the smaller angle and distance
        i = np.concatenate(lines)[np.argsort(-np.concatenate(votes), kind="stable")][:best]
        return int(i.sum()) / len(i) * step - most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [angle(*(c.astype(float) for c in arrow.joined(found.as_py(), arrow.PLACE))) for found in batch.column("_pieces")]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(made, pa.float64())], names=["image_id", "angle"])

    # an image's edges are gathered, not its votes, of which an edge gives one a step
    kind = pixels.schema["image_id"].dataType.simpleString()
    return arrow.through(arrow.pieces(edge.select("image_id", "x", "y"), "image_id", arrow.PLACE), run, f"image_id {kind}, angle double")


def otsu_reference(counts: list[int]) -> int:
    """The same for one 256-bin histogram, level by level; for tests."""
    total, every = sum(counts), sum((i + 1) * n for i, n in enumerate(counts))
    best, level, w, s = 0.0, 0, 0, 0
    for i in range(256):
        if 0 < w < total:
            v = round(float(every * w - s * total) ** 2 / float(w * (total - w)), 6)
            if v > best and not math.isclose(v, best):
                best, level = v, i
        w, s = w + counts[i], s + (i + 1) * counts[i]
    return level


def deskew(pixels: DataFrame, most: int = 10, level: int | None = None) -> DataFrame:
    """Every image turned back by the skew of its text lines, found on its gray values; level: what counts as light, by Otsu's
    threshold of each image if none is given."""
    from tessella.operators.drawing import rotate_each

    light = pixels.select("image_id", "x", "y", gray().alias("g"))
    if level is None:
        light, level = binarize(light, otsu(light)), 128
    angles = skew_angle(light, most, level).select("image_id", (-F.col("angle")).alias("angle"))
    return rotate_each(pixels, angles)
