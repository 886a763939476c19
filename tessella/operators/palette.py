"""Palettes: generation, nearest colour, and reduction by median cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARGB = ("a", "r", "g", "b")
#: Weights of the sides of a box of colours when the side to be cut is chosen.
SIDES = {"a": 1024, "r": 612, "g": 1202, "b": 234}


def gray_palette(spark: SparkSession, entries: int = 256) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(entries).select(i.alias("idx"), F.lit(255).alias("a"), *((i % 256).alias(c) for c in "rgb"))


def custom_palette(spark: SparkSession, bits: tuple[int, int, int], entries: int = 256, alpha: int = 255) -> DataFrame:
    """Entry numbers cut into fields of red, green and blue bits. The fields overlap by one bit, as shifts are one less than the
    sum of the lower fields; entries beyond 2 to the number of bits are 0."""
    r, g, b = bits
    i = F.col("id").cast("int")

    def field(n: int, shift: int):
        top = (1 << n) - 1
        return F.floor(F.shiftright(i, max(0, shift)).bitwiseAND(top) * 255 / top).cast("int") if n else F.lit(0)

    used = F.col("id") < (1 << (r + g + b))
    values = {"a": F.lit(alpha), "r": field(r, g + b - 1), "g": field(g, b - 1), "b": field(b, 0)}
    return spark.range(entries).select(i.alias("idx"), *(F.when(used, v).otherwise(0).alias(c) for c, v in values.items()))


def map_to_palette(pixels: DataFrame, palette: DataFrame, entries: int = 256) -> DataFrame:
    """pixels with idx, the palette's nearest entry by the sum of differences, the first among equal ones.

    A palette has `entries` (256) rows at most, which is checked where it is collected; the different colours of an Arrow batch are
    mapped at once, without a shuffle. A column already called idx is replaced; an empty palette gives nulls."""
    rows = palette.orderBy("idx").limit(entries + 1).collect()
    if len(rows) > entries:
        raise ValueError(f"a palette has {entries} entries at most")
    table, numbers = np.array([[r[c] for c in ARGB] for r in rows], np.int64).reshape(-1, 4), np.array([r["idx"] for r in rows], np.int32)
    kept = pixels.drop("idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            colors = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ARGB], 1)
            distinct, back = np.unique(colors, axis=0, return_inverse=True)
            nearest = np.zeros(len(distinct), np.int64)
            for at in range(0, len(distinct), 2048):
                if len(table):
                    nearest[at : at + 2048] = np.abs(distinct[at : at + 2048, None] - table).sum(2).argmin(1)
            found = pa.array(numbers[nearest[back.ravel()]], pa.int32()) if len(table) else pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "idx"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("idx", T.IntegerType())]))


def has_alpha(palette: DataFrame) -> DataFrame:
    return palette.agg(F.coalesce(F.max(F.col("a") != 255), F.lit(False)).alias("has_alpha"))


def is_gray(palette: DataFrame) -> DataFrame:
    return palette.agg(F.coalesce(F.min((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))), F.lit(True)).alias("is_gray"))


class Boxes:
    """Boxes of colours, those with most pixels first: lowest and highest channels [k, 4] and the boxes' colours."""

    def __init__(self, low: np.ndarray, high: np.ndarray, colors: np.ndarray):
        self.low, self.high, self.colors = low, high, colors

    def index(self, colors: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The first box that holds each colour, 0 if none does."""
        out = np.zeros(len(colors), int)
        for at in range(0, len(colors), rows):
            c = colors[at : at + rows, None]
            out[at : at + rows] = ((self.low <= c) & (c <= self.high)).all(2).argmax(1)
        return out


def median_boxes(colors: np.ndarray, counts: np.ndarray, most: int, mask: int = 255) -> Boxes:
    """Median cut of distinct colours [n, 4] under a channel mask with their numbers: the box with the largest weighted side, the
    first of equal ones, is cut in the side's middle; the lower part keeps its place and the upper goes to the end. A box's
    colour is the mean of its pixels, cut to whole numbers."""
    weights = np.array([SIDES[c] for c in ARGB])
    boxes = [np.arange(len(colors))] if len(colors) else []
    spans = [(colors.max(0) - colors.min(0)) * weights] if boxes else []
    while boxes and len(boxes) < most:
        which = int(np.argmax([s.max() for s in spans]))
        if not spans[which].max():
            break
        box, side = boxes[which], int(spans[which].argmax())
        v = colors[box, side]
        lower = v <= (int(v.min()) + int(v.max())) >> 1
        boxes[which] = box[lower]
        boxes.append(box[~lower])
        spans[which] = np.ptp(colors[boxes[which]], axis=0) * weights
        spans.append(np.ptp(colors[boxes[-1]], axis=0) * weights)
    total = [int(counts[b].sum()) for b in boxes]
    order = list(range(len(boxes)))
    for i in range(len(order) - 1):  # the largest of the rest changes places with the next one
        k = max(range(i, len(order)), key=lambda j: total[order[j]])
        order[i], order[k] = order[k], order[i]
    boxes = [boxes[i] for i in order]
    shape = lambda rows: np.array(rows, int).reshape(-1, 4)
    means = shape([(colors[b].astype(np.int64) * counts[b, None]).sum(0) // counts[b].sum() for b in boxes])
    return Boxes(shape([colors[b].min(0) & mask for b in boxes]), shape([(colors[b].max(0) & mask) + (255 - mask) for b in boxes]), means)


def median_cut(colors: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most `most` colours [k, 4] for distinct colours and how often they occur, in the order of their channels."""
    return np.array(sorted(map(tuple, median_boxes(colors, counts, most).colors)))


def color_counts(pixels: DataFrame, by: list[str], mask: int = 255) -> DataFrame:
    """Distinct colours under a channel mask with their numbers, aggregated in part before the shuffle."""
    return pixels.groupBy(*by, *(F.col(c).bitwiseAND(mask).alias(c) for c in ARGB)).agg(F.count("*").alias("n"))


def palettes(pixels: DataFrame, most: int = 256, mask: int = 255) -> DataFrame:
    """(image_id, idx, a, r, g, b): a palette for each image. What is gathered per image is its distinct colours."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = median_boxes(group[list(ARGB)].to_numpy(), group["n"].to_numpy(), max(2, most), mask).colors
        out = pd.DataFrame(found, columns=list(ARGB))
        out.insert(0, "idx", range(len(out)))
        out.insert(0, "image_id", group["image_id"].iloc[0])
        return out

    return color_counts(pixels, ["image_id"], mask).groupBy("image_id").applyInPandas(run, "image_id long, idx int, a int, r int, g int, b int")


def shared_palette(pixels: DataFrame, most: int = 256, mask: int = 255) -> DataFrame:
    """(idx, a, r, g, b): one palette for the pixels of all images, from their distinct colours with their numbers.

    The colours that are gathered are those that a mask leaves (a mask of 248 leaves a million at most)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = median_boxes(group[list(ARGB)].to_numpy(), group["n"].to_numpy(), max(2, most), mask).colors
        out = pd.DataFrame(found, columns=list(ARGB))
        out.insert(0, "idx", range(len(out)))
        return out

    counted = color_counts(pixels.withColumn("_all", F.lit(0)), ["_all"], mask)
    return counted.groupBy("_all").applyInPandas(run, "idx int, a int, r int, g int, b int")


def reduce_colors(pixels: DataFrame, most: int) -> DataFrame:
    """Pixels with their image's colours reduced to at most `most` (2..4096); each distinct colour is mapped once, to the
    first box that holds it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        colors = group[list(ARGB)].to_numpy()
        found = median_boxes(colors, group["n"].to_numpy(), max(2, min(4096, most)))
        out = group.drop(columns="n").copy()
        out[[f"_{c}" for c in ARGB]] = found.colors[found.index(colors)]
        return out

    counted = color_counts(pixels, ["image_id"])
    mapped = counted.groupBy("image_id").applyInPandas(run, "image_id long, a int, r int, g int, b int, _a int, _r int, _g int, _b int")
    return pixels.join(mapped, ["image_id", *ARGB]).select("image_id", "x", "y", *(F.col(f"_{c}").alias(c) for c in ARGB))


def copy_entries(source: DataFrame, target: DataFrame, at: int, to: int, count: int) -> DataFrame:
    """target (idx, a, r, g, b) with `count` entries of source, from `at` on, in the places from `to` on that it has."""
    part = source.where(F.col("idx").between(at, at + count - 1)).select((F.col("idx") - at + to).alias("idx"), *(F.col(c).alias(f"_{c}") for c in ARGB))
    return target.join(part, "idx", "left").select("idx", *(F.coalesce(f"_{c}", c).alias(c) for c in ARGB))


def as_image(palette: DataFrame, image_id: int = 0) -> DataFrame:
    """The palette as an image of one row, a pixel an entry."""
    return palette.select(F.lit(image_id).alias("image_id"), F.col("idx").alias("x"), F.lit(0).alias("y"), *ARGB)
