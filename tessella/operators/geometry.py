"""Coordinate operators over pixels (image_id, x, y, channels): projections, range filters and positional joins.

An image's size is given or taken from its largest coordinates by one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "x", "y"]


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def with_size(pixels: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """pixels with width and height: constants where all images have one size, or columns that they have already, as a source knows
    the sizes of its images; either saves the aggregate and the join, which shuffles the pixels."""
    if {"width", "height"} <= set(pixels.columns):
        return pixels
    if width and height:
        return pixels.withColumns({"width": F.lit(width), "height": F.lit(height)})
    return pixels.join(sizes(pixels), "image_id")


def moved(pixels: DataFrame, x: Column, y: Column, **size) -> DataFrame:
    return with_size(pixels, **size).withColumns({"x": x.cast("int"), "y": y.cast("int")}).drop("width", "height")


def flip(pixels: DataFrame, **size) -> DataFrame:
    """Upside down."""
    return moved(pixels, F.col("x"), F.col("height") - 1 - F.col("y"), **size)


def mirror(pixels: DataFrame, **size) -> DataFrame:
    """Left to right."""
    return moved(pixels, F.col("width") - 1 - F.col("x"), F.col("y"), **size)


def rotate90(pixels: DataFrame, quarters: int, **size) -> DataFrame:
    """Counter-clockwise by quarters of a turn."""
    x, y, w, h = map(F.col, ("x", "y", "width", "height"))
    to = {0: (x, y), 1: (y, w - 1 - x), 2: (w - 1 - x, h - 1 - y), 3: (h - 1 - y, x)}[quarters % 4]
    return moved(pixels, *to, **size)


def inside(x: int, y: int, width: int, height: int) -> Column:
    return F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle as an image of its own; the filter reaches the scan."""
    return pixels.where(inside(x, y, width, height)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def copy_rect(source: DataFrame, target: DataFrame, x: int, y: int, width: int, height: int, to_x: int, to_y: int) -> DataFrame:
    """target with a rectangle of source copied in, all channels as they are; what falls outside target is left out."""
    channels = [c for c in target.columns if c not in KEY]
    part = source.where(inside(x, y, width, height)).select(
        "image_id", (F.col("x") - x + to_x).alias("x"), (F.col("y") - y + to_y).alias("y"), *(F.col(c).alias(f"_{c}") for c in channels), F.lit(True).alias("_there")
    )
    both = target.join(part, KEY, "left")
    return both.select(*KEY, *(F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in channels))


def fill_rect(pixels: DataFrame, x: int, y: int, width: int, height: int, color: dict[str, int]) -> DataFrame:
    here = inside(x, y, width, height)
    return pixels.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in color.items()})


def replace_color(pixels: DataFrame, old: dict[str, int], new: dict[str, int], rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels equal to `old` in all its channels become `new`."""
    hit = F.lit(True) if rect is None else inside(*rect)
    for c, v in old.items():
        hit = hit & (F.col(c) == v)
    return pixels.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def swap_channels(pixels: DataFrame, first: str, second: str) -> DataFrame:
    return pixels.withColumns({first: F.col(second), second: F.col(first)})


def split(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Chunks: chunk_x and chunk_y, and coordinates within the chunk."""
    x, y = F.col("x"), F.col("y")
    return pixels.withColumns({"chunk_x": F.floor(x / width).cast("int"), "chunk_y": F.floor(y / height).cast("int"), "x": (x % width).cast("int"), "y": (y % height).cast("int")})


def split_filled(pixels: DataFrame, width: int, height: int, color: dict[str, int]) -> DataFrame:
    """Chunks of full size, those at the edges filled up with `color`.

    No pixel is shuffled or joined: which places of a chunk have none is read off bits, a row for each square of 1024 places at
    most, put together in part before the shuffle."""
    chunks = split(pixels, width, height).where((F.col("x") >= 0) & (F.col("y") >= 0))
    chunk = ["image_id", "chunk_x", "chunk_y"]
    wide = min(width, 32)
    tall = min(height, 1024 // wide)
    across, cells = -(-width // wide), wide * tall
    squares, words = across * -(-height // tall), -(-cells // 64)
    x, y = F.col("x"), F.col("y")
    square = (F.floor(y / tall) * across + F.floor(x / wide)).cast("int")
    place = ((y % tall) * wide + x % wide).cast("int")
    known = F.col("image_id").isNotNull()  # a null id is equal to none, so its chunks have no pixels
    seen = chunks.select(*chunk, square.alias("_square"), place.alias("_place"))
    seen = seen.withColumn("_bit", F.when(known, F.expr("shiftleft(1L, _place % 64)"))).withColumn("_word", F.expr("_place div 64"))
    bits = seen.groupBy(*chunk, "_square").agg(*(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))).alias(f"_{k}") for k in range(words)))
    bits = bits.select(*chunk, "_square", F.array(*(F.coalesce(f"_{k}", F.lit(0).cast("long")) for k in range(words))).alias("_bits"))
    if squares > 1:
        of = bits.groupBy(*chunk).agg(F.map_from_entries(F.collect_list(F.struct("_square", "_bits"))).alias("_all"))
        none = F.array_repeat(F.lit(0).cast("long"), words)
        bits = of.select(*chunk, "_all", F.explode(F.sequence(F.lit(0), F.lit(squares - 1))).alias("_square")).select(*chunk, "_square", F.coalesce(F.col("_all")[F.col("_square")], none).alias("_bits"))
    free = bits.select(*chunk, "_square", "_bits", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_at")).where("(shiftright(_bits[cast(_at div 64 as int)], cast(_at % 64 as int)) & 1L) = 0")
    at_x = (F.col("_square") % across) * wide + F.col("_at") % wide
    at_y = F.floor(F.col("_square") / across) * tall + F.floor(F.col("_at") / wide)
    free = free.select(*chunk, at_x.cast("int").alias("x"), at_y.cast("int").alias("y")).where((F.col("x") < width) & (F.col("y") < height))
    held = chunks.where(known).select(*chunk, "x", "y", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in color.items()))
    return held.unionByName(free.withColumns({c: F.lit(v).cast(held.schema[c].dataType) for c, v in color.items()}))


def new_image(spark, image_id: int, width: int, height: int, channels: tuple[str, ...] = ("a", "r", "g", "b")) -> DataFrame:
    """All pixels of an image, every channel 0."""
    ids = spark.range(width * height)
    return ids.select(F.lit(image_id).cast("long").alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), *(F.lit(0).alias(c) for c in channels))
