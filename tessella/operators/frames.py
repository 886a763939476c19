"""Operators on the order of an image's frames (frame_idx from 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("image_id").agg((F.max("frame_idx") + 1).alias("n_frames"))


def reverse(frames: DataFrame) -> DataFrame:
    return frames.join(counts(frames), "image_id").withColumn("frame_idx", F.col("n_frames") - 1 - F.col("frame_idx")).drop("n_frames")


def delete(frames: DataFrame, at: int) -> DataFrame:
    """Without the frame at a place; those after it move up."""
    return frames.where(F.col("frame_idx") != at).withColumn("frame_idx", F.when(F.col("frame_idx") > at, F.col("frame_idx") - 1).otherwise(F.col("frame_idx")))


def insert(frames: DataFrame, at: int, new: DataFrame) -> DataFrame:
    """The rows of `new` as the frame at a place; those from it on move down."""
    rest = frames.withColumn("frame_idx", F.when(F.col("frame_idx") >= at, F.col("frame_idx") + 1).otherwise(F.col("frame_idx")))
    return rest.unionByName(new.withColumn("frame_idx", F.lit(at).cast(frames.schema["frame_idx"].dataType)))


def exchange(frames: DataFrame, first: int, second: int) -> DataFrame:
    i = F.col("frame_idx")
    return frames.withColumn("frame_idx", F.when(i == first, second).when(i == second, first).otherwise(i))


def insert_many(frames: DataFrame, at: int, new: DataFrame, many: int | None = None) -> DataFrame:
    """The frames of `new` (image_id, frame_idx, ...) from a place on, in their order; those from it on move down by their number.
    many: that number, where it is known and the same for all images; frames without rows are counted then."""
    moved = frames
    if many is None:
        moved = frames.join(counts(new).withColumnRenamed("n_frames", "_n"), "image_id", "left")
    by = F.coalesce("_n", F.lit(0)) if many is None else F.lit(many)
    moved = moved.withColumn("frame_idx", F.when(F.col("frame_idx") >= at, F.col("frame_idx") + by).otherwise(F.col("frame_idx"))).drop("_n")
    return moved.unionByName(new.withColumn("frame_idx", F.col("frame_idx") + at))


def append(frames: DataFrame, new: DataFrame, have: int | None = None) -> DataFrame:
    """The frames of `new` after those of the image; an image without frames begins with them. have: the number of frames of an
    image, where it is known and the same for all; frames without rows are counted then."""
    if have is not None:
        return frames.unionByName(new.withColumn("frame_idx", F.col("frame_idx") + have))
    size = counts(frames).withColumnRenamed("n_frames", "_n")
    return frames.unionByName(new.join(size, "image_id", "left").withColumn("frame_idx", F.col("frame_idx") + F.coalesce("_n", F.lit(0))).drop("_n"))


def set_count(frames: DataFrame, count: int, width: int = 16, height: int = 16, channels: tuple[str, ...] = ("a", "r", "g", "b"), have: int | None = None) -> DataFrame:
    """Pixel frames with exactly `count` frames an image: later ones go, missing ones are blank. have: the number of frames of an
    image, where it is known and the same for all; those without pixels are counted then and aren't made blank ones."""
    kept = frames.where(F.col("frame_idx") < count)
    if have is not None and have >= count:
        return kept
    if have is None:
        last = frames.groupBy("image_id").agg(F.max("frame_idx").alias("_last")).where(F.col("_last") < count - 1)
    else:
        last = frames.select("image_id").distinct().withColumn("_last", F.lit(have - 1))
    each = last.withColumn("frame_idx", F.explode(F.sequence(F.col("_last").cast("int") + 1, F.lit(count - 1))))
    blank = each.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    made = {"x": F.col("_i") % width, "y": F.floor(F.col("_i") / width)} | {c: F.lit(0) for c in channels}
    return kept.unionByName(blank.select(*(made.get(c, F.col(c)).cast(kept.schema[c].dataType).alias(c) if c in made or c in ("image_id", "frame_idx") else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns)))


def each(frames: DataFrame, f) -> DataFrame:
    """f, an operator on pixels of images, applied to every frame by itself."""
    alone = f(frames.withColumn("image_id", F.struct("image_id", "frame_idx")).drop("frame_idx"))
    rest = [c for c in alone.columns if c != "image_id"]
    return alone.select("image_id.image_id", "image_id.frame_idx", *rest)
