"""Pixel formats and images as objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import drawing, geometry, resample
from tessella.operators import frames as frame_ops
from tessella.sources import formats as image_formats
from tessella.sources import images

#: Different sizes of frames that are resized in one call.
MOST_SIZES = 100
VERSION = "0.2"

#: Name, class, bytes of a pixel (of a 4 x 4 block for block formats), channels, alpha.
FORMATS = [
    ("Index8", "index", 1, 1, True), ("Gray8", "gray", 1, 1, False), ("A8Gray8", "gray", 2, 2, True), ("Gray16", "gray", 2, 1, False), ("Gray32", "gray", 4, 1, False),
    ("Gray64", "gray", 8, 1, False), ("A16Gray16", "gray", 4, 2, True), ("X5R1G1B1", "argb", 1, 3, False), ("R3G3B2", "argb", 1, 3, False), ("R5G6B5", "argb", 2, 3, False),
    ("A1R5G5B5", "argb", 2, 4, True), ("A4R4G4B4", "argb", 2, 4, True), ("X1R5G5B5", "argb", 2, 3, False), ("X4R4G4B4", "argb", 2, 3, False), ("R8G8B8", "argb", 3, 3, False),
    ("A8R8G8B8", "argb", 4, 4, True), ("X8R8G8B8", "argb", 4, 3, False), ("R16G16B16", "argb", 6, 3, False), ("A16R16G16B16", "argb", 8, 4, True), ("B16G16R16", "argb", 6, 3, False),
    ("A16B16G16R16", "argb", 8, 4, True), ("R32F", "float", 4, 1, False), ("A32R32G32B32F", "float", 16, 4, True), ("A32B32G32R32F", "float", 16, 4, True), ("R16F", "float", 2, 1, False),
    ("A16R16G16B16F", "float", 8, 4, True), ("A16B16G16R16F", "float", 8, 4, True), ("R32G32B32F", "float", 12, 3, False), ("B32G32R32F", "float", 12, 3, False), ("DXT1", "block", 8, 4, True),
    ("DXT3", "block", 16, 4, True), ("DXT5", "block", 16, 4, True), ("BTC", "block", 4, 1, False), ("ATI1N", "block", 8, 1, False), ("ATI2N", "block", 16, 2, False), ("Binary", "bits", 1, 1, False),
]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "name string, class string, bytes int, channels int, has_alpha boolean")


def pixels_size(table: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """table (format columns, width, height) with size: bytes of an image. Blocks are whole, one-bit rows whole bytes."""
    w, h, n = F.col(width).cast("long"), F.col(height).cast("long"), F.col("bytes")
    size = F.when(F.col("class") == "block", F.ceil(w / 4) * F.ceil(h / 4) * n).when(F.col("class") == "bits", F.ceil(w / 8) * h).otherwise(w * h * n)
    return table.withColumn("size", size.cast("long"))


class Images:
    """Frames of one or more images and operators on them; every method gives new Images and nothing runs before a result is asked for."""

    def __init__(self, frames: DataFrame):
        self.frames = frames

    @classmethod
    def read(cls, spark: SparkSession, path: str, **how) -> Images:
        found = images.read(spark, path, **how).where("bits is not null")
        return cls(found.withColumnRenamed("path", "image_id"))

    @classmethod
    def from_pixels(cls, pixels: DataFrame) -> Images:
        packed = images.from_pixels(pixels)
        return cls(packed.select("image_id", F.lit(0).alias("frame_idx"), "width", "height", F.lit("A8R8G8B8").alias("format"), "bits", F.lit(None).cast("string").alias("error")))

    def pixels(self, frame: int = 0) -> DataFrame:
        return images.to_pixels_fast(self.frames.where(F.col("frame_idx") == frame), ["image_id"])

    def map(self, f, frame: int = 0) -> Images:
        """f: pixels to pixels, applied to one frame of every image, which alone makes up the new images; `apply` takes all frames."""
        return Images.from_pixels(f(self.pixels(frame)))

    def apply(self, f) -> Images:
        """f: pixels to pixels, applied to every frame of every image; the frames keep their order."""
        every = images.to_pixels_fast(self.frames, ["image_id", "frame_idx"])
        alone = f(every.withColumn("image_id", F.struct("image_id", "frame_idx")).drop("frame_idx"))
        packed = images.from_pixels(alone).select("image_id.image_id", "image_id.frame_idx", "width", "height", F.lit("A8R8G8B8").alias("format"), "bits", F.lit(None).cast("string").alias("error"))
        return Images(packed)

    def flip(self) -> Images:
        return self.apply(geometry.flip)

    def mirror(self) -> Images:
        return self.apply(geometry.mirror)

    def rotate(self, angle: float) -> Images:
        return self.apply(lambda p: drawing.rotate(p, angle))

    def swap_channels(self, first: str, second: str) -> Images:
        return self.apply(lambda p: geometry.swap_channels(p, first, second))

    def replace_color(self, old: dict[str, int], new: dict[str, int], rect: tuple[int, int, int, int] | None = None) -> Images:
        return self.apply(lambda p: geometry.replace_color(p, old, new, rect))

    def resize(self, width: int, height: int, how: str = "bilinear") -> Images:
        """Every frame to a size, whatever its own: frames of one size are resized together."""
        sizes = sorted((r.width, r.height) for r in self.frames.where("bits is not null").select("width", "height").distinct().limit(MOST_SIZES + 1).collect())
        if len(sizes) > MOST_SIZES:
            raise ValueError(f"more than {MOST_SIZES} sizes of frames")
        out = None
        for w, h in sizes:
            one = Images(self.frames.where((F.col("width") == w) & (F.col("height") == h))).apply(lambda p, w=w, h=h: resample.resize(p, (w, h), (width, height), how)).frames
            out = one if out is None else out.unionByName(one)
        return Images(self.frames.limit(0) if out is None else out)

    def crop_to(self, rect: tuple[int, int, int, int], other: Images, at: tuple[int, int]) -> Images:
        """The images of `other` with a rectangle (left, top, width, height) of the first frame of these copied in."""
        return Images.from_pixels(geometry.copy_rect(self.pixels(), other.pixels(), *rect, *at))

    def stretch_to(self, rect: tuple[int, int, int, int], other: Images, to: tuple[int, int, int, int], how: str = "bilinear") -> Images:
        return Images.from_pixels(resample.stretch_rect(self.pixels(), other.pixels(), rect, to, how))

    def append(self, other: Images, have: int | None = None) -> Images:
        """The frames of `other` after those of these images, of which each has `have` if that is given."""
        return Images(frame_ops.append(self.frames, other.frames, have))

    def insert_many(self, at: int, other: Images, many: int | None = None) -> Images:
        return Images(frame_ops.insert_many(self.frames, at, other.frames, many))

    def typed(self, pixel_format: str = "A8R8G8B8") -> DataFrame:
        """All frames as typed ones in a pixel format."""
        return image_formats.convert(image_formats.typed(self.frames), pixel_format)

    @classmethod
    def from_typed(cls, frames: DataFrame) -> Images:
        return cls(image_formats.untyped(frames))

    def reverse(self) -> Images:
        return Images(frame_ops.reverse(self.frames))

    def delete(self, at: int) -> Images:
        return Images(frame_ops.delete(self.frames, at))

    def exchange(self, first: int, second: int) -> Images:
        return Images(frame_ops.exchange(self.frames, first, second))

    def insert(self, at: int, other: Images) -> Images:
        return Images(frame_ops.insert(self.frames, at, other.frames))

    def valid(self) -> DataFrame:
        """(image_id, valid): whether an image has frames, all of their stated size."""
        good = F.octet_length("bits") == F.col("width").cast("long") * F.col("height") * 4
        return self.frames.groupBy("image_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("valid"))

    def encode(self, kind: str, **options) -> DataFrame:
        return images.encode(self.frames, kind, "image_id", "frame_idx", **options)
