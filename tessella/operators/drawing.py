"""Drawing: shapes are predicates over a pixel's place, so drawing is a projection; flood fill and rotation by any angle run
per image in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import arrow
from tessella.functions.color import from_float, to_float
from tessella.operators.geometry import inside

ARGB = ("a", "r", "g", "b")


def painted(pixels: DataFrame, where: Column, color: dict[str, int]) -> DataFrame:
    return pixels.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in color.items()})


def line_at(x1: int, y1: int, x2: int, y2: int) -> Column:
    """Whether a pixel is on Bresenham's line: along its longer side there is one pixel a step."""
    x, y = F.col("x"), F.col("y")
    if abs(y2 - y1) > abs(x2 - x1):
        x, y, x1, y1, x2, y2 = y, x, y1, x1, y2, x2
    if x1 > x2:
        x1, y1, x2, y2 = x2, y2, x1, y1
    dx, dy, step = x2 - x1, abs(y2 - y1), 1 if y2 > y1 else -1
    if not dx:
        return (x == x1) & (y == y1)
    return x.between(x1, x2) & (y == y1 + step * F.floor((2 * dy * (x - x1) + dx) / (2 * dx)))


def line(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int, color: dict[str, int], width: int = 1) -> DataFrame:
    """Wider lines are lines side by side, across the direction that they run in."""
    steep, hit = abs(y2 - y1) > abs(x2 - x1), F.lit(False)
    for k in range(-((width - 1) // 2), width // 2 + 1):
        hit = hit | (line_at(x1 + k, y1, x2 + k, y2) if steep else line_at(x1, y1 + k, x2, y2 + k))
    return painted(pixels, hit, color)


def frame_rect(pixels: DataFrame, x: int, y: int, width: int, height: int, color: dict[str, int]) -> DataFrame:
    inner = inside(x + 1, y + 1, width - 2, height - 2) if min(width, height) > 2 else F.lit(False)
    return painted(pixels, inside(x, y, width, height) & ~inner, color)


def rectangle(pixels: DataFrame, x: int, y: int, width: int, height: int, fill: dict[str, int], pen: dict[str, int]) -> DataFrame:
    return frame_rect(painted(pixels, inside(x, y, width, height), fill), x, y, width, height, pen)


def fill_rect_blend(pixels: DataFrame, x: int, y: int, width: int, height: int, color: dict[str, int]) -> DataFrame:
    """A constant colour laid over a rectangle by its alpha."""
    here, a = inside(x, y, width, height), color["a"] / 255
    mixed = {c: from_float(F.round((color[c] / 255 * a + to_float(c) * (1 - a)) * 255, 9) / 255) for c in "rgb"}
    mixed["a"] = from_float(F.round((a + to_float("a") - a * to_float("a")) * 255, 9) / 255)
    return pixels.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in mixed.items()})


def ellipse(pixels: DataFrame, x: int, y: int, width: int, height: int, fill: dict[str, int] | None = None, pen: dict[str, int] | None = None) -> DataFrame:
    """The ellipse that fits a rectangle: a pixel belongs to it if its middle does, to the outline if a neighbour doesn't."""
    cx, cy, rx, ry = x + (width - 1) / 2, y + (height - 1) / 2, width / 2, height / 2
    within = lambda dx, dy: ((F.col("x") + dx - cx) / rx) ** 2 + ((F.col("y") + dy - cy) / ry) ** 2 <= 1
    here = within(0, 0)
    out = painted(pixels, here, fill) if fill else pixels
    return painted(out, here & ~(within(1, 0) & within(-1, 0) & within(0, 1) & within(0, -1)), pen) if pen else out


def clip(pixels: DataFrame, rect: tuple[int, int, int, int], draw) -> DataFrame:
    """draw(pixels) within a rectangle (left, top, right, bottom; right and bottom are outside) and the rest as it was.

    The corners may stand in any order. draw paints pixels where they are, as the shapes of this module do."""
    left, right = sorted(rect[::2])
    top, bottom = sorted(rect[1::2])
    here = inside(left, top, right - left, bottom - top)
    return draw(pixels.where(here)).unionByName(pixels.where(~here))


def per_image(pixels: DataFrame, f, arguments: DataFrame | None = None, rows: int = 50_000) -> DataFrame:
    """f: array [h, w, 4] to array, for each image in a task; missing pixels are 0. arguments: (image_id, argument), a value an image,
    which f gets as well (null for images that have none)."""
    from tessella.sources import images

    packed, given = images.from_pixels(pixels), ["width", "height", "bits"]
    if arguments is not None:
        given.append("argument")
        packed = packed.join(arguments, "image_id", "left")
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.parts(batches, "bits", rows * 4):
            columns = [batch.column(c).to_pylist() for c in given]
            made = [f(np.frombuffer(bits, np.uint8).reshape(h, w, 4).copy(), *more) for w, h, bits, *more in zip(*columns)]
            sized = [batch.column("image_id"), pa.array([p.shape[1] for p in made], pa.int32()), pa.array([np.ascontiguousarray(p, np.uint8).tobytes() for p in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(sized, names=["image_id", "width", "bits"])

    return images.to_pixels_fast(arrow.through(packed, run, f"image_id {kind}, width int, bits binary"), ["image_id"], rows)


def flood_fill(pixels: DataFrame, x: int, y: int, color: tuple[int, int, int, int], boundary: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Fills the region of (x, y), by four neighbours: pixels of its colour, or up to a boundary's colour. A place outside an
    image leaves it as it is."""

    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        if not (0 <= x < w and 0 <= y < h):
            return p
        open_ = (p != np.array(boundary, np.uint8)).any(2) if boundary else (p == p[y, x]).all(2)
        todo = [(y, x)] if open_[y, x] else []
        while todo:  # a run of a row at a time
            i, j = todo.pop()
            row = open_[i]
            if not row[j]:
                continue
            shut = np.flatnonzero(~row[j:])
            hi = j + int(shut[0]) if shut.size else w
            shut = np.flatnonzero(~row[:j])
            lo = int(shut[-1]) + 1 if shut.size else 0
            row[lo:hi] = False
            p[i, lo:hi] = color
            for k in (i - 1, i + 1):
                if 0 <= k < h:
                    near = open_[k, lo:hi]
                    todo += [(k, lo + int(at)) for at in np.flatnonzero(near & ~np.concatenate([[False], near[:-1]]))]
        return p

    return per_image(pixels, run)


def sheared(p: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Each row moved by a fraction of pixels into rows of `size`: a pixel leaves the share of its right neighbour's place."""
    h, w = p.shape[:2]
    whole = np.floor(offsets).astype(int)
    weight = np.trunc(255 * (offsets - whole) + 1).astype(int)[:, None, None]
    v = p.astype(int)
    spill = v * weight // 256
    moved = np.concatenate([v - spill, np.zeros((h, 1, 4), int)], 1)
    moved[:, 1:] += spill
    out = np.zeros((h, size, 4), np.uint8)
    at = np.arange(w + 1)[None] + whole[:, None]
    good = (at >= 0) & (at < size)
    rows = np.broadcast_to(np.arange(h)[:, None], at.shape)
    out[rows[good], at[good]] = np.clip(moved, 0, 255)[good]
    return out


def turned(p: np.ndarray, angle: float) -> np.ndarray:
    """Counter-clockwise by any angle in degrees: quarters exactly, the rest by three shears; the image grows."""
    quarters = round(angle / 90)
    p, rest = np.rot90(p, quarters % 4), angle - 90 * quarters
    if abs(rest) < 1e-9:
        return p
    a = math.radians(rest)
    tan, sin, cos = math.tan(a / 2), math.sin(a), math.cos(a)
    h, w = p.shape[:2]
    width = int(w + h * abs(tan) + 0.5)
    rows = np.arange(h) + 0.5
    p = sheared(p, rows * tan if tan >= 0 else (rows - h) * tan, width)
    height = int(w * abs(sin) + h * cos + 0.5) + 1
    start = (w - 1) * sin if sin >= 0 else (w - width) * -sin
    p = sheared(p.transpose(1, 0, 2), start - np.arange(width) * sin, height).transpose(1, 0, 2)
    final = int(h * abs(sin) + w * cos + 0.5) + 1
    start = (w - 1) * sin * -tan if sin >= 0 else tan * ((w - 1) * -sin + (1 - height))
    return sheared(p, start + np.arange(height) * tan, final)


def rotate(pixels: DataFrame, angle: float) -> DataFrame:
    return per_image(pixels, lambda p: turned(p, angle))


def rotate_each(pixels: DataFrame, angles: DataFrame) -> DataFrame:
    """Every image by its own angle, of (image_id, angle); an image without one isn't turned."""
    given = angles.select("image_id", F.col("angle").cast("double").alias("argument"))
    return per_image(pixels, lambda p, angle: turned(p, angle or 0.0), given)
