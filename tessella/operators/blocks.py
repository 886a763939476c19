"""Block formats: 4 x 4 blocks of pixels.

Block truncation and one-bit packing are grouped aggregates over pixels. The DXT and ATI formats are numpy kernels over
packed frames, all blocks of an image at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import arrow


def btc_encode(pixels: DataFrame, channel: str = "g") -> DataFrame:
    """(image_id, bx, by, upper, lower, mask): means of the pixels above the block's mean and of the others, and a bit for each
    pixel above, the first pixel's lowest. Images are whole blocks wide and high."""
    x, y, v = F.col("x"), F.col("y"), F.col(channel).cast("long")
    placed = pixels.select("image_id", F.floor(x / 4).alias("bx"), F.floor(y / 4).alias("by"), (y % 4 * 4 + x % 4).cast("int").alias("k"), v.alias("v"))
    # a block's 16 values are gathered once; everything else is a projection
    block = placed.groupBy("image_id", "bx", "by").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b)
    block = block.withColumn("mean", F.floor(total(F.col("v")) / 16))
    above, below = F.filter("v", lambda s: s > F.col("mean")), F.filter("v", lambda s: s <= F.col("mean"))
    mask = total(F.transform("v", lambda s, i: F.when(s > F.col("mean"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0)))
    mean = lambda xs: F.when(F.size(xs) > 0, F.floor(total(xs) / F.greatest(F.size(xs), F.lit(1)))).otherwise(0)
    return block.select("image_id", "bx", "by", mean(above).alias("upper"), mean(below).alias("lower"), mask.alias("mask"))


def btc_decode(blocks: DataFrame, channel: str = "g") -> DataFrame:
    each = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    bit = F.expr("shiftright(mask, k)").bitwiseAND(1)
    return each.select("image_id", (F.col("bx") * 4 + F.col("k") % 4).alias("x"), (F.col("by") * 4 + F.floor(F.col("k") / 4)).alias("y"), F.when(bit == 1, F.col("upper")).otherwise(F.col("lower")).alias(channel))


def binary_pack(pixels: DataFrame, channel: str = "g", threshold: int = 128) -> DataFrame:
    """(image_id, y, byte, bits): eight pixels a byte, the first the highest bit, set if above the threshold."""
    bit = F.when(F.col(channel) > threshold, F.expr("shiftleft(1, cast(7 - x % 8 as int))")).otherwise(0)
    return pixels.groupBy("image_id", "y", F.floor(F.col("x") / 8).alias("byte")).agg(F.sum(bit).alias("bits"))


def binary_unpack(packed: DataFrame, channel: str = "g") -> DataFrame:
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    bit = F.expr("shiftright(bits, 7 - k)").bitwiseAND(1)
    return each.select("image_id", (F.col("byte") * 8 + F.col("k")).alias("x"), "y", (bit * 255).alias(channel))


# kernels: blocks [n, 16, 4] of alpha, red, green, blue


def to_blocks(p: np.ndarray) -> np.ndarray:
    """Sizes that aren't whole blocks are stretched to the next one by nearest neighbour."""
    h, w = p.shape[:2]
    th, tw = -(-h // 4) * 4, -(-w // 4) * 4
    if (th, tw) != (h, w):
        p = p[(np.arange(th) * ((h << 16) // th)) >> 16][:, (np.arange(tw) * ((w << 16) // tw)) >> 16]
    return p.reshape(th // 4, 4, tw // 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 4).astype(int)


def from_blocks(b: np.ndarray, w: int, h: int) -> np.ndarray:
    bh, bw = -(-h // 4), -(-w // 4)
    return b.reshape(bh, bw, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)[:h, :w].astype(np.uint8)


def pack565(c: np.ndarray) -> np.ndarray:
    return (c[..., 0] >> 3) << 11 | (c[..., 1] >> 2) << 5 | c[..., 2] >> 3


def unpack565(v: np.ndarray) -> np.ndarray:
    v = v.astype(int)
    return np.stack([(v >> 11) * 255 // 31, (v >> 5 & 63) * 255 // 63, (v & 31) * 255 // 31], -1)


def ends(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two colours of each block that lie farthest apart, packed, the larger first."""
    gap = ((rgb[:, :, None] - rgb[:, None]) ** 2).sum(3).reshape(len(rgb), -1)
    at, rows = gap.argmax(1), np.arange(len(rgb))
    one, two = pack565(rgb[rows, at // 16]), pack565(rgb[rows, at % 16])
    return np.maximum(one, two), np.minimum(one, two)


def ramp(c0: np.ndarray, c1: np.ndarray, three: np.ndarray) -> np.ndarray:
    """[n, 4, 3]: the ends and colours between them; where `three`, one in the middle and black."""
    a, b = unpack565(c0), unpack565(c1)
    t = three[:, None]
    return np.stack([a, b, np.where(t, (a + b) // 2, (2 * a + b + 1) // 3), np.where(t, 0, (a + 2 * b + 1) // 3)], 1)


def bits(index: np.ndarray, size: int) -> np.ndarray:
    return (index.astype(np.uint64) << (np.arange(index.shape[1], dtype=np.uint64) * np.uint64(size))).sum(1, dtype=np.uint64)


def unbits(v: np.ndarray, size: int, count: int = 16) -> np.ndarray:
    return (v.astype(np.uint64)[:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(size)) & np.uint64((1 << size) - 1)).astype(int)


def color_encode(b: np.ndarray, clear: bool) -> np.ndarray:
    """[n, 8] bytes. clear: pixels with alpha under 128 take the transparent entry, in blocks that have any."""
    rgb = b[:, :, 1:]
    c0, c1 = ends(rgb)
    three = (b[:, :, 0] < 128).any(1) if clear else np.zeros(len(b), bool)
    c0, c1 = np.where(three, np.minimum(c0, c1), c0), np.where(three, np.maximum(c0, c1), c1)
    index = ((rgb[:, :, None] - ramp(c0, c1, three)[:, None]) ** 2).sum(3)
    index[three, :, 3] = 1 << 30
    index = index.argmin(2)
    index[(c0 == c1) & ~three] = 0
    index[three[:, None] & (b[:, :, 0] < 128)] = 3
    out = np.zeros(len(b), np.dtype([("c0", "<u2"), ("c1", "<u2"), ("m", "<u4")]))
    out["c0"], out["c1"], out["m"] = c0, c1, bits(index, 2)
    return out.view(np.uint8).reshape(-1, 8)


def color_decode(raw: np.ndarray, clear: bool) -> np.ndarray:
    v = np.ascontiguousarray(raw).view(np.dtype([("c0", "<u2"), ("c1", "<u2"), ("m", "<u4")])).ravel()
    three = (v["c0"] <= v["c1"]) if clear else np.zeros(len(v), bool)
    index = unbits(v["m"], 2)
    out = np.full((len(v), 16, 4), 255)
    out[:, :, 1:] = np.take_along_axis(ramp(v["c0"], v["c1"], three), index[..., None], 1)
    out[:, :, 0][three[:, None] & (index == 3)] = 0
    return out


def eight(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """[n, 8] levels: six between the ends if the first is larger, else four, 0 and 255."""
    a, b, k = a0[:, None].astype(int), a1[:, None].astype(int), np.arange(1, 7)[None]
    six = (a * (7 - k) + b * k + 3) // 7
    four = np.concatenate([(a * (5 - k[:, :4]) + b * k[:, :4] + 2) // 5, np.tile([0, 255], (len(a0), 1))], 1)
    return np.concatenate([a, b, np.where(a > b, six, four)], 1)


def level_encode(v: np.ndarray) -> np.ndarray:
    """[n, 8] bytes of one channel [n, 16]: its extremes and three bits a pixel."""
    a0, a1 = v.max(1), v.min(1)
    index = np.abs(v[:, :, None] - eight(a0, a1)[:, None]).argmin(2)
    packed = bits(index, 3)
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = a0, a1
    for k in range(6):
        out[:, 2 + k] = packed >> np.uint64(8 * k) & np.uint64(255)
    return out


def level_decode(raw: np.ndarray) -> np.ndarray:
    packed = sum(raw[:, 2 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(6))
    return np.take_along_axis(eight(raw[:, 0], raw[:, 1]), unbits(packed, 3), 1)


def nibble_encode(a: np.ndarray) -> np.ndarray:
    return bits(a >> 4, 4).astype("<u8").view(np.uint8).reshape(-1, 8)


def nibble_decode(raw: np.ndarray) -> np.ndarray:
    return unbits(np.ascontiguousarray(raw).view("<u8").ravel(), 4) * 17


def with_alpha(rgb: np.ndarray, a: np.ndarray) -> np.ndarray:
    rgb[:, :, 0] = a
    return rgb


def gray_of(a: np.ndarray) -> np.ndarray:
    return np.stack([np.full(a.shape, 255), a, a, a], 2)


def two_of(r: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.stack([np.full(r.shape, 255), r, g, np.zeros(r.shape, int)], 2)


#: name -> (bytes of a block, encoder, decoder)
FORMATS: dict[str, tuple[int, Callable, Callable]] = {
    "DXT1": (8, lambda b: color_encode(b, True), lambda r: color_decode(r, True)),
    "DXT3": (16, lambda b: np.hstack([nibble_encode(b[:, :, 0]), color_encode(b, False)]), lambda r: with_alpha(color_decode(r[:, 8:], False), nibble_decode(r[:, :8]))),
    "DXT5": (16, lambda b: np.hstack([level_encode(b[:, :, 0]), color_encode(b, False)]), lambda r: with_alpha(color_decode(r[:, 8:], False), level_decode(r[:, :8]))),
    "ATI1N": (8, lambda b: level_encode(b[:, :, 1]), lambda r: gray_of(level_decode(r))),
    "ATI2N": (16, lambda b: np.hstack([level_encode(b[:, :, 1]), level_encode(b[:, :, 2])]), lambda r: two_of(level_decode(r[:, :8]), level_decode(r[:, 8:]))),
}


def compress(frames: DataFrame, kind: str) -> DataFrame:
    """frames (width, height, bits) with bits compressed. No shuffle; an image is a row."""
    make = FORMATS[kind][1]
    return over_bits(frames, lambda raw, w, h: make(to_blocks(np.frombuffer(raw, np.uint8).reshape(h, w, 4))).astype(np.uint8).tobytes())


def decompress(frames: DataFrame, kind: str) -> DataFrame:
    size, _, back = FORMATS[kind]
    return over_bits(frames, lambda raw, w, h: from_blocks(back(np.frombuffer(raw, np.uint8).reshape(-1, size)), w, h).tobytes())


def over_bits(frames: DataFrame, f: Callable[[bytes, int, int], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.parts(batches, "bits"):
            made = [None if raw is None else f(raw, w, h) for raw, w, h in zip(*(b.column(c).to_pylist() for c in ("bits", "width", "height")))]
            yield b.set_column(b.schema.get_field_index("bits"), "bits", pa.array(made, pa.binary()))

    return arrow.through(frames, run, frames.schema)
