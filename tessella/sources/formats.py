"""Raster data in any of the pixel formats, and conversion between all of them, as Arrow kernels over frames.

A typed frame is a row (..., width, height, pixel_format, bits, palette): bits are the rows of pixels without gaps, in the byte
order of the format; palette is 256 entries of blue, green, red, alpha for Index8, else null. Conversions go by class (index, gray,
channels, floats); channels meet at 16 bits, gray values at 64, floats as they are. Block formats and one-bit images
pass through the nearest plain format. A frame is a row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import arrow
from tessella.functions.color import GRAY, PACKED
from tessella.operators import blocks
from tessella.operators.palette import median_boxes

#: The plain format that a block or one-bit format is made from and decoded to.
NEAREST = {"DXT1": "A8R8G8B8", "DXT3": "A8R8G8B8", "DXT5": "A8R8G8B8", "BTC": "Gray8", "ATI1N": "Gray8", "ATI2N": "A8R8G8B8", "Binary": "Gray8"}


#: The columns of a typed frame.
TYPED = ["width", "height", "pixel_format", "bits", "palette"]


@dataclass(frozen=True)
class Format:
    name: str
    kind: str
    size: int
    alpha: bool

    @property
    def swapped(self) -> bool:
        """Whether red comes first in memory."""
        return "B" in self.name and "R" in self.name and self.name.index("B") < self.name.index("R")


@lru_cache(maxsize=64)
def named(name: str) -> Format:
    from tessella.model import FORMATS

    found = {n: (kind, size, alpha) for n, kind, size, _, alpha in FORMATS}
    if name not in found:
        raise ValueError(f"unknown pixel format {name}")
    return Format(name, *found[name])


def gray_palette() -> np.ndarray:
    """[256, 4] blue, green, red, alpha."""
    out = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    out[:, 3] = 255
    return out


def half_of(x: np.ndarray) -> np.ndarray:
    """Bits of the nearest half precision number; ties go to the larger magnitude, too large ones to infinity. Magnitudes
    below 2^-25 are 0."""
    raw = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.int64)
    sign, exponent, mantissa = raw >> 31 << 15, (raw >> 23 & 255) - 112, raw & 0x7FFFFF
    plain = (np.maximum(exponent, 0) << 10) + (mantissa + 0x1000 >> 13)  # a carry goes into the exponent
    tiny = (mantissa | 0x800000) >> np.clip(1 - exponent, 0, 31)
    tiny = np.where(exponent < -10, 0, tiny + 0x1000 >> 13)
    out = np.where(exponent <= 0, tiny, np.minimum(plain, 0x7C00))
    nan = (exponent == 143) & (mantissa > 0)
    out = np.where(exponent == 143, 0x7C00, out) | np.where(nan, mantissa >> 13, 0)
    return np.where((exponent < -10) | (raw << 1 & 0xFFFFFFFF == 0), 0, sign | out).astype(np.uint16)


def level_of(rgb: np.ndarray) -> np.ndarray:
    """Gray values of [n, 3], not rounded; added up in the order of the channels, as a half must be one everywhere."""
    return GRAY[0] * rgb[:, 0] + GRAY[1] * rgb[:, 1] + GRAY[2] * rgb[:, 2]


# samples of a frame: index [n], gray (uint64 [n], alpha [n]), channels uint16 [n, 4] or floats [n, 4] as alpha, red, green, blue


def read_channels(f: Format, raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // f.size, 4), np.int64)
    if f.name in PACKED:
        v, at = np.frombuffer(raw, f"<u{f.size}").astype(np.int64), 0
        for bits, k in reversed(list(zip(PACKED[f.name], range(4)))):
            if bits:
                out[:, k] = (v >> at & (1 << bits) - 1) * 255 // ((1 << bits) - 1) << 8
                at += bits
    else:
        wide = f.size >= 6
        v = np.frombuffer(raw, "<u2" if wide else np.uint8).reshape(len(out), -1).astype(np.int64)
        order = [1, 2, 3, 0] if f.swapped else [3, 2, 1, 0]
        for place, k in enumerate(order[: v.shape[1]]):
            out[:, k] = v[:, place] if wide else v[:, place] * 257
    if not f.alpha:
        out[:, 0] = 65535
    return out


def write_channels(f: Format, c: np.ndarray) -> bytes:
    if f.name in PACKED:
        v, at = np.zeros(len(c), np.int64), 0
        for bits, k in reversed(list(zip(PACKED[f.name], range(4)))):
            if bits:
                v |= (c[:, k] >> 8) >> (8 - bits) << at
                at += bits
        return v.astype(f"<u{f.size}").tobytes()
    order = [1, 2, 3, 0] if f.swapped else [3, 2, 1, 0]
    count = f.size // (2 if f.size >= 6 else 1)
    v = c[:, order[:count]]
    return v.astype("<u2").tobytes() if f.size >= 6 else (v * 255 // 65535).astype(np.uint8).tobytes()


def read_gray(f: Format, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // f.size
    alpha = np.full(n, 65535, np.int64)
    if f.alpha:
        v = np.frombuffer(raw, "<u2" if f.size == 4 else np.uint8).reshape(n, 2).astype(np.uint64)
        times = 1 if f.size == 4 else 257
        return v[:, 0] * np.uint64(times) << np.uint64(48), v[:, 1].astype(np.int64) * times
    v = np.frombuffer(raw, f"<u{f.size}").astype(np.uint64)
    return (v * np.uint64(257) << np.uint64(48) if f.size == 1 else v << np.uint64(64 - 8 * f.size)), alpha


def write_gray(f: Format, gray: np.ndarray, alpha: np.ndarray) -> bytes:
    top = (gray >> np.uint64(48)).astype(np.int64)
    if f.alpha:
        v = np.stack([top, alpha], 1)
        return v.astype("<u2").tobytes() if f.size == 4 else (v * 255 // 65535).astype(np.uint8).tobytes()
    if f.size == 1:
        return (top * 255 // 65535).astype(np.uint8).tobytes()
    return (gray >> np.uint64(64 - 8 * f.size)).astype(f"<u{f.size}").tobytes()


def read_floats(f: Format, raw: bytes) -> np.ndarray:
    half = f.size in (2, 8)
    v = np.frombuffer(raw, "<f2" if half else "<f4").astype(np.float64)
    count = f.size // (2 if half else 4)
    v = v.reshape(-1, count)
    out = np.zeros((len(v), 4))
    order = [1] if count == 1 else [1, 2, 3, 0] if f.swapped else [3, 2, 1, 0]
    for place, k in enumerate(order[:count]):
        out[:, k] = v[:, place]
    if not f.alpha:
        out[:, 0] = 1.0
    return out


def write_floats(f: Format, x: np.ndarray) -> bytes:
    half = f.size in (2, 8)
    count = f.size // (2 if half else 4)
    order = [1] if count == 1 else [1, 2, 3, 0] if f.swapped else [3, 2, 1, 0]
    v = x[:, order[:count]]
    return half_of(v).astype("<u2").tobytes() if half else v.astype("<f4").tobytes()


def clamped(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=0.0), 0, 1)


def eight_bits(f: Format, raw: bytes) -> np.ndarray:
    """[n, 4] alpha, red, green, blue of 8 bits, for palettes."""
    if f.kind == "float":
        return np.rint(clamped(read_floats(f, raw)) * 255).astype(int)
    if f.kind == "gray":
        gray, alpha = read_gray(f, raw)
        top = (gray >> np.uint64(56)).astype(int)
        return np.stack([alpha >> 8, top, top, top], 1)
    return read_channels(f, raw) >> 8


def to_index(f: Format, raw: bytes, entries: int = 256, mask: int = 255) -> tuple[bytes, np.ndarray]:
    colors = eight_bits(f, raw)
    if f.kind == "gray":
        return colors[:, 1].astype(np.uint8).tobytes(), gray_palette()
    distinct, back, counts = np.unique(colors, axis=0, return_inverse=True, return_counts=True)
    found = median_boxes(distinct, counts, entries, mask)
    palette = np.zeros((256, 4), np.uint8)
    palette[:, 3] = 255
    palette[: len(found.colors)] = found.colors[:, [3, 2, 1, 0]]
    return found.index(distinct)[back.ravel()].astype(np.uint8).tobytes(), palette


def plain(source: Format, to: Format, raw: bytes, palette: np.ndarray | None) -> tuple[bytes, np.ndarray | None]:
    """bits and palette of plain formats."""
    if source.name == to.name:
        return raw, palette
    if to.kind == "index":
        return to_index(source, raw)
    if source.kind == "index":
        entries = (palette if palette is not None else gray_palette()).astype(np.int64)[:, [3, 2, 1, 0]][np.frombuffer(raw, np.uint8)]
        if to.kind == "float":
            return write_floats(to, entries / 255), None
        if to.kind == "gray":
            level = np.rint(level_of(entries[:, 1:])).astype(np.int64)
            if to.name == "Gray8":
                return level.astype(np.uint8).tobytes(), None
            return write_gray(to, (level * 257).astype(np.uint64) << np.uint64(48), entries[:, 0] << 8), None
        return write_channels(to, entries * 257 if to.name in ("R8G8B8", "A8R8G8B8") else entries << 8), None
    if source.kind == "gray":
        if (source.name, to.name) == ("Gray8", "Gray16"):
            return (np.frombuffer(raw, np.uint8).astype("<u2") << 8).tobytes(), None
        if (source.name, to.name) == ("Gray16", "Gray8"):
            return (np.frombuffer(raw, "<u2") >> 8).astype(np.uint8).tobytes(), None
        gray, alpha = read_gray(source, raw)
        if to.kind == "gray":
            return write_gray(to, gray, alpha), None
        top = (gray >> np.uint64(48)).astype(np.int64)
        four = np.stack([alpha, top, top, top], 1)
        return (write_floats(to, four / 65535) if to.kind == "float" else write_channels(to, four)), None
    if source.kind == "float":
        x = read_floats(source, raw)
        if to.kind == "float":
            return write_floats(to, x), None
        x = clamped(x)
        if to.kind == "argb":
            return write_channels(to, np.rint(x * 65535).astype(np.int64)), None
        top = np.clip(np.rint(level_of(x[:, 1:]) * 65535), 0, 65535).astype(np.uint64)
        return write_gray(to, top << np.uint64(48), np.rint(x[:, 0] * 65535).astype(np.int64)), None
    c = read_channels(source, raw)
    if to.kind == "argb":
        return write_channels(to, c), None
    if to.kind == "float":
        return write_floats(to, c / 65535), None
    if to.name == "Gray8" and source.size in (3, 4):
        return np.rint(level_of(c[:, 1:] // 257)).astype(np.uint8).tobytes(), None
    words = np.concatenate([np.rint(level_of(c[:, 1:])).astype(np.int64)[:, None], c[:, 1:]], 1).astype(np.uint64)
    gray = words[:, 0] << np.uint64(48) | words[:, 1] << np.uint64(32) | words[:, 2] << np.uint64(16) | words[:, 3]
    return write_gray(to, gray, c[:, 0]), None


def btc_encode(v: np.ndarray) -> np.ndarray:
    """[n, 4] bytes of blocks [n, 16]: mean of the values up to the block's mean, of those above, a bit for each above."""
    v = v.astype(int)
    above = v > (v.sum(1) // 16)[:, None]
    many = above.sum(1)
    out = np.zeros((len(v), 4), np.uint8)
    out[:, 0] = (v * ~above).sum(1) // np.maximum(1, 16 - many)
    out[:, 1] = (v * above).sum(1) // np.maximum(1, many)
    mask = (above << np.arange(16)).sum(1)
    out[:, 2], out[:, 3] = mask & 255, mask >> 8
    return out


def btc_decode(raw: np.ndarray) -> np.ndarray:
    mask = raw[:, 2].astype(int) | raw[:, 3].astype(int) << 8
    return np.where(mask[:, None] >> np.arange(16) & 1, raw[:, 1:2], raw[:, :1])


def to_argb(raw: bytes, w: int, h: int, gray: bool) -> np.ndarray:
    if gray:
        g = np.frombuffer(raw, np.uint8).reshape(h, w)
        return np.stack([np.full_like(g, 255), g, g, g], 2)
    return np.frombuffer(raw, np.uint8).reshape(h, w, 4)[..., [3, 2, 1, 0]]


def from_special(f: Format, raw: bytes, w: int, h: int) -> bytes:
    """Pixels of the format's nearest plain one."""
    if f.name == "Binary":
        rows = np.frombuffer(raw, np.uint8).reshape(h, -(-w // 8))
        return (np.unpackbits(rows, axis=1)[:, :w] * np.uint8(255)).tobytes()
    coded = np.frombuffer(raw, np.uint8).reshape(-1, f.size)
    if f.name == "BTC":
        g = btc_decode(coded)
        return blocks.from_blocks(np.repeat(g[..., None], 4, 2), w, h)[..., 0].tobytes()
    p = blocks.from_blocks(blocks.FORMATS[f.name][2](coded), w, h)
    return p[..., 1].tobytes() if NEAREST[f.name] == "Gray8" else p[..., [3, 2, 1, 0]].tobytes()


def to_special(f: Format, raw: bytes, w: int, h: int) -> tuple[bytes, int, int]:
    """(bits, width, height): block formats grow to whole blocks by nearest neighbour."""
    p = to_argb(raw, w, h, NEAREST[f.name] == "Gray8")
    if f.name == "Binary":
        return np.packbits(p[..., 1] > 128, axis=1).tobytes(), w, h
    b = blocks.to_blocks(p)
    coded = btc_encode(b[..., 1]) if f.name == "BTC" else blocks.FORMATS[f.name][1](b).astype(np.uint8)
    return coded.tobytes(), -(-w // 4) * 4, -(-h // 4) * 4


def converted(w: int, h: int, name: str, raw: bytes, palette: bytes | None, to: str) -> tuple[int, int, bytes, bytes | None]:
    """(width, height, bits, palette) of a frame in the format `to`."""
    source, target = named(name), named(to)
    entries = np.frombuffer(palette, np.uint8).reshape(256, 4) if palette else None
    if source.name == target.name:
        return w, h, raw, palette
    if source.name in NEAREST:
        raw, source = from_special(source, raw, w, h), named(NEAREST[source.name])
    near = named(NEAREST.get(to, to))
    raw, entries = plain(source, near, raw, entries)
    if to in NEAREST:
        raw, w, h = to_special(target, raw, w, h)
    return w, h, raw, None if entries is None else entries.tobytes()


def over_frames(frames: DataFrame, f: Callable[[int, int, str, bytes, bytes | None], tuple[int, int, str, bytes, bytes | None]]) -> DataFrame:
    types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.parts(batches, "bits"):  # a few frames at a time, as one may be large
            made = [r if None in r[:4] else f(*r) for r in zip(*(batch.column(n).to_pylist() for n in TYPED))]
            for n, v, t in zip(TYPED, zip(*made), types):
                batch = batch.set_column(batch.schema.get_field_index(n), n, pa.array(v, t))
            yield batch

    return arrow.through(frames, run, frames.schema)


def typed(frames: DataFrame) -> DataFrame:
    """Typed frames of packed ones (bits of alpha, red, green, blue): A8R8G8B8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(["A8R8G8B8"] * n), pa.nulls(n, pa.binary())], names=[*batch.schema.names, "pixel_format", "palette"])

    kept = frames.drop("pixel_format", "palette") if {"pixel_format", "palette"} & set(frames.columns) else frames
    fields = [*kept.schema.fields, T.StructField("pixel_format", T.StringType()), T.StructField("palette", T.BinaryType())]
    more = arrow.through(kept, run, T.StructType(fields))
    return over_frames(more, lambda w, h, name, bits, palette: (w, h, name, np.frombuffer(bits, np.uint8).reshape(-1, 4)[:, ::-1].tobytes(), None))


def convert(frames: DataFrame, to: str) -> DataFrame:
    """Typed frames in the format `to`; frames without bits pass through. An unknown format is an error."""
    named(to)

    def run(w: int, h: int, name: str, bits: bytes, palette: bytes | None) -> tuple:
        w, h, bits, palette = converted(w, h, name, bits, palette, to)
        return w, h, to, bits, palette

    return over_frames(frames, run)


def untyped(frames: DataFrame) -> DataFrame:
    """Packed frames (alpha, red, green, blue) of typed ones."""

    def run(w: int, h: int, name: str, bits: bytes, palette: bytes | None) -> tuple:
        w, h, bits, _ = converted(w, h, name, bits, palette, "A8R8G8B8")
        return w, h, name, np.frombuffer(bits, np.uint8).reshape(-1, 4)[:, ::-1].tobytes(), None

    made = over_frames(frames, run)
    names = [c for c in made.columns if c not in ("pixel_format", "palette")]

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names)

    return arrow.through(made, without, T.StructType([made.schema[c] for c in names]))


def valid(frames: DataFrame) -> DataFrame:
    """Typed frames with `valid`: a known format, a size above 0, and as many bytes as the format and size ask for."""
    from tessella.model import formats, pixels_size

    known = F.broadcast(formats(frames.sparkSession).withColumnRenamed("name", "pixel_format"))  # a row a format
    sized = pixels_size(frames.join(known, "pixel_format", "left").select(*frames.columns, "class", "bytes"))
    good = (F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("bits") == F.col("size"))
    return sized.withColumn("valid", F.coalesce(good, F.lit(False))).drop("class", "bytes", "size")


def described(frames: DataFrame) -> DataFrame:
    """Typed frames with `text`, in words: `A8R8G8B8 640x480, 1200 KiB`."""
    size = F.format_number(F.octet_length("bits") / 1024, 0)
    return frames.withColumn("text", F.concat(F.col("pixel_format"), F.lit(" "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(", "), size, F.lit(" KiB")))


def sample_values(name: str, raw: bytes, palette: bytes | None = None) -> np.ndarray:
    """[n, 4] alpha, red, green, blue as the format has them: floats as they are, channels and gray at 16 bits, palette entries at 8."""
    f = named(name)
    if f.kind == "float":
        return read_floats(f, raw)
    if f.kind == "gray":
        gray, alpha = read_gray(f, raw)
        top = (gray >> np.uint64(48)).astype(float)
        return np.stack([alpha.astype(float), top, top, top], 1)
    if f.kind == "index":
        entries = np.frombuffer(palette, np.uint8).reshape(256, 4) if palette else gray_palette()
        return entries[:, [3, 2, 1, 0]][np.frombuffer(raw, np.uint8)].astype(float)
    return read_channels(f, raw).astype(float)


def samples(frames: DataFrame, key: list[str], rows: int = 50_000) -> DataFrame:
    """A row per pixel with the key's columns, x, y and a, r, g, b as doubles: `sample_values` of plain formats; block and one-bit
    formats go through their nearest plain one."""
    kept = arrow.narrowed(frames, *key, *TYPED)
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in key) + ", x int, y int, a double, r double, g double, b double"

    def value(w: int, h: int, name: str, raw: bytes, palette: bytes | None) -> np.ndarray:
        if name in NEAREST:
            raw, name = from_special(named(name), raw, w, h), NEAREST[name]
        return sample_values(name, raw, palette)

    return arrow.through(kept, lambda batches: arrow.spread(batches, key, value, tuple(TYPED), rows), schema)


def with_pixel(frames: DataFrame, x: int, y: int, color: tuple[float, float, float, float]) -> DataFrame:
    """Typed frames with the pixel at a place set to a colour of alpha, red, green, blue as fractions of 1; frames that don't have the
    place, and indexed ones, stay as they are."""

    def run(w: int, h: int, name: str, bits: bytes, palette: bytes | None) -> tuple:
        f = named(name)
        if f.kind in ("argb", "gray", "float") and 0 <= x < w and 0 <= y < h:
            source = np.array([[color[0], color[1], color[2], color[3]]], "<f4")
            raw, _ = plain(named("A32R32G32B32F"), f, source[:, [3, 2, 1, 0]].tobytes(), None)
            at = (y * w + x) * f.size
            bits = bits[:at] + raw + bits[at + f.size :]
        return w, h, name, bits, palette

    return over_frames(frames, run)


def has_alpha(frames: DataFrame) -> DataFrame:
    """Typed frames with `has_alpha`: whether an alpha bit (of a 16-bit format with one) or an alpha byte of any pixel isn't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for name, bits in zip(b.column("pixel_format").to_pylist(), b.column("bits").to_pylist()):
                f = named(name)
                if f.size == 2 and f.kind == "argb":
                    made.append(bool((np.frombuffer(bits, "<u2") >> 15).any()))
                else:
                    made.append(f.size == 4 and f.kind == "argb" and bool(np.frombuffer(bits, np.uint8)[3::4].any()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.bool_())], names=[*b.schema.names, "has_alpha"])

    return arrow.through(frames, run, T.StructType([*frames.schema.fields, T.StructField("has_alpha", T.BooleanType())]))
