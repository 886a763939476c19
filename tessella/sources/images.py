"""Images as tables: files, packed frames (a row per frame) and pixels (a row per pixel).

Files come through Spark's binaryFile source, so any store that Spark reads will do, in batches or as a stream. Decoding and encoding
run in Arrow batches on executors, a few files at a time. A frame row holds alpha, red, green and blue bytes.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import arrow
from tessella.sources import codecs, formats

FRAMES = "path string, frame_idx int, width int, height int, format string, bits binary, error string"


def files(spark: SparkSession, path: str, mask: str = "*", recursive: bool = False, stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content; a listing alone (without content) reads no file."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", str(recursive).lower())
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path)


def detect(table: DataFrame) -> DataFrame:
    """table (path, content) with format, by name and signature; null if no codec fits. Only the head of a file is sent to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [codecs.detect(h or b"", p or "") for p, h in zip(b.column("path").to_pylist(), b.column("head").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([c and c.name for c in found], pa.string())], names=["path", "format"])

    return table.select("path", F.substring("content", 1, 256).alias("head")).mapInArrow(run, "path string, format string")


def decode(table: DataFrame, first_only: bool = False) -> DataFrame:
    """FRAMES of (path, content). A file that can't be decoded gives one row with its error and no bits; an empty or null content
    as well."""

    names = [f.split()[0] for f in FRAMES.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in arrow.parts(batches, "content"):
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                raw = raw or b""
                codec = codecs.detect(raw, path or "")
                try:
                    if codec is None:
                        raise codecs.CodecError("unknown format")
                    frames = codec.decode(raw)
                    made = [(path, i, p.shape[1], p.shape[0], codec.name, p.tobytes(), None) for i, p in enumerate(frames[:1] if first_only else frames)]
                except Exception as e:  # a broken file is a row, not a failed job
                    made = [(path, 0, None, None, codec and codec.name, None, f"{type(e).__name__}: {e}")]
                yield from made

    return arrow.through(arrow.narrowed(table, "path", "content"), lambda batches: arrow.gathered(rows(batches), names, types), FRAMES)


def read(spark: SparkSession, path: str, first_only: bool = False, **how) -> DataFrame:
    return decode(files(spark, path, **how), first_only)


def to_pixels(frames: DataFrame, key: list[str]) -> DataFrame:
    """A row per pixel with the key's columns, x, y, a, r, g, b: by array functions, without Python."""
    at = F.col("i")
    byte = lambda k: F.conv(F.hex(F.substring("bits", at * 4 + 1 + k, 1)), 16, 10).cast("int")
    good = frames.where("bits is not null and width > 0 and height > 0")
    each = good.select(*key, "width", "bits", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return each.select(*key, (at % F.col("width")).alias("x"), F.floor(at / F.col("width")).cast("int").alias("y"), *(byte(k).alias(c) for k, c in enumerate("argb")))


def to_pixels_fast(frames: DataFrame, key: list[str], rows: int = 50_000) -> DataFrame:
    """The same by Arrow kernels, for images so large that substrings cost too much; batches have `rows` pixels at most."""
    kept = arrow.narrowed(frames, *key, "width", "bits")
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in key) + ", x int, y int, a int, r int, g int, b int"
    value = lambda bits: np.frombuffer(bits, np.uint8).reshape(-1, 4).astype(np.int32)
    return arrow.through(kept, lambda batches: arrow.spread(batches, key, value, ("bits",), rows), schema)


def raster(found: list[dict]) -> np.ndarray:
    """[h, w, 4] of an image's pieces."""
    x, y, *channels = arrow.joined(found, arrow.PIXEL)
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
    out[y, x] = np.stack(channels, 1)
    return out


def from_pixels(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, width, height, bits): the pixels of each image put in order; missing ones are 0. An image is one row and so one task's;
    its pixels are packed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            kept = batch.column(key).slice(k + 1 - len(held), len(held))
            return pa.RecordBatch.from_arrays([kept, *(pa.array([p.shape[c] for p in held], pa.int32()) for c in (1, 0)), pa.array([p.tobytes() for p in held], pa.binary())], names=[key, "width", "height", "bits"])

        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                held.append(raster(batch.column("_pieces")[k].as_py()))
                size += held[-1].size
                if size >= 4_000_000 or k + 1 == batch.num_rows:
                    yield emit()
                    held, size = [], 0

    kind = pixels.schema[key].dataType.simpleString()
    return arrow.through(arrow.pieces(pixels, key, arrow.PIXEL), run, f"`{key}` {kind}, width int, height int, bits binary")


def encode(frames: DataFrame, kind: str, key: str = "image_id", frame: str | None = None, **options) -> DataFrame:
    """(key, content): a file for each image in a format that can be written. frame: the column of the frames' order; formats
    without frames take the first. options: arguments of the format's encoder (quality, progressive, runs, delay, kind ...)."""
    codec = codecs.by_name(kind) or codecs.by_extension(f".{kind}")
    if codec is None or codec.writes is None:
        raise ValueError(f"{kind} can't be written")
    known = set(inspect.signature(codec.writes).parameters)
    if unknown := set(options) - known:
        raise ValueError(f"{kind} has no option {', '.join(sorted(unknown))}")
    make = partial(codec.writes, **options)
    shape = lambda w, h, b: np.frombuffer(b, np.uint8).reshape(h, w, 4)
    schema = f"{key} {frames.schema[key].dataType.simpleString()}, content binary"
    if frame is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in arrow.parts(batches, "bits"):
                b = b.filter(b.column("bits").is_valid())
                made = [make([shape(*r)]) for r in zip(*(b.column(c).to_pylist() for c in ("width", "height", "bits")))]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, pa.binary())], names=[key, "content"])

        return arrow.through(arrow.narrowed(frames, key, "width", "height", "bits"), run, schema)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by(frame)
        made = make([shape(*r) for r in zip(*(table.column(c).to_pylist() for c in ("width", "height", "bits")))])
        return pa.table({key: table.column(key).slice(0, 1), "content": pa.array([made], pa.binary())})

    return frames.where("bits is not null").select(key, frame, "width", "height", "bits").groupBy(key).applyInArrow(group, schema)


def encode_each(frames: DataFrame, kinds: list[str], key: str = "image_id", size: int = 256) -> DataFrame:
    """(key, kind, head): the first `size` bytes of a file for each frame in each of several formats, in one pass over the frames."""
    makers = {kind: codecs.by_name(kind).writes for kind in kinds}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in arrow.parts(batches, "bits"):
            for k, w, h, bits in zip(*(b.column(c).to_pylist() for c in (key, "width", "height", "bits"))):
                if bits is not None:
                    p = np.frombuffer(bits, np.uint8).reshape(h, w, 4)
                    yield from ((k, kind, make([p])[:size]) for kind, make in makers.items())

    own = frames.schema[key].dataType
    types = [to_arrow_type(own), pa.string(), pa.binary()]
    kept = arrow.narrowed(frames, key, "width", "height", "bits")
    return arrow.through(kept, lambda batches: arrow.gathered(rows(batches), [key, "kind", "head"], types), f"`{key}` {own.simpleString()}, kind string, head binary")


def write_files(table: DataFrame, folder: str, name: str = "name") -> list[str]:
    """Writes (name, content) rows as files under a folder that executors reach; a file appears whole or not at all. Returns how
    many rows each task wrote, as text. A folder without a scheme lies on the file system that Spark's own writes go to."""
    sc = table.sparkSession.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(folder)
    folder = place.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done = 0
        for batch in batches:
            for n, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(raw or b"")
                system.move(part, f"{root}/{n}")
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([str(done)])], names=["rows"])

    return [r.rows for r in table.select(F.col(name).alias("name"), "content").mapInArrow(run, "rows string").collect()]


#: Bytes of a pixel in the formats that raw reading and writing take, and their channels' order.
RAW = {"Gray8": "g", "R8G8B8": "bgr", "A8R8G8B8": "bgra", "X8R8G8B8": "bgrx"}


def read_raw(table: DataFrame, width: int, height: int, kind: str = "A8R8G8B8", offset: int = 0, row_length: int = 0) -> DataFrame:
    """FRAMES of headerless rasters (path, content): rows of `width` pixels from `offset` on, `row_length` bytes apart (0: no gap)."""
    order = RAW[kind]

    def frame(raw: bytes) -> np.ndarray:
        line, size = row_length or width * len(order), width * len(order)
        rows = np.stack([np.frombuffer(raw, np.uint8, size, offset + y * line) for y in range(height)])
        v = rows.reshape(height, width, len(order))
        if order == "g":
            return codecs.from_gray(v[..., 0])
        return codecs.from_rgb(v[..., 2::-1], v[..., 3] if "a" in order else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [frame(raw).tobytes() for raw in batch.column("content").to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([v] * n, pa.int32()) for v in (0, width, height)), pa.array([kind] * n), pa.array(made, pa.binary()), pa.nulls(n, pa.string())], names=[f.split()[0] for f in FRAMES.split(", ")])

    return table.select("path", "content").mapInArrow(run, FRAMES)


def write_raw(frames: DataFrame, key: str, kind: str = "A8R8G8B8", offset: int = 0, row_length: int = 0) -> DataFrame:
    """(key, content): headerless rasters, zeros before the offset and between rows."""
    order = RAW[kind]

    def raw(w: int, h: int, bits: bytes) -> bytes:
        p = np.frombuffer(bits, np.uint8).reshape(h, w, 4)
        if order == "g":
            v = np.rint(formats.level_of(p.reshape(-1, 4)[:, 1:])).astype(np.uint8).reshape(h, w, 1)
        else:
            v = p[..., [{"a": 0, "r": 1, "g": 2, "b": 3, "x": 0}[c] for c in order]]
        line = row_length or w * len(order)
        out = np.zeros((h, line), np.uint8)
        out[:, : w * len(order)] = v.reshape(h, -1)
        return bytes(offset) + out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [raw(*r) for r in zip(*(b.column(c).to_pylist() for c in ("width", "height", "bits")))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, pa.binary())], names=[key, "content"])

    return frames.select(key, "width", "height", "bits").mapInArrow(run, f"{key} {frames.schema[key].dataType.simpleString()}, content binary")


# typed frames (see formats) without headers


def read_raw_typed(table: DataFrame, width: int, height: int, pixel_format: str, offset: int = 0, row_length: int = 0) -> DataFrame:
    """Typed frames of headerless rasters (path, content) in any plain pixel format. A raster that ends early is an error."""
    size = width * formats.named(pixel_format).size
    line = row_length or size

    def rows(raw: bytes) -> bytes:
        if len(raw) < offset + line * (height - 1) + size:
            raise codecs.CodecError("pixels end early")
        return b"".join(raw[offset + y * line : offset + y * line + size] for y in range(height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.parts(batches, "content"):
            n = batch.num_rows
            made = pa.array([rows(raw) for raw in batch.column("content").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([v] * n, pa.int32()) for v in (0, width, height)), pa.array([pixel_format] * n), made, pa.nulls(n, pa.binary())], names=["path", "frame_idx", *formats.TYPED])

    return arrow.through(arrow.narrowed(table, "path", "content"), run, "path string, frame_idx int, width int, height int, pixel_format string, bits binary, palette binary")


def write_raw_typed(frames: DataFrame, key: str, offset: int = 0, row_length: int = 0) -> DataFrame:
    """(key, content): headerless rasters of typed frames, zeros before the offset and between rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.parts(batches, "bits"):
            made = []
            for w, name, bits in zip(*(b.column(c).to_pylist() for c in ("width", "pixel_format", "bits"))):
                size = w * formats.named(name).size
                made.append(bytes(offset) + b"".join(bits[at : at + size].ljust(row_length, b"\0") for at in range(0, len(bits), size)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, pa.binary())], names=[key, "content"])

    return arrow.through(arrow.narrowed(frames, key, "width", "pixel_format", "bits"), run, f"{key} {frames.schema[key].dataType.simpleString()}, content binary")


def read_raw_rect(frames: DataFrame, table: DataFrame, key: str, left: int, top: int, width: int, height: int, offset: int = 0, row_length: int = 0) -> DataFrame:
    """Typed frames with a rectangle overwritten from headerless rasters (key, content) in their own pixel format; frames without a
    raster stay. The rectangle lies within the frames."""
    both = frames.join(table.select(key, F.col("content").alias("_raw")), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for w, name, bits, raw in zip(*(b.column(c).to_pylist() for c in ("width", "pixel_format", "bits", "_raw"))):
                size = formats.named(name).size
                if raw is not None:
                    out = np.frombuffer(bits, np.uint8).reshape(-1, w * size).copy()
                    line = row_length or width * size
                    for y in range(height):
                        out[top + y, left * size : (left + width) * size] = np.frombuffer(raw, np.uint8, width * size, offset + y * line)
                    bits = out.tobytes()
                made.append(bits)
            kept = b.drop_columns(["_raw"])
            yield kept.set_column(kept.schema.get_field_index("bits"), "bits", pa.array(made, pa.binary()))

    return both.mapInArrow(run, frames.select(*[c for c in both.columns if c != "_raw"]).schema)


def write_raw_rect(frames: DataFrame, key: str, left: int, top: int, width: int, height: int, offset: int = 0, row_length: int = 0) -> DataFrame:
    """(key, content): a rectangle of typed frames as headerless rasters."""

    def cut(w: int, h: int, name: str, bits: bytes, palette: bytes | None) -> tuple:
        size = formats.named(name).size
        rows = np.frombuffer(bits, np.uint8).reshape(h, w * size)[top : top + height, left * size : (left + width) * size]
        return width, height, name, rows.tobytes(), palette

    return write_raw_typed(formats.over_frames(frames, cut), key, offset, row_length)
