"""Steps in Arrow batches over DataFrames.

Steps that follow one another directly run in one Python worker, one after the other over each batch: a worker a task, however
many steps a query has. Steps read the columns that they need by name and cut their batches by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def through(frame: DataFrame, run: Step, schema) -> DataFrame:
    """frame.mapInArrow(run, schema), in the worker of the step that made frame if one did."""
    source, steps = frame.__dict__.get("_steps", (frame, ()))
    steps = (*steps, run)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    out = source.mapInArrow(chain, schema)
    out._steps = source, steps
    return out


def narrowed(frame: DataFrame, *names: str) -> DataFrame:
    """frame with these columns alone, where that saves sending others to Python."""
    return frame if "_steps" in frame.__dict__ else frame.select(*names)


def recast(frame: DataFrame, old: str, new: str, kind: str) -> DataFrame:
    """frame whose column `old` is called `new` and is a string or a long; where a step made it, within that step's worker."""
    if "_steps" not in frame.__dict__:
        return frame.withColumn(old, frame[old].cast(kind)).withColumnRenamed(old, new)
    to = {"string": pa.string(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(n).cast(to) if n == old else b.column(n) for n in b.schema.names], names=[new if n == old else n for n in b.schema.names])

    fields = ", ".join(f"`{new if f.name == old else f.name}` {kind if f.name == old else f.dataType.simpleString()}" for f in frame.schema.fields)
    return through(frame, run, fields)


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the binary column has about `most` bytes, or one row more."""
    for batch in batches:
        sizes = np.array([0 if v is None else len(v) for v in batch.column(column).to_pylist()]) if batch.nbytes > most else None
        if sizes is None:
            if batch.num_rows:
                yield batch
            continue
        lo, held = 0, 0
        for k, n in enumerate(sizes.tolist()):
            held += n
            if held >= most or k + 1 == batch.num_rows:
                yield batch.slice(lo, k + 1 - lo)
                lo, held = k + 1, 0


def spread(batches: Iterator[pa.RecordBatch], key: list[str], value: Callable[..., np.ndarray], given: tuple[str, ...], rows: int) -> Iterator[pa.RecordBatch]:
    """A row per pixel with the key's columns, x, y and a, r, g, b: value(*given) are a frame's [n, 4]. `rows` pixels a batch at most;
    frames without bits give none."""
    for batch in parts(batches, "bits", rows * 4):
        good = [k for k, n in enumerate(batch.column("bits").is_valid().to_pylist()) if n]
        if not good:
            continue
        batch = batch.take(pa.array(good))
        made = [value(*r) for r in zip(*(batch.column(c).to_pylist() for c in given))]
        ends, widths = np.cumsum([len(v) for v in made]), batch.column("width").to_numpy().astype(np.int64)
        all_ = made[0] if len(made) == 1 else np.concatenate(made)
        del made
        for lo in range(0, len(all_), rows):
            at = np.arange(lo, min(len(all_), lo + rows))
            which = np.searchsorted(ends, at, "right")
            own = pa.array(which)
            at = at - np.concatenate([[0], ends])[which]
            y, x = np.divmod(at, widths[which])
            v = all_[lo : lo + rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(own) for c in key), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), *(pa.array(np.ascontiguousarray(v[:, c])) for c in range(4))], names=[*key, *"xyargb"]
            )


def codes(column: pa.Array) -> np.ndarray:
    """A number for each value, equal for equal ones."""
    if pa.types.is_struct(column.type):
        out = np.asarray(column.is_valid()).astype(np.int64)
        for child in column.flatten():
            c = codes(child)
            out = np.unique(out * (c.max(initial=0) + 1) + c, return_inverse=True)[1].ravel()
        return out
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def runs(column: pa.Array) -> tuple[np.ndarray | None, np.ndarray]:
    """(order or None, bounds): the rows in this order have equal values between one bound and the next."""
    c, order = codes(column), None
    if (np.diff(c) < 0).any():
        order = np.argsort(c, kind="stable")
        c = c[order]
    return order, np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])


#: Pieces of at least so many pixels are compressed.
LARGE = 128


def pack(columns: list[np.ndarray]) -> bytes:
    """The columns one after the other, compressed if they are many rows."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return pa.Codec("zstd", 1).compress(raw, asbytes=True) if len(columns[0]) >= LARGE else raw


def unpack(n: int, raw: bytes, kinds: list) -> list[np.ndarray]:
    kinds, at, out = [np.dtype(k) for k in kinds], 0, []
    if n >= LARGE:
        raw = pa.Codec("zstd", 1).decompress(raw, decompressed_size=n * sum(k.itemsize for k in kinds), asbytes=True)
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


#: What pixels and places are packed as before they are shuffled.
PLACE = dict.fromkeys("xy", np.int32)
PIXEL = PLACE | dict.fromkeys("argb", np.uint8)
#: A pixel in two numbers, as each value that is sent to Python costs much more than putting them together.
TWO = {"_xy": "shiftleft(cast(y as bigint), 32) | (cast(x as bigint) & 4294967295)", "_argb": "shiftleft(cast(a as int) & 255, 24) | shiftleft(cast(r as int) & 255, 16) | shiftleft(cast(g as int) & 255, 8) | (cast(b as int) & 255)"}


def pieces(frame: DataFrame, key: str, columns: dict) -> DataFrame:
    """(key, _pieces): the rows of each key, packed before they are shuffled; columns: PIXEL or PLACE. A key's rows are one row and
    so one task's."""

    def values(batch: pa.RecordBatch) -> list[np.ndarray]:
        if "_xy" not in batch.schema.names:
            return [batch.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in columns.items()]
        out = list(batch.column("_xy").to_numpy(zero_copy_only=False).view(np.int32).reshape(-1, 2).T)
        return out if columns is PLACE else [*out, *batch.column("_argb").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 4).T[::-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, bounds = runs(batch.column(key))
            found = values(batch)
            if order is not None:
                found = [v[order] for v in found]
            n = np.diff(bounds)
            made = [pack([v[lo:hi] for v in found]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            first = bounds[:-1] if order is None else order[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(first)), pa.array(n.astype(np.int32)), pa.array(made, pa.binary())], names=[key, "n", "raw"])

    kind = frame.schema[key].dataType.simpleString()
    if "_steps" not in frame.__dict__:
        frame = frame.select(key, *(F.coalesce(F.expr(e), F.lit(0)).alias(n) for n, e in TWO.items() if n == "_xy" or columns is not PLACE))
    small = through(frame, run, f"`{key}` {kind}, n int, raw binary")
    # a number of its own, as partitions so small would be put together, and the work on them with them
    small = small.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return small.groupBy(key).agg(F.collect_list(F.struct("n", "raw")).alias("_pieces"))


def joined(found: list[dict], columns: dict) -> list[np.ndarray]:
    """The columns of a row's pieces, put together."""
    every = [unpack(p["n"], p["raw"], list(columns.values())) for p in found]
    return every[0] if len(every) == 1 else [np.concatenate(c) for c in zip(*every)]


def gathered(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of about `most` bytes, or one row more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
