"""Helpers that the corpus operators share: the cluster's shared folder, written tables, hashes of ids, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word in the word-based operators: space, tab, LF, VT, FF, CR.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, or what setCheckpointDir was given.

    Where neither is set, a local session (tests) gets a folder of its own; on a cluster that is an error, as a folder of
    one machine isn't shared."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(base)  # a path without a scheme lies on the default file system
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/tessella-{tag}-{uuid.uuid4().hex}"


#: Folders that this process wrote, in order.
_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession, also: str | None = None) -> Iterator[None]:
    """What `materialise` writes within the block is deleted at its end, but for the table written last; `also`: a folder that isn't
    needed any more either. If the block fails everything stays."""
    before, sc = len(_written), spark.sparkContext
    yield
    gone = [*_written[before:-1], *([also] if also else [])]
    for folder in gone:
        if folder in _written:
            _written.remove(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def last_written() -> str | None:
    return _written[-1] if _written else None


def materialise(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    small: for rows of a few numbers; written by no more than two tasks a core, as every file costs more than its rows."""
    path = new_folder(df.sparkSession, tag)
    if small:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text (remainder 0: held out)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return id_crc(doc_id) % folds == 0


#: DuckDB SQL of a table `folded` (s, code): the crc32 of every document's id as text, a null id being empty text.
FOLDED_SQL = """recursive crc(k, i, c) as (
  select k, 0, k from range(256) t(k)
  union all select k, i + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where i < 8),
crc_table as (select list(c order by k) as t from crc where i = 8),
ids as (select distinct coalesce(cast(doc_id as varchar), '') as s from documents),
folded as (
  select s, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: cast(ascii(s[i]) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as code from ids, crc_table)"""
HELD_OUT_SQL = f"with {FOLDED_SQL} select doc_id, code % 5 = 0 as held_out from documents join folded on s = coalesce(cast(doc_id as varchar), '')"


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df is called so."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about max_bytes (of a list, elements) of `column` or a single row; bounds a worker's memory."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(np.asarray(sizes).tolist()):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> list[tuple[str, int]]:
    """(text, label) pairs of at most `rows` ids for fitting, from labelled documents outside the held-out fold.

    The ids are those with the smallest hashes, so the choice doesn't depend on partitioning. Null ids and labels
    are left out; an id labelled more than once counts with its largest label, one that several rows have with the
    smallest and the largest of their texts; a null text is an empty one. So the driver gets 2 `rows` whole texts at most."""
    picked = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id, folds))
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    found = documents.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))  # `rows` ids at most
    two_each = found.groupBy("_id", "_label").agg(F.min("_text").alias("low"), F.max("_text").alias("high"), F.count("*").alias("n"))
    two_each = two_each.withColumn("high", F.when(F.col("n") > 1, F.col("high")))
    return [(t, int(r["_label"])) for r in sorted(two_each.collect(), key=lambda r: r["_id"]) for t in (r["low"], r["high"])[: r["n"]]]


# Vectorised words and hashes over the bytes of many texts.

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection of uint64 whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each word of a uint8 array."""
    inside = np.zeros(buffer.size + 2, np.int8)
    inside[1:-1] = ~SPACES[buffer]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hashes_of(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of any length, by differences of running sums of a polynomial modulo 2^64."""
    if _powers[0].size <= buffer.size:
        n = 1 << int(buffer.size).bit_length()
        for k, base in ((0, BASE), (1, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
    sums = np.zeros(buffer.size + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers[0][: buffer.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each followed by a space; offsets of the texts, and the whole length last)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), offsets
