"""Best-fit-decreasing packing of token pieces into sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bytebpe
from tessella.llm._shared import materialise, sub_batches

CAPACITY = 2048


class BestFit:
    """Open bins by remaining capacity: leaf c of a segment tree has the bins with c left, each inner node the
    number of bins below it. The tightest bin for a piece is the leftmost filled leaf from the piece's length on."""

    def __init__(self, capacity: int):
        self.capacity, self.half = capacity, 1 << capacity.bit_length()
        self.count = [0] * (2 * self.half)
        self.bins: list[list[int]] = [[] for _ in range(self.half)]
        self.made = 0

    def add(self, left: int, step: int) -> None:
        node = self.half + left
        while node:
            self.count[node] += step
            node >>= 1

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least `length` that some bin has; -1: none."""
        count, node = self.count, self.half + length
        if count[node]:
            return length
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.half:
                    node *= 2
                    if not count[node]:
                        node += 1
                return node - self.half
            node >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1 to `capacity` tokens."""
        if (left := self.tightest(length)) < 0:
            number, left = self.made, self.capacity
            self.made += 1
        else:
            number = self.bins[left].pop()
            self.add(left, -1)
        if left > length:
            self.bins[left - length].append(number)
            self.add(left - length, 1)
        return number, self.capacity - left


@lru_cache(maxsize=2)
def load(path: str):
    """(library encoder, our encoder) for a byte-level BPE file of the tokenizers library, without its special tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # byte-level files write each byte as a printable character: printable Latin-1 as itself, the others from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token != "<|endoftext|>"}
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bytebpe.ByteBPE(ranks, 100_000)


#: Runs that the library's pattern or merging is slow for; such texts go through bytebpe, which takes n log n.
LONG_RUN = re.compile(r"\s{400}|\S{4000}")


def cut(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 2_000_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit).

    A document is its ids, special tokens' strings being ordinary text, and `end`; one of more than `capacity`
    ids is cut so that only its first piece is shorter. A null text counts as empty and gives one piece, [end]; ids of
    documents may be null or repeat; other columns are left out. No shuffle."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, own = load(tokenizer)
        for batch in sub_batches(batches, "text", batch_bytes):
            row, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                t = t or ""
                found = own.encode([t])[0] if LONG_RUN.search(t) else library.encode_to_numpy(t, disallowed_special=())
                whole = np.append(np.asarray(found, "<u4"), np.uint32(end)).astype("<u4")
                at, n, k = 0, whole.size, 0
                while at < n:
                    upto = at + ((n - at) % capacity or capacity)
                    row.append(i), piece.append(k), start.append(at), length.append(upto - at), ids.append(whole[at:upto].tobytes())
                    at, k = upto, k + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", shard_rows: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset, packed by best fit decreasing.

    The pieces are dealt evenly (round robin, so no key can be hot) to shards of about `shard_rows`; the number of
    shards grows with the table, and each adds at most a few sequences that aren't full. Lengths must be 1 to
    `capacity`. Repeated pieces are packed each; columns called sequence_id or offset are replaced; other columns pass
    through; an empty table gives an empty one. The pieces are written to the shared folder once, to be counted."""
    kept = materialise(pieces.drop("sequence_id", "offset"), "pieces")
    shards = max(1, -(-kept.count() // shard_rows))
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in frames if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        lengths = table.column(length).to_numpy()
        bins, first = BestFit(capacity), TaskContext.get().partitionId() << 40
        number, offset = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            number[i], offset[i] = bins.place(int(lengths[i]))
        out = table.append_column("sequence_id", pa.array(first + number)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    return kept.repartition(shards).mapInArrow(run, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every piece of every document."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
