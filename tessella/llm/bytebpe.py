"""Byte-level BPE: pre-tokenisation by scans of transition functions, cached pair merging, decoding by offsets.

The pre-tokeniser doesn't use a regular expression. Each code point gets a class (letter, number, white space, other),
refined by what follows it (the last white space before a word, an apostrophe that opens a contraction). Over
these classes the pattern of `public_tokenizers.PATTERN` is an automaton with eight states. A character is then a
function from states to states, and functions compose associatively: blocks of characters are composed side by side
for all states at once, the blocks' functions are folded, and a second pass from the known entry states marks where
pieces begin. Pieces go through a bounded cache to the pair merger.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import sub_batches

# classes of characters
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, SHORT, LONG, END = range(9)
# states: what the current piece is
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)

#: The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow the apostrophe of a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

BLOCK = 128


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for every code point, from the Unicode general categories."""
    try:
        import regex

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        found = {LETTER: regex.finditer(r"\p{L}+", every), NUMBER: regex.finditer(r"\p{N}+", every)}
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, runs in found.items():
            for m in runs:
                for c in m.group():
                    table[ord(c)] = kind
    except ImportError:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = WHITE
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by [class, state]."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        step[kind] = inside
        begins[kind, [inside, AFTER_SPACE]] = False
    # the letters of a contraction; what comes after it begins anew
    begins[LETTER, [ONE_MORE, TWO_MORE]] = False
    step[LETTER, ONE_MORE], step[LETTER, TWO_MORE] = FRESH, ONE_MORE
    for kind, left in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        step[kind] = left
        step[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[kind, [IN_OTHER, AFTER_SPACE]] = False
    step[SPACE_LAST], step[WHITE_LAST], step[WHITE], step[END] = AFTER_SPACE, FRESH, IN_WHITE, FRESH
    begins[WHITE, IN_WHITE] = False
    return step, begins


STEP, BEGINS = automaton()


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of code points, with what follows taken into account; `ends`: positions of the marks after each text."""
    kind = class_table()[points]
    kind[ends] = END
    after = np.empty_like(kind)
    after[:-1], after[-1:] = kind[1:], END
    last = (kind == WHITE) & (after != WHITE) & (after != END)
    space = points == 0x20
    kind[last & space], kind[last & ~space] = SPACE_LAST, WHITE_LAST
    quotes = np.flatnonzero((points == 0x27) & (kind == OTHER) & (after == LETTER))
    if quotes.size:
        padded = np.append(points, [0, 0])
        first, second = padded[quotes + 1], padded[quotes + 2]
        for tail in CONTRACTIONS:
            fits = first == ord(tail[0])
            if len(tail) == 2:
                fits &= (second == ord(tail[1])) & (kind[np.minimum(quotes + 2, kind.size - 1)] != END)
            kind[quotes[fits]] = LONG if len(tail) == 2 else SHORT
    return kind


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray]:
    """All functions that the classes' transition functions compose to, as rows of states, and the number of
    `function, then class` by [function * 9 + class]. Function 0 is the identity."""
    functions = [tuple(range(8))]
    number, product = {functions[0]: 0}, []
    for f in functions:  # grows meanwhile
        for kind in range(9):
            g = tuple(int(STEP[kind, s]) for s in f)
            if g not in number:
                number[g] = len(functions)
                functions.append(g)
            product.append(number[g])
    return np.array(functions, np.intp), np.array(product, np.intp) * 9


def piece_starts(kind: np.ndarray) -> np.ndarray:
    """Positions where pieces begin, by composing transition functions over blocks and then replaying each block."""
    n = kind.size
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, END, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    functions, product = monoid()
    reach = np.zeros(blocks, np.intp)
    for column in grid:
        reach = product.take(reach + column)
    entry, state = np.empty(blocks, np.intp), FRESH
    for i, function in enumerate(functions[reach // 9].tolist()):
        entry[i] = state
        state = function[state]
    flat, starts = STEP.T.astype(np.intp).ravel() * 9, BEGINS.T.ravel()
    entry, out = entry * 9, np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(grid):
        at = column + entry
        out[j] = starts.take(at)
        entry = flat.take(at)
    return np.flatnonzero(out.T.ravel()[:n])


def pre_tokenise(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = piece_starts(classes(points, ends))
    cuts, out, lo = starts.tolist(), [], 0
    pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:] + [len(joined)], strict=True)]
    for hi in np.searchsorted(starts, ends).tolist():  # each mark is a piece of its own
        out.append(pieces[lo:hi])
        lo = hi + 1
    return out


class Merger(dict):
    """piece -> its ids, filled by merging the pair of lowest rank again and again.

    Two generations of at most `most` pieces: when the young one is full it becomes the old one, from which
    pieces that come up again are taken over; so frequent pieces stay, whatever the number of rare ones."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.ranks, self.most, self.old = ranks, most, {}
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ids of 20 bits at most are expected")
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.old.get(piece)) is None:
            ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        if len(ids) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, raw: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        return tuple(self.merge(raw) if len(raw) <= 96 else self.merge_long(raw))

    def merge(self, raw: bytes) -> list[int]:
        get, none = self.pairs.get, 1 << 40
        ids = [self.single[b] for b in raw]
        costs = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while costs and (low := min(costs)) < none:
            i = costs.index(low)
            ids[i : i + 2] = [low]
            del costs[i]
            if i:
                costs[i - 1] = get(ids[i - 1] << 20 | low, none)
            if i < len(costs):
                costs[i] = get(low << 20 | ids[i + 1], none)
        return ids

    def merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n for pieces of any length."""
        get, n = self.pairs.get, len(raw)
        ids, after, before = [self.single[b] for b in raw], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(rank << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := get(ids[p] << 20 | rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return [x for x in ids if x >= 0]


class ByteBPE:
    """Encoder and decoder over a file of ranks (`base64 rank` a line)."""

    def __init__(self, ranks: dict[bytes, int], cache: int = 200_000):
        self.merger = Merger(ranks, cache)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        of = self.merger.__getitem__
        return [np.fromiter(chain.from_iterable(map(of, pieces)), np.int32) for pieces in pre_tokenise(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset of each id in the decoded bytes, and their length at the end."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in ids], dtype=np.int64)])


def read_ranks(lines: str | bytes) -> dict[bytes, int]:
    text = lines.encode() if isinstance(lines, str) else lines
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines())}


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    with open(path, "rb") as f:
        return ByteBPE(read_ranks(f.read()))


def encode(docs: DataFrame, ranks: str, text: str = "text", out: str = "ids", batch_bytes: int = 2_000_000) -> DataFrame:
    """docs with the column `out`: the token ids of each whole text (array<int>; a null text counts as empty).

    `ranks`: path of the rank file, the same on every machine (part of an installed package). No shuffle; a worker holds
    `batch_bytes` of text or one longer text, and its cache of pieces. Other columns, nulls, ties and repeated rows pass
    through; a column already called `out` is replaced; an empty table gives an empty one."""
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in sub_batches(batches, text, batch_bytes):
            ids = bpe.encode_arrays([t or "" for t in batch.column(text).to_pylist()])
            sizes = np.concatenate([[0], np.cumsum([x.size for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded", offsets: str | None = None) -> DataFrame:
    """docs with the column `out`: the bytes that the ids stand for (binary; null ids give no bytes).

    offsets: also a column of that name with the byte offset of every id, and the whole length last."""
    kept = docs.drop(*[c for c in (out, offsets) if c])
    more = [T.StructField(out, T.BinaryType())] + ([T.StructField(offsets, T.ArrayType(T.LongType()))] if offsets else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in sub_batches(batches, ids, 1_000_000):
            values = batch.column(ids)
            flat, sizes = values.flatten().to_numpy(), pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes).tolist()
            lists = [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]
            columns = [*batch.columns, pa.array([bpe.decode(x) for x in lists], pa.binary())]
            if offsets:
                columns.append(pa.array([bpe.offsets(x) for x in lists], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for f in more)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more]))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document: its ids' number and digest, and the digest of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, ranks).drop("text"), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
