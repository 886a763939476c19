"""MinHash near-dedup with DartMinHash signatures, banded joining and an exact check.

Each element of a weighted set (a word shingle) owns a strip of the plane of weights and ranks. Darts fall on the plane
as a Poisson process that depends on the element alone: the plane is cut into fixed cells, and an element's
hash says how many darts each cell has and where. A document owns the darts below its elements' weights. Every dart
belongs to one coordinate; the signature keeps the earliest dart of each. Two documents agree in a coordinate with
the probability of their weighted Jaccard similarity. Cells are taken by rising rank until all coordinates are filled, so
a long document needs only the first cells and a short one more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import BASE, hashes_of, joined_bytes, materialise, mix, sub_batches, words_of
from tessella.llm.components import components

#: Production parameters: words in a shingle, least similarity, bands and rows in a band. A pair at 0.8 meets in no band
#: with probability (1 - 0.8^5)^24 = 7e-5.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 24, 5


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's number, count) of the distinct shingles, by text and hash.

    Words are what stands between ASCII white space. A text of fewer words than a shingle has, but one at least, has one
    shingle of all of them; one without words has none."""
    buffer, offsets = joined_bytes(texts)
    starts, ends = words_of(buffer)
    word = hashes_of(buffer, starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    per_text = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(per_text)])
    m = max(0, word.size - words + 1)
    code = np.zeros(m, np.uint64)
    for k in range(words):
        code = code * BASE + word[k : k + m]
    inside = text[:m] == text[words - 1 :] if m else np.zeros(0, bool)
    code, owner = mix(code[inside]), text[:m][inside]
    short = np.flatnonzero((per_text > 0) & (per_text < words))
    if short.size:
        extra = np.zeros(short.size, np.uint64)
        for k in range(words - 1):
            there = per_text[short] > k
            extra[there] = extra[there] * BASE + word[first[short[there]] + k]
        code, owner = np.concatenate([code, mix(extra + np.uint64(1))]), np.concatenate([owner, short])
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(code.size, bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return code[at], owner[at], np.diff(np.append(at, code.size))


@lru_cache(maxsize=512)
def chances(area: float) -> np.ndarray:
    """Chances of at most 0, 1, 2 ... darts on an area, until they are 1 in double precision."""
    p, total, out, n = math.exp(-area), 0.0, [], 0
    while total < 1 - 1e-16 and n < 400:
        total += p
        out.append(min(total, 1.0))
        n += 1
        p *= area / n
    return np.array(out)


def rank_cells() -> Iterator[tuple[float, float]]:
    """The cuts of the axis of ranks: halves from 1/16 up, from 8 on steps of 8."""
    lo, hi = 0.0, 1 / 16
    while True:
        yield lo, hi
        lo, hi = hi, hi * 2 if hi < 8 else hi + 8


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(element: np.ndarray, weight: np.ndarray, cell: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the element, hash, rank) of the darts with a rank in [low, high) below each element's weight."""
    found = []
    bottom, top, level = 0.0, 1.0, 0
    while True:  # the axis of weights: [0, 1), [1, 2), [2, 4) ...
        here = np.flatnonzero(weight > bottom)
        if not here.size:
            break
        chance = chances((top - bottom) * (high - low))
        with np.errstate(over="ignore"):
            seed = mix(element[here] + np.uint64((cell * 64 + level) * 2 + 1) * np.uint64(0xD1342543DE82EF95))
        u = unit(seed)
        some = np.flatnonzero(u >= chance[0])
        number = np.searchsorted(chance, u[some], "right")
        which, size = here[some], number.sum()
        each = np.arange(size) - np.repeat(np.cumsum(number) - number, number)
        owner = np.repeat(which, number)
        dart = mix(np.repeat(seed[some], number) + (each.astype(np.uint64) + np.uint64(1)) * BASE)
        rank = low + (high - low) * unit(mix(dart + np.uint64(1)))
        height = bottom + (top - bottom) * unit(mix(dart + np.uint64(2)))
        below = height < weight[owner]
        found.append((owner[below], dart[below], rank[below]) if not below.all() else (owner, dart, rank))
        bottom, top, level = top, top * 2, level + 1
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """[texts, size] hashes of the earliest darts; rows of texts without elements are 0."""
    out = np.zeros(texts * size, np.uint64)
    filled = np.ones(texts * size, bool).reshape(texts, size)
    filled[np.unique(owner)] = False
    filled = filled.ravel()
    weight = weight.astype(np.float64)
    for cell, (low, high) in enumerate(rank_cells()):
        if not element.size:
            return out.reshape(texts, size)
        of, dart, rank = darts(element, weight, cell, low, high)
        slot = owner[of] * size + (dart >> np.uint64(32)).astype(np.int64) % size
        free = ~filled[slot]
        slot, dart, rank = slot[free], dart[free], rank[free]
        order = np.argsort(-rank, kind="stable")
        out[slot[order]] = dart[order]  # the earliest is written last
        filled[slot] = True
        left = ~filled.reshape(texts, size).all(1)
        keep = left[owner]
        if not keep.all():
            element, owner, weight = element[keep], owner[keep], weight[keep]


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[texts, bands]: a hash of each band's coordinates and its number."""
    parts = signature.reshape(len(signature), bands, rows)
    code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        code = code * BASE + parts[:, :, k]
    return mix(code)


def sketch(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS, weights: str = "set", batch_bytes: int = 1_000_000) -> DataFrame:
    """docs without the text, with _size (distinct shingles) and _bands (array<long>; empty without words).

    weights: "set" gives every distinct shingle the weight 1, so that signatures follow the Jaccard similarity of
    shingle sets, which LEAST is about; "count" the number of times it occurs."""
    kept = T.StructType([f for f in docs.schema.fields if f.name != text])
    schema = T.StructType([*kept.fields, T.StructField("_size", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text, batch_bytes):
            n = batch.num_rows
            code, owner, count = shingles(batch.column(text).to_pylist(), words)
            signature = signatures(code, owner, count if weights == "count" else np.ones(count.size), n, bands * rows)
            size = np.bincount(owner, minlength=n)
            hashes = band_hashes(signature, bands, rows)[size > 0].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept.fields), pa.array(size, pa.int64()), lists], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def sets_of(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(_key, _set): the sorted distinct shingle hashes of each text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "_text", 1_000_000):
            code, owner, _ = shingles(batch.column("_text").to_pylist(), words)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = [code[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found, pa.binary())], names=["_key", "_set"])

    return texts.mapInArrow(run, "_key binary, _set binary")


#: Pairs of one text that meet its shingle set in a task; a text with more partners has its set copied.
PARTNERS = 10_000


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of text keys whose shingle sets have a Jaccard similarity of at least `least`, exactly.

    pairs: (a, b, n), n the number of partners that a may have. sets: (_key, _set). A pair's sets meet in the row of the pair, and
    the pairs of a text with very many partners are dealt into parts of PARTNERS, each with a copy of its set."""
    second = sets.select(F.col("_key").alias("b"), F.col("_set").alias("set_b"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PARTNERS)).cast("int").alias("part"))
    first = dealt.select("a", "part").distinct().join(sets.select(F.col("_key").alias("a"), F.col("_set").alias("set_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.intersect1d(p, q, assume_unique=True).size
                keep.append(both >= least * (p.size + q.size - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.join(first, ["a", "part"]).join(second, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def block_links(keys: list[bytes], roots: list[bytes], asks: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[bytes, bytes]]:
    """Links between rows that ask and rows that don't, of different classes: enough of them to connect all classes that such
    links connect. For each row that asks, the postings of its shingles count what it shares with every other row."""
    sizes = np.array([x.size for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    other = np.flatnonzero(~asks[owner])  # postings are of the rows that are asked
    order = other[np.argsort(column[other], kind="stable")]
    posted, bounds = owner[order], np.searchsorted(column[order], np.arange(values.size + 1))
    starts = np.cumsum(sizes) - sizes
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    label, found = np.array([names[r] for r in roots]), []
    for i in np.flatnonzero(asks).tolist():
        own = column[starts[i] : starts[i] + sizes[i]]
        length = bounds[own + 1] - bounds[own]
        at = np.repeat(bounds[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        shared = np.bincount(posted[at], minlength=len(sets))
        linked = ~asks & (shared >= least * (sizes + sizes[i] - shared)) & (label != label[i])
        for j in np.flatnonzero(linked).tolist():
            if label[i] != label[j]:
                found.append((keys[i], keys[j]))
                label[label == label[j]] = label[i]
    return found


#: Shingles in a block of a bucket, on average.
BLOCK = 1_000_000


def open_links(member: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts of a bucket that aren't in one class, one of them outside its largest class.

    member: (band, _key, _size, root). All texts of a bucket are dealt by hash into blocks of about BLOCK shingles, and those
    outside its largest class into blocks that ask. Each pair of an asking block and a block is compared in a task
    of its own that gives back links only, no pairs. So a large class with few texts beside it is copied once."""
    counted = member.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("_size").alias("s"))
    top = F.max(F.struct("n", "root", "s")).alias("top")
    largest = counted.groupBy("band").agg(top, F.count("*").alias("classes"), F.sum("s").alias("s")).where("classes > 1")
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    largest = largest.select("band", F.col("top.root").alias("top"), blocks(F.col("s")).alias("blocks"), blocks(F.col("s") - F.col("top.s")).alias("asking"))
    mixed = member.join(largest, "band").withColumn("hash", F.xxhash64("_key"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.col("hash"), F.col(n)).cast("int")
    asks = mixed.where("root != top").select("band", of("asking").alias("i"), every("blocks").alias("j"), "_key", "root", F.lit(True).alias("asks"))
    asked = mixed.select("band", every("asking").alias("i"), of("blocks").alias("j"), "_key", "root", F.lit(False).alias("asks"))
    dealt = asks.unionByName(asked).join(sets, "_key")

    def run(table: pa.Table) -> pa.Table:
        lists = (table.column(c).to_pylist() for c in ("_key", "root"))
        found = block_links(*lists, table.column("asks").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("_set").to_pylist()], least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return dealt.groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(documents: DataFrame, **how) -> DataFrame:
    """(doc_id, _key, class_id) for every row, as `judged` finds them."""
    return judged(documents, **how).drop("_best", "n_links")


def judged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, weights: str = "set") -> DataFrame:
    """(doc_id, _key, class_id, _best, n_links) for every row: class_id is the smallest doc_id of all texts that
    links connect; _best: the row has that id, and of the class's texts with it the one with the smallest key; n_links:
    verified links of its text to different texts, of which as many are found as connect the class.

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least `least`. Equal texts share
    a key (the MD5 of the text) and are one node. In each band bucket all texts are first compared with the one that
    comes first; these links give classes, and then texts of a bucket are compared if they aren't in one class already
    and one of them is outside the bucket's largest class. So a bucket with thousands of copies costs one comparison each,
    and no link that a full comparison of the bucket would find between classes is missed. Null texts count as
    empty; texts without words are linked to equal texts only; null ids take part (a class of null ids has the id null);
    rows may repeat; an empty table gives an empty one."""
    docs = documents.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_key", F.unhex(F.md5(F.col("_text").cast("binary"))))
    sketches = materialise(sketch(docs, "_text", bands, rows, words, weights), "sketches")
    texts = materialise(sketches.groupBy("_key").agg(F.min("_id").alias("_first")), "texts", small=True)
    # one row of each text stands for it; of repeated rows, any
    reps = sketches.withColumnRenamed("_key", "_k").join(texts, (F.col("_k") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_key"])
    entries = reps.select("_key", "_size", F.explode("_bands").alias("band"))
    centres = entries.groupBy("band").agg(F.min(F.struct("_key", "_size")).alias("c"), F.count("*").alias("n")).where("n > 1").select("band", "c", "n")
    shared = materialise(entries.join(centres, "band"), "buckets")
    # the shingle sets of all texts that share a bucket; the plan is the same at every size
    wanted = shared.select(F.col("_key").alias("_k")).distinct().join(texts.withColumnRenamed("_key", "_k"), "_k")
    found = docs.join(wanted.hint("merge"), (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
    sets = materialise(sets_of(found, words).dropDuplicates(["_key"]), "sets")
    stars = shared.where(f"_key != c._key and least(_size, c._size) >= {least} * greatest(_size, c._size)")
    pairs = stars.groupBy(F.col("c._key").alias("a"), F.col("_key").alias("b")).agg(F.sum("n").alias("n"))
    links = materialise(similar(pairs, sets, least), "links", small=True)
    classes = components(links)
    # what the stars leave open
    member = shared.join(classes.withColumnRenamed("node", "_key"), "_key", "left").select("band", "_key", "_size", F.coalesce("root", "_key").alias("root"))
    more = materialise(open_links(materialise(member, "members"), sets, least), "links", small=True)
    if not more.isEmpty():
        links = links.union(more)
        classes = components(links)
    named = texts.join(classes.withColumnRenamed("node", "_key"), "_key", "left").select("_key", "_first", F.coalesce("root", "_key").alias("root"))
    named = materialise(named, "named", small=True)
    smallest = named.groupBy("root").agg(F.min(F.struct(F.col("_first").isNull(), "_first", F.col("_key").alias("k"))).alias("c"))
    by_text = named.join(smallest, "root").select("_key", F.col("c._first").alias("class_id"), (F.col("_key") == F.col("c.k")).alias("_best"))
    degrees = links.select("a", "b").union(links.select("b", "a")).distinct().groupBy(F.col("a").alias("_key")).agg(F.count("*").alias("n_links"))
    by_text = by_text.join(degrees, "_key", "left")
    best = F.col("_best") & F.col("_id").eqNullSafe(F.col("class_id"))
    n_links = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    return sketches.select("_id", "_key").join(by_text, "_key").select(F.col("_id").alias(doc_id), "_key", "class_id", best.alias("_best"), n_links)


def one_of_each(documents: DataFrame, **how) -> DataFrame:
    """documents without near duplicates: of each class one document, all its columns, whatever their names: that with the
    smallest doc_id (null last), of different texts with it the one with the smallest key, of rows that repeat with id and text any."""
    kept = judged(documents, **how).where("_best").select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")).distinct()
    keyed = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_key"))
    return keyed.join(kept, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi").dropDuplicates(["_id", "_key"]).select("_row.*")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class, whether it stays, and its verified links."""
    classes = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", "class_id", F.col("_best").alias("kept"), "n_links")
