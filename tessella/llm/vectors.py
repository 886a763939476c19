"""Embedding near-dedup by an exact metric range join.

Cosine similarity of at least s is Euclidean distance of at most e = sqrt(2 - 2 s) between unit vectors. Pivots of each label,
fitted on a bounded sample, partition the vectors: each belongs to the cell of its nearest pivot. If u of cell i and v
of cell j are within e, the triangle inequality gives d(v, p_i) - d(v, p_j) <= 2 e; in Euclidean space v even lies within e
of the plane halfway between the pivots, which is the sharper test for the cells that get a copy of v. So each cell has
all partners of its own vectors, and cells are joined independently, a large one in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import materialise
from tessella.llm.components import components

#: Production parameters. CELL is the number of vectors for which a label gets a pivot more, up to PIVOTS in all (of 64 dimensions,
#: 8 MB to broadcast, and 30 million vectors; beyond it cells grow). Pivots are fitted on SAMPLE vectors, or EACH for every
#: pivot; BLOCK is the vectors of a block. Cells are never capped: larger ones have more blocks.
LEAST, SAMPLE, EACH, PIVOTS, CELL, BLOCK, ROUNDS = 0.93, 4096, 8, 16_384, 2000, 2000, 5
#: Distances to pivots that are held at a time.
HELD = 2_000_000


def units(vectors: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(v, np.float32) for v in vectors], np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, key, vector) of (vec_id, embedding, label): key and vector are null if the vector links with
    nothing: it or its label is null, a component is null or not finite, or all are 0 (or there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for x, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                key = raw = None
                if x and label is not None and None not in x:
                    v = np.array(x, np.float32) + np.float32(0)  # no negative zeros
                    if np.isfinite(v).all() and v.any():
                        raw = v.tobytes()
                        key = hashlib.blake2b(f"{label}:".encode() + raw, digest_size=16).digest()
                keys.append(key), vectors.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "key", "vector"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, key binary, vector binary")


def pivots(kinds: DataFrame, sample: int = SAMPLE, most: int = PIVOTS, cell: int = CELL) -> dict[tuple, np.ndarray]:
    """(label, dimension) -> unit pivots [k, dimension], for those labels of the sample that hold more than `cell` vectors.

    k grows with the label's share of all vectors; a few rounds of spherical k-means on the sample even the cells out."""
    n = kinds.count()
    sample = max(sample, EACH * min(most, n // cell))
    picked = kinds.orderBy(F.xxhash64("key"), "key").limit(sample).select("label", "key", "vector").collect()
    by: dict[tuple, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: r.key):
        by.setdefault((r.label, len(r.vector) // 4), []).append(bytes(r.vector))
    out = {}
    for name, vectors in by.items():
        share = len(vectors) / len(picked)
        k = min(len(vectors), int(np.ceil(n * share / cell)), max(1, int(most * share)))
        if k < 2:
            continue
        x = units(vectors)
        p = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(ROUNDS):
            home = np.concatenate([(x[at : at + 2048] @ p.T).argmax(1) for at in range(0, len(x), 2048)])
            sums = np.zeros_like(p)
            np.add.at(sums, home, x)
            norm = np.linalg.norm(sums, axis=1)
            p[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
        out[name] = np.unique(p, axis=0)
    return out


def portions(names: list[tuple], centres: dict[tuple, np.ndarray]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(name, rows with it), so few rows at a time that their distances to the pivots are HELD at most."""
    rows: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        rows.setdefault(name, []).append(i)
    for name, at in rows.items():
        step = max(1, HELD // len(centres[name])) if name in centres else len(at)
        for k in range(0, len(at), step):
            yield name, np.array(at[k : k + step])


def placed(kinds: DataFrame, centres: dict[tuple, np.ndarray], least: float) -> DataFrame:
    """(key, n, vector, cell, own): each vector in its own cell, and a copy in every cell where it may have a partner."""
    sent = kinds.sparkSession.sparkContext.broadcast(centres)  # PIVOTS vectors at most
    radius = float(np.sqrt(2 - 2 * least)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, raw = batch.column("label").to_pylist(), batch.column("vector").to_pylist()
            names = [(label, len(v) // 4) for label, v in zip(labels, raw)]
            rows, cells, own = [], [], []
            for name, at in portions(names, sent.value):
                p = sent.value.get(name)
                if p is None:
                    which, cell, home = at, np.zeros(at.size, int), np.ones(at.size, bool)
                else:
                    x = units([raw[i] for i in at])
                    size = np.einsum("ij,ij->i", p, p)
                    d2 = 2 - 2 * (x @ p.T) + (size - 1)
                    nearest = d2.argmin(1)
                    apart = np.sqrt(np.maximum(0, size + size[nearest, None] - 2 * (p[nearest] @ p.T)))
                    near = d2 - d2.min(1, keepdims=True) <= 2 * radius * apart + 1e-12
                    near[np.arange(at.size), nearest] = True
                    i, cell = np.nonzero(near)
                    which, home = at[i], cell == nearest[i]
                rows.append(which), own.append(home)
                cells += [f"{name[0]}/{name[1]}/{c}" for c in cell]
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("key", "n", "vector")), pa.array(cells, pa.string()), pa.array(np.concatenate(own))], names=["key", "n", "vector", "cell", "own"])

    return kinds.select("key", "label", "n", "vector").mapInArrow(run, "key binary, n long, vector binary, cell string, own boolean")


def joined(cells: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n): for each own vector of a cell and block of partners, b null and n the rows linked; and links (a, b)
    that connect what the links of two blocks connect, n null."""
    parts = lambda n: F.ceil(n / block).cast("int")
    sizes = cells.groupBy("cell").agg(parts(F.count("*")).alias("parts"), parts(F.count(F.when(F.col("own"), 1))).alias("own_parts")).where("own_parts > 0")
    dealt = cells.join(sizes, "cell").withColumn("hash", F.xxhash64("key"))
    # part i of the cell's own vectors meets part j of all its vectors
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.col("hash"), F.col(n)).cast("int")
    left = dealt.where("own").select("cell", of("own_parts").alias("i"), every("parts").alias("j"), "key", "n", "vector", F.lit(True).alias("left"))
    right = dealt.select("cell", every("own_parts").alias("i"), of("parts").alias("j"), "key", "n", "vector", F.lit(False).alias("left"))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy()
        keys, n = table.column("key").to_pylist(), table.column("n").to_numpy()
        own, all_ = np.flatnonzero(side), np.flatnonzero(~side)
        a, b, counts = [], [], []
        if own.size and all_.size:
            x = units(table.column("vector").to_pylist())
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            node = np.array([number[k] for k in keys])
            names, label = list(number), np.arange(len(number))
            mine, theirs = node[own], node[all_]
            for lo in range(0, own.size, 500):
                linked = x[own[lo : lo + 500]] @ x[all_].T >= least
                linked &= mine[lo : lo + 500, None] != theirs[None]
                total = linked @ n[all_]
                for i in np.flatnonzero(total).tolist():
                    a.append(names[mine[lo + i]]), b.append(None), counts.append(int(total[i]))
                    others = theirs[linked[i]]
                    far, first = np.unique(label[others], return_index=True)
                    for j in first[far != label[mine[lo + i]]].tolist():
                        a.append(names[mine[lo + i]]), b.append(names[others[j]]), counts.append(None)
                    if (far != label[mine[lo + i]]).any():
                        label[np.isin(label, far)] = label[mine[lo + i]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(counts, pa.int64())})

    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(run, "a binary, b binary, n long")


def near_vectors(rows: DataFrame, least: float = LEAST, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, label, n_links, component_id for each row of (vec_id, embedding, label).

    Rows are linked if their labels are equal and their cosine, in double precision, is at least `least`. Equal vectors of a
    label are one node with a number of rows, so copies are counted, not compared. What can't link (see prepared) has
    no links and is its own component, as are vectors of other dimensions to each other. Rows with equal ids are rows of
    their own; a null id takes part, and is its component's id only if there is no other. An empty table gives an
    empty one; further columns are left out."""
    table = materialise(prepared(rows), "vectors")
    # the vector follows from the key, so any of a key's rows will do
    kinds = materialise(table.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("vector").alias("vector")), "kinds")
    centres = pivots(kinds, sample, cell=cell)
    found = materialise(joined(materialise(placed(kinds, centres, least), "cells"), least, block), "links", small=True)
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    known = kinds.select("key", "first", "n").join(counts, "key", "left").join(roots, "key", "left")
    known = materialise(known.select("key", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")), "known", small=True)
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    by_key = known.join(smallest, "root").select("key", "n_links", "component_id")
    linked = table.where("key is not null").join(by_key, "key").select("vec_id", "label", "n_links", "component_id")
    return linked.unionByName(table.where("key is null").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every vector."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = """
with recursive ok as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n from links group by a),
c as (select a, min(b) as b from reach group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
"""
