"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, then softmax.

The vectors and the output layer are fitted by stochastic gradient descent in numpy on a bounded sample of labelled
documents. As averaging and the output layer are linear, each bucket's share of the margin between the classes is a
number; scoring hashes the n-grams of many texts at once and adds up their numbers per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import hashes_of, held_out, labelled_sample, sub_batches, words_of

#: Production parameters. ROWS bounds the labelled documents that are fitted on.
ROWS, BUCKETS, WIDTH, GRAMS, EPOCHS, RATE, SEED = 4000, 1 << 17, 16, (3, 4), 5, 0.5, 7
THRESHOLD = 0.3


def n_grams(texts: list[str | None], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature (buckets, text after text; number of features before each text, and in all).

    Features of a word: itself and the n-grams of its bytes with a space on either side. A word that equals the one
    before it, whatever it is, adds one more feature. White space between words counts as one space."""
    squeezed = [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in squeezed], dtype=np.int64)])
    buffer = np.frombuffer(b" " + b" ".join(squeezed) + b" ", np.uint8)
    inside, kinds = buffer != 0x20, []
    code, size = buffer.astype(np.uint32), buffer.size
    whole = np.ones(size, bool)
    for n in range(2, max(GRAMS) + 1):  # code: the last four bytes from each place on; whole: no space within
        m = max(0, size - n + 1)
        code = code[:m] << np.uint32(8) | buffer[n - 1 :]
        if n > 2:
            whole = whole[:m] & inside[n - 2 : n - 2 + m]
        if n in GRAMS:
            first = np.flatnonzero(whole[:m])
            kinds.append((first, ((code[first] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(8)))
    starts, ends = words_of(buffer)
    hashes = hashes_of(buffer, starts, ends)
    text = np.searchsorted(offsets, starts, "left")  # a text begins at the byte after its offset
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) + 1
    kinds += [(starts, hashes >> np.uint64(40)), (starts[same], np.full(same.size, REPEATED))]
    # every feature begins at a word's first byte or the space before it, so those of a text lie from its offset on
    return [((found % buckets).astype(np.int64), np.searchsorted(at, offsets)) for at, found in kinds]


#: The feature of words that repeat the one before them.
REPEATED = 1


def shares(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their share of the text's features); a text without words has none."""
    ids, counts = np.unique(np.concatenate([found for found, _ in n_grams([text], buckets)]), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


class Model:
    """vectors [buckets, width], output [2, width] and bias [2]; folded: the margin of class 1 over class 0 by bucket."""

    def __init__(self, buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
        self.output, self.bias, self.buckets = np.zeros((2, width), np.float32), np.zeros(2, np.float32), buckets

    def fit(self, rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
        """Without rows, or with one class only, the bias alone says what there was (0.5 without rows)."""
        if not rows:
            return self
        y = np.array([int(label > 0) for _, label in rows])
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias[:] = np.log([1 - share, share])
        docs = [shares(text, self.buckets) for text, _ in rows]
        rng, step, steps = np.random.default_rng(seed), 0, epochs * len(docs)
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                ids, share = docs[i]
                rate_now, step = rate * (1 - step / steps), step + 1
                taken = self.vectors[ids]
                hidden = share @ taken if ids.size else np.zeros(self.vectors.shape[1], np.float32)
                z = self.output @ hidden + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = self.output.T @ p
                self.output -= rate_now * np.outer(p, hidden)
                self.bias -= rate_now * 0.1 * p
                # as usual for averaged vectors, each feature gets the whole step, scaled here by its weight against the mean
                self.vectors[ids] = taken - rate_now * np.outer(np.minimum(1, share * ids.size), back)
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def probabilities(texts: list[str | None], margins: np.ndarray, bias: float) -> np.ndarray:
    total, size = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, before in n_grams(texts, margins.size):
        total += np.diff(np.concatenate([[0.0], np.cumsum(margins[ids])])[before])
        size += np.diff(before)
    z = total / np.maximum(1, size) + bias
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, margins: np.ndarray, bias: float, text: str = "text", out: str = "score", batch_bytes: int = 1_000_000) -> DataFrame:
    """docs with the column `out`: the probability that a document is of good quality, over its whole text.

    A null or empty text, or one of white space, gets what the bias says. No shuffle; the model (1 MB) is sent once to each
    executor. Other columns pass through; a column already called `out` is replaced."""
    kept = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast((margins, bias))
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text, batch_bytes):
            scores = probabilities(batch.column(text).to_pylist(), *sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[np.ndarray, float]:
    """Fitted on at most `rows` labelled documents that aren't held out."""
    return Model().fit(labelled_sample(documents, labels, "quality", rows)).folded()


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(documents.select("doc_id", "text"), *fit(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_quality_classifier that SQL can express."""
    return op7_quality_classifier(spark, sf_dir).select("doc_id", "held_out")
