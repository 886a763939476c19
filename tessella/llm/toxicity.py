"""Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features: density and number of words from a lexicon, of its different entries, their nearness to second-person
pronouns, density of those pronouns, obfuscated forms (letters replaced by signs or digits), capitals, exclamation and
other punctuation. The lexicon is a short list of insults and the words and stems that labelled documents show to
be toxic. Trees and calibration are fitted on different parts of the sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import held_out, labelled_sample, sub_batches
from tessella.llm.boosting import Boosted, Isotonic

#: Production parameters. ROWS bounds the labelled documents that are fitted on.
ROWS, NEAR, STEMS = 6000, 5, (4, 5, 6, 7, 8)
#: Insults to begin with.
INSULTS = ["bastard", "clown", "disgusting", "dumb", "filth", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
#: Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "toi", "ton", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes"]
#: Signs and digits that stand for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…–—“”„‘’«»¡¿"
UPPER, MARKS, PUNCTUATION = bytes(range(65, 91)), b"!?", b".,;:#*$%&|<>()[]{}\"'-_/\\"
HIT, STEM, PERSON, HIDDEN, ODD, WEAK = 1, 2, 4, 8, 16, 32
WIDTH = 17


class Lexicon(dict):
    """word as written -> flags; two generations of at most `most` words."""

    def __init__(self, words: set[str], stems: set[str], weak: set[str] = frozenset(), most: int = 150_000):
        super().__init__()
        self.words, self.stems, self.weak, self.most, self.old = words, stems, weak, most, {}
        self.persons, self.table = set(SECOND_PERSON), str.maketrans(DISGUISES)

    def __missing__(self, word: str) -> int:
        if (flags := self.old.get(word)) is None:
            flags = self.flags(word)
        if len(word) < 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = flags
        return flags

    def flags(self, word: str) -> int:
        low = word.lower()
        core = low.strip(EDGES)
        if core in self.words:
            return HIT
        if any(core[:n] in self.stems for n in STEMS):
            return STEM
        if any(core[:n] in self.weak for n in STEMS):
            return WEAK
        if core in self.persons:
            return PERSON
        if core.isalpha() or len(low) > 64:
            return 0
        flags = ODD if core and any(c.isalpha() for c in core) else 0
        for form in (low, core):
            plain = "".join(c for c in form.translate(self.table) if c.isalpha())
            bare = "".join(c for c in form if c.isalpha())
            if plain in self.words or (bare in self.words and len(bare) >= 4):
                return flags | HIDDEN
        return flags


def vector(text: str, lexicon: Lexicon) -> list[float]:
    """The features; of a text without words all are 0."""
    words = text.split()
    if not words:
        return [0.0] * WIDTH
    raw = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(bytes(map(lexicon.__getitem__, words)), np.uint8)
    n, size = len(words), len(raw)
    bad = np.flatnonzero(flags & (HIT | STEM | HIDDEN | WEAK))
    hits, stems, hidden, odd, weak = (int(np.count_nonzero(flags & f)) for f in (HIT | HIDDEN, STEM, HIDDEN, ODD, STEM | WEAK))
    every = hits + stems + 0.3 * (weak - stems)
    persons = np.flatnonzero(flags & PERSON)
    near = 0.0
    if bad.size and persons.size:
        right = np.searchsorted(persons, bad)
        gap = np.minimum(np.abs(persons[np.minimum(right, persons.size - 1)] - bad), np.abs(persons[np.maximum(right - 1, 0)] - bad))
        near = float((gap <= NEAR).mean())
    share = lambda these: (size - len(raw.translate(None, these))) / size
    kinds = len({words[i].lower().strip(EDGES)[:6] for i in bad.tolist()})
    return [np.log1p(n), 100 * hits / n, np.log1p(hits), 100 * stems / n, np.log1p(stems), kinds, 100 * hidden / n, np.log1p(hidden), 100 * persons.size / n, near, share(UPPER), share(MARKS), share(PUNCTUATION), 100 * odd / n, 100 * weak / n, np.log1p(weak), np.log1p(every)]


def learn_lexicon(rows: list[tuple[str, int]]) -> tuple[set[str], set[str], set[str]]:
    """(words, stems, weak stems) that stand in at least 2 % (and 5) of the toxic texts, and there 40 times as often as in
    the others, or, weak stems, 6 times; no stem that a longer one or a word nearly always makes up."""
    toxic, clean, bad, good = Counter(), Counter(), 0, 0
    for text, y in rows:
        cores = {w.lower().strip(EDGES) for w in text.split()}
        (toxic if y else clean).update(cores | {(c[:n],) for c in cores for n in STEMS if len(c) > n})
        bad, good = bad + bool(y), good + (not y)
    ratio = {e: (n + 0.5) / (bad + 1) * (good + 1) / (clean[e] + 0.5) for e, n in toxic.items() if n >= max(5, 0.02 * bad)}

    def kept(least: float) -> list:
        chosen = {e: toxic[e] for e, r in ratio.items() if r >= least}
        longer = Counter()  # of a stem: texts of the commonest longer stem or word that begins with it
        for e, n in chosen.items():
            for k in STEMS:
                if len(e[0] if isinstance(e, tuple) else e) > k:
                    stem = ((e[0] if isinstance(e, tuple) else e)[:k],)
                    longer[stem] = max(longer[stem], n)
        return [e for e, n in chosen.items() if isinstance(e, str) or longer[e] < 0.9 * n]

    strong = kept(40)
    return {e for e in strong if isinstance(e, str) and len(e) >= 3}, {e[0] for e in strong if isinstance(e, tuple)}, {e[0] for e in kept(6) if isinstance(e, tuple)}


class Model:
    def __init__(self, rows: list[tuple[str, int]], folds: int = 3):
        """rows in any fixed order. Each fold's features come from a lexicon learned on the others, so that no text is
        described by words learned from it; three quarters of them fit the trees, the rest the calibration."""
        x, y = np.zeros((len(rows), WIDTH)), np.array([int(v > 0) for _, v in rows])
        for k in range(folds):
            self.learn([r for i, r in enumerate(rows) if i % folds != k])
            lexicon = self.lexicon()
            for i in range(k, len(rows), folds):
                x[i] = vector(rows[i][0], lexicon)
        fits = np.arange(len(rows)) % 4 != 3
        self.trees = Boosted().fit(x[fits], y[fits])
        self.calibration = Isotonic().fit(self.trees.margin(x[~fits]), y[~fits])
        self.learn(rows)

    def learn(self, rows: list[tuple[str, int]]) -> None:
        words, self.stems, self.weak = learn_lexicon(rows)
        self.words = words | set(INSULTS)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems, self.weak)

    def scores(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        x = np.array([vector(t or "", lexicon) for t in texts]).reshape(-1, WIDTH)
        return np.clip(self.calibration.predict(self.trees.margin(x)), 0, 1)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", batch_bytes: int = 2_000_000) -> DataFrame:
    """docs with the column `out`: the probability that a document is toxic, over its whole text.

    A null or empty text counts as one without words. No shuffle; the model (a few kB) is sent once to each executor.
    Other columns pass through; a column already called `out` is replaced."""
    kept = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        lexicon = model.lexicon()
        for batch in sub_batches(batches, text, batch_bytes):
            scores = model.scores(batch.column(text).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fitted on at most `rows` labelled documents that aren't held out."""
    return Model(labelled_sample(documents, labels, "toxic", rows))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_toxicity that SQL can express."""
    return op6_toxicity(spark, sf_dir).select("doc_id", "held_out")
