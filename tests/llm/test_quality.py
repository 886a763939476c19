import zlib

import numpy as np
import pytest

from tessella.llm import quality


def auc(y, s):
    y, rank = np.array(y), np.argsort(np.argsort(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def by_hand(text, margins, bias):
    """Feature by feature, word by word."""
    ids = []
    words = text.encode().split()
    for i, w in enumerate(words):
        marked = b" " + w + b" "
        for n in quality.GRAMS:
            for k in range(len(marked) - n + 1):
                code = int.from_bytes(marked[k : k + n][-4:], "big")
                ids.append((((code + n) * 0x9E3779B1) & 0xFFFFFFFF) >> 8)
        buffer = np.frombuffer(w, np.uint8)
        ids.append(int(quality.hashes_of(buffer, np.array([0]), np.array([len(w)]))[0]) >> 40)
        if i and w == words[i - 1]:
            ids.append(quality.REPEATED)
    z = np.mean([margins[i % margins.size] for i in ids]) + bias if ids else bias
    return 1 / (1 + np.exp(-z))


def test_scores_add_up_over_all_features():
    margins = np.random.default_rng(1).normal(size=1 << 12)
    texts = ["a bb  ccc\tdddd", "", None, "x", "é é é\n\nÉcole x", " lead and trail ", "w" * 3000 + " end end", "end"]
    got = quality.probabilities(texts, margins, 0.3)
    assert got == pytest.approx([by_hand(t or "", margins, 0.3) for t in texts])


def test_fit_without_rows_or_classes():
    assert quality.probabilities(["a b"], *quality.Model(256).fit([]).folded()) == pytest.approx([0.5])
    assert quality.probabilities([""], *quality.Model(256).fit([("a", 1)] * 9).folded())[0] > 0.5


def test_frames(spark):
    rows = [(1, "good words here", 3.0, None), (None, None, 1.0, "x"), (1, "good words here", 3.0, None), (2, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, lang string")
    out = quality.score(docs, np.zeros(64), 1.0)
    assert out.count() == 4 and set(out.columns) == set(docs.columns)
    assert quality.score(docs.limit(0), np.zeros(64), 1.0).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    assert [y for _, y in quality.labelled_sample(docs, labels, "quality", 10)] == [1, 1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op7_quality_classifier(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    held = [(y, r.score, r.predicted) for y, r in labels if r.held_out]
    assert auc([y for y, _, _ in held], [s for _, s, _ in held]) > 0.99
    assert np.mean([p for y, _, p in held if y == 1]) > 0.99
    assert np.mean([p for y, _, p in held if y == 0]) < 0.1


def test_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    margins, bias = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.op7_quality_classifier(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(by_hand(texts[r.doc_id], margins, bias), abs=1e-9) and r.predicted == (r.score >= quality.THRESHOLD)


def test_repeated_ids_are_bounded(spark):
    """A labelled id that very many rows have brings two texts, not all of them."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert quality.labelled_sample(docs, labels, "quality", 10) == [("text 0", 1), ("text 99", 1), ("b", 0), ("", 0)]
