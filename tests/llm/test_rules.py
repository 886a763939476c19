import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", " a a a a\n\n a a a a\n", "é #x\x0b\x0c\r\ny | <z>\x85\xa0q", "same line\nsame line\r\nsame line\n  \n  ", "x " * 3000]
    texts += ["".join(rng.choices(["a", "b", "c ", " ", "\n", "#", "a b c ", "zz\n"], k=rng.randint(1, 200))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_lines int, _w string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rules.statistics(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr(t)


def by_hand(x):
    """The same steps in numpy for one group."""
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    m, cov = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, np.sqrt(rules.FLOORS)) ** 2)
    for _ in range(rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
        near = x[d <= np.quantile(d, rules.PART, method="lower")]
        m, cov = near.mean(0), np.cov(near.T, bias=True) * rules.CONSISTENCY + np.diag(rules.FLOORS)
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(60, 3000, 400)
    chars = (n * rng.normal(5, 0.4, 400)).astype(int)
    rows = [(int(a), int(b), int(c), 0, int(d), False, "en", "s") for a, b, c, d in zip(n, chars, rng.integers(0, 3, 400), n // rng.integers(5, 30, 400))]
    rows[0] = (500, 2500, 900, 0, 10, False, "en", "s")
    stats = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lang string, source string")
    x = np.array([[r[f"x{i}"] for i in range(4)] for r in stats.select(*(c.alias(f"x{i}") for i, c in enumerate(rules.vector()))).collect()])
    got = {(r.n_words, r.word_chars, r.n_repeat_words): (r.distance, r.kept) for r in rules.judge(stats, rules.fit(stats)).collect()}
    for r, d in zip(rows, by_hand(x)):
        assert got[r[0], r[1], r[4]][0] == pytest.approx(d, rel=0.05)
    assert not got[500, 2500, 10][1] and sum(k for _, k in got.values()) >= 395


def test_groups_nulls_and_empty(spark):
    good = "".join(f"w{i} " for i in range(80))
    rows = [(i, good + f"x{i}", "en" if i % 2 else None, None if i % 3 else "s", 1.0) for i in range(300)]
    rows += [(1000, good, "de", "rare", 1.0), (1000, good, "de", "rare", 1.0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance double")
    stats = rules.statistics(docs.drop("distance"))
    out = rules.judge(stats, rules.fit(stats)).collect()
    assert len(out) == len(rows) and all(r.kept for r in out if r.doc_id is not None)
    assert [r.kept for r in out if r.doc_id is None] == [False]
    none = stats.limit(0)
    assert rules.judge(none, rules.fit(none)).count() == 0
    kept = rules.good_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1


def test_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = rules.op9_quality_rules(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.count() == len(texts)
    assert all(tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]) for r in got.collect())
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    by = {r.quality: r.kept for r in held.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1] == 1 and by[0] < 0.6


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lang string, source string"


def clean_rows(rng, n):
    words = rng.integers(60, 3000, n)
    return [(i, int(w), int(w * rng.normal(5, 0.2)), 0, 0, int(w // rng.integers(20, 60)), False, "en", "s") for i, w in enumerate(words)]


def test_a_third_of_bad_copies(spark):
    rng = np.random.default_rng(5)
    rows = clean_rows(rng, 200) + [(1000 + i, 400, 3100, 1100, 0, 0, False, "en", "s") for i in range(100)]
    stats = spark.createDataFrame(rows, STATS)
    got = {r.doc_id: r.kept for r in rules.judge(stats, rules.fit(stats)).collect()}
    assert not any(k for i, k in got.items() if i >= 1000)
    assert sum(k for i, k in got.items() if i < 1000) >= 198


def test_symbols_at_every_second_word(spark):
    rng = np.random.default_rng(6)
    rows = clean_rows(rng, 200) + [(1000 + i, 300, 1260, 105 + 5 * i, 0, 0, False, "en", "s") for i in range(10)]
    stats = spark.createDataFrame(rows, STATS)
    got = {r.doc_id: r.kept for r in rules.judge(stats, rules.fit(stats)).collect()}
    assert not any(k for i, k in got.items() if i >= 1000)
    assert sum(k for i, k in got.items() if i < 1000) >= 198


def production_by_hand(x):
    """Starts, steps, choice by determinant and the last estimate in numpy for one group."""
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    m = q[1]
    away = np.quantile(np.abs(x - m), 0.5, axis=0, method="inverted_cdf") * 1.4826 * rules.STRETCH
    s = np.maximum(np.minimum((q[2] - q[0]) / 1.349, away), np.sqrt(rules.FLOORS))
    z = (x - m) / s
    norm = np.sqrt((z**2).sum(1, keepdims=True))
    shape = lambda v: np.cov(v.T, bias=True) + np.diag(rules.FLOORS)
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        d = dist(m, c)
        near = x[d <= np.quantile(d, rules.PART, method="inverted_cdf")]
        return near.mean(0), shape(near) + (rules.CONSISTENCY - 1) * np.cov(near.T, bias=True)

    found = []
    for c in (np.diag(s**2), shape(s * np.tanh(z)), shape(2 * s * np.divide(z, norm, where=norm > 0, out=np.zeros_like(z)))):
        at = (m, c)
        for _ in range(rules.FIRST):
            at = step(*at)
        found.append((np.linalg.slogdet(at[1])[1], len(found), at))
    low, _, best = min(found, key=lambda f: f[:2])
    for _ in range(rules.MORE):
        after = step(*best)
        now = np.linalg.slogdet(after[1])[1]
        if now < low:
            fell, low, best = low - now, now, after
            if fell > rules.STILL:
                continue
        break
    near = x[dist(*best) <= rules.chi_square_quantile(rules.OUTSIDE)]
    return dist(near.mean(0), shape(near))


def test_competing_starts_against_numpy(spark):
    rng = np.random.default_rng(8)
    rows = clean_rows(rng, 300) + [(1000 + i, 400, 3100, 1100, 0, 0, False, "en", "s") for i in range(150)]
    rows += [(2000 + i, int(w), int(w * 5), int(w // 90), 0, int(w // 8), False, "en", "s") for i, w in enumerate(rng.integers(60, 900, 20))]
    stats = spark.createDataFrame(rows, STATS)
    x = np.array([[r[f"x{i}"] for i in range(4)] for r in stats.select(*(c.alias(f"x{i}") for i, c in enumerate(rules.vector()))).collect()])
    got = {r.doc_id: r for r in rules.judge(stats, rules.production_fit(stats)).collect()}
    for r, d in zip(rows, production_by_hand(x)):
        assert got[r[0]].distance == pytest.approx(d, rel=1e-6)
    assert not any(r.kept for i, r in got.items() if 1000 <= i < 2000)
    assert sum(r.kept for i, r in got.items() if i < 1000) >= 297


def test_chi_square_quantile():
    assert rules.chi_square_quantile(0.025) == pytest.approx(11.1433, abs=1e-3) and rules.chi_square_quantile(0.001) == pytest.approx(18.4668, abs=1e-3)


def test_columns_with_internal_names_pass_through(spark):
    names = ["_row", "_text", "_words", "_hashes", "_placed", "_lines", "_group", "_", "x0", "m0", "l00", "d", "limit", "start"]
    good = "".join(f"w{i} " for i in range(80))
    docs = spark.createDataFrame([(i, good + f"x{i}", "en", "s", *range(len(names))) for i in range(70)], f"doc_id long, text string, lang string, source string, {', '.join(f'`{n}` int' for n in names)}")
    stats = rules.materialise(rules.statistics(docs), "stats")
    out = rules.judge(stats, rules.fit(stats)).collect()
    assert len(out) == 70 and all([r[n] for n in names] == list(range(len(names))) and r.n_words == 81 for r in out)
    # the results' own names are replaced
    again = rules.statistics(docs.withColumns({"n_words": F.lit(-1), "kept": F.lit(-1)}).drop("_row"))
    assert again.columns.count("n_words") == 1 and {r.n_words for r in again.collect()} == {81}
    kept = rules.good_documents(docs.drop("_row"))
    assert kept.columns == [c for c in docs.columns if c != "_row"] and all(r.x0 == names.index("x0") for r in kept.collect())


def test_base_sql(spark):
    import duckdb

    rng = random.Random(3)
    texts = [None, "", " \n", "a b c a b c", "é #x\x0b\x0c\r\ny | <z>\x85\xa0q", "l\nl\r\nl\n l", "w " * 200]
    texts += ["".join(rng.choices(["a", "b", "c ", " ", "\n", "#", "a b c ", "zz\n"], k=rng.randint(1, 200))) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    names = ["doc_id", *COLUMNS]
    want = con.sql(f"select {', '.join(names)} from ({rules.OP9_BASE_SQL})").fetchall()
    assert sorted(want) == sorted(tuple(r[n] for n in names) for r in rules.statistics(frame).collect())


def test_registered_queries_are_callable_and_base_matches_its_sql(spark, tmp_path):
    import duckdb

    from tessella.llm import queries

    found = queries.queries()
    assert [n for n, q in found.items() if not callable(q)] == [] and set(queries.oracle_sql()) <= set(found)
    good = "".join(f"w{i} " for i in range(80))
    rows = [(i, good + f"x{i}", "en" if i % 2 else None, "s") for i in range(70)] + [(None, good, "de", None), (7, None, "en", "s"), (7, "a b c a b c", None, None), (8, "é #x\x0b\x0c\r\ny | <z>\x85\xa0q\nl\nl", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = found["op9_base"](spark, str(tmp_path)), con.execute(queries.oracle_sql()["op9_base"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
