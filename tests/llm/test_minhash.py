import random

import numpy as np
import pytest

from tessella.llm import minhash
from tessella.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (None, 3), (500, 400), (400, 500), (600, 600)]
    edges += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    parent = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None:
            parent[find(parent, a)] = find(parent, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if None not in e for x in e}
    assert set(got) == nodes
    groups = {}
    for x in nodes:
        groups.setdefault(find(parent, x), set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_the_weighted_similarity(similarity, weighted):
    rng = np.random.default_rng(0)
    n, size, agree, exact = 300, 120, [], []
    for _ in range(30):
        m = int(n * 2 * similarity / (1 + similarity))
        element = rng.integers(0, 2**63, 2 * n - m).astype(np.uint64)
        w = rng.integers(1, 6, (2, element.size)) if weighted else np.ones((2, element.size))
        w[0, n:], w[1, : n - m] = 0, 0
        has = [w[i] > 0 for i in (0, 1)]
        s = minhash.signatures(np.concatenate([element[h] for h in has]), np.repeat([0, 1], [h.sum() for h in has]), np.concatenate([w[i][has[i]] for i in (0, 1)]), 2, size)
        agree.append((s[0] == s[1]).mean())
        exact.append(np.minimum(*w).sum() / np.maximum(*w).sum())
    assert np.mean(agree) == pytest.approx(np.mean(exact), abs=4 * 0.5 / np.sqrt(30 * size))


def test_signature_of_small_and_empty_sets():
    s = minhash.signatures(np.array([5, 5, 7], np.uint64), np.array([0, 1, 1]), np.ones(3), 3, 120)
    assert 0.25 < (s[0] == s[1]).mean() < 0.75 and not s[2].any() and s[0].all()


def brute(rows, least=minhash.LEAST):
    """Class of each row from all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {i: i for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= least * len(a | b)):
                parent[find(parent, i)] = find(parent, j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(find(parent, i), []).append(k)
    low = {r: min((k for k in v if k is not None), default=None) for r, v in ids.items()}
    return [(k, low[find(parent, i)]) for i, (k, _) in enumerate(rows)]


def key(x):
    return tuple(-1 if v is None else v for v in x)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 700)  # so that buckets have several blocks
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    base = rng.choices(words, k=60)
    for _ in range(60):  # a group of near copies, chains within it
        base = list(base)
        base[rng.randrange(60)] = rng.choice(words)
        rows.append((n := n + 1, " ".join(base)))
    passage = rng.choices(words, k=50)
    for _ in range(30):  # a shared passage doesn't make copies
        rows.append((n := n + 1, " ".join(rng.choices(words, k=40) + passage + rng.choices(words, k=40))))
    rows += [(n + 1, "a b"), (n + 2, "a  b"), (n + 3, "a b c"), (n + 4, None), (n + 5, ""), (n + 6, " "), (None, "x y z u v w"), (None, "x y z u v w"), (n + 7, "x y z u v w"), (None, "only null"), (n + 8, "same " * 5000), (n + 9, "same " * 900), (3, rows[2][1])]
    docs = spark.createDataFrame([(k, t, 1, "b") for k, t in rows], "doc_id long, text string, class_id int, band string")
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(key((r.doc_id,)) for r in kept.collect()) == sorted({key((k,)) for k, c in got if k == c})
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = minhash.op8_minhash_near_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_one_row_stays_of_repeated_and_null_ids(spark):
    near = [" ".join(f"{p}{i}" for i in range(200)) for p in ("a", "b")]
    rows = [(1, near[0]), (1, near[0] + " end"), (2, near[0]), (None, near[1]), (None, near[1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]
    assert {r.text.split()[0] for r in kept} == {"a0", "b0"}


def test_links_are_verified_and_connect_classes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 3)  # so that sets of centres are copied
    monkeypatch.setattr(minhash, "BLOCK", 500)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], rng.choices(words, k=70)
    for i in range(40):
        base = [rng.choice(words) if rng.random() < 0.015 else w for w in base]
        rows.append((i, " ".join(base)))
    rows += [(100, " ".join(rng.choices(words, k=50))), (101, rows[0][1])]
    got = {r.doc_id: r for r in minhash.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.class_id for i, r in got.items()} == dict(brute(rows))
    members = {}
    for i, t in rows:
        members.setdefault(got[i].class_id, {})[t] = got[i].n_links
    for m in members.values():  # each text of a class has a link, and there are enough to connect them
        assert sum(m.values()) >= 2 * (len(m) - 1) and (len(m) == 1) == (min(m.values()) == 0)


def test_columns_with_internal_names_pass_through(spark):
    names = ["_key", "_id", "_i", "_k", "_row", "_text", "class_id", "_best"]
    rows = [(i, f"{i // 2} " + " ".join(f"a{k}" for k in range(20 * (i // 2), 20 * (i // 2) + 20)), *range(8)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == rows[::2]
