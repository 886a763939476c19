import zlib

import numpy as np

from tessella.llm import toxicity
from tessella.llm.boosting import Boosted, Isotonic


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    trees = Boosted().fit(x[:2000], y[:2000])
    margin = trees.margin(x[2000:])
    assert np.mean((margin > 0) == y[2000:]) > 0.95
    p = Isotonic().fit(margin, y[2000:]).predict(np.sort(margin))
    assert (np.diff(p) >= 0).all() and 0 < p[0] < 0.1 and 0.9 < p[-1] < 1
    assert Boosted().fit(np.empty((0, 2)), np.empty(0)).margin(np.zeros((1, 2)))[0] == 0


def test_pools_against_brute_force():
    y = np.array([0, 1, 0, 0, 1, 1, 0, 1])
    fitted = Isotonic().fit(np.arange(8.0), y)
    # pools by hand: [0], [1 0 0], [1 1 0], [1]
    assert np.allclose(fitted.predict(np.arange(8.0)), [0.5 / 9, *[1 / 3] * 3, *[2 / 3] * 3, 8.5 / 9])


def test_flags():
    lexicon = toxicity.Lexicon(set(toxicity.INSULTS), {"lowei"}, most=2)
    assert lexicon["Idiot!!"] == toxicity.HIT and lexicon["loweiwei,"] == toxicity.STEM and lexicon["You"] == toxicity.PERSON
    assert lexicon["id1ot"] & toxicity.HIDDEN and lexicon["m0r0n!"] & toxicity.HIDDEN and lexicon["i.d.i.o.t"] & toxicity.HIDDEN
    assert lexicon["the"] == lexicon["2024"] == lexicon["$$$"] == 0
    assert lexicon["Idiot!!"] == toxicity.HIT


def test_near_second_person():
    lexicon = toxicity.Lexicon(set(toxicity.INSULTS), set())
    assert toxicity.vector("you are an idiot", lexicon)[9] == 1
    assert toxicity.vector("you " + "word " * 9 + "idiot", lexicon)[9] == 0
    assert toxicity.vector(" \n", lexicon) == [0] * toxicity.WIDTH


def test_frames(spark):
    rows = [(1, "you idiot", 3.0), (None, None, 1.0), (1, "you idiot", 3.0), (2, "", None), (3, "idiot " * 100_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = toxicity.Model([(("a nice day " if y == 0 else "you idiot and scum ") * n, y) for n in range(1, 40) for k in range(3) for y in (0, 1)])
    out = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    by = dict(out)
    assert by[3] > 0.5 and by[2] == by[None] and len(out) == 4
    assert toxicity.score(docs.limit(0), toxicity.Model([])).count() == 0
    assert toxicity.score(docs, toxicity.Model([])).first().score == 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([p for y, p in held if y == 1]) > 0.9  # 3155 rows in four languages are few
    assert np.mean([p for y, p in held if y == 0]) < 0.01


def by_hand(text, model):
    """The score of a text word by word, tree by tree, straight from the features' description."""
    edge = set(toxicity.EDGES)

    def kind(word):
        low = word.lower()
        core = low
        while core and core[0] in edge:
            core = core[1:]
        while core and core[-1] in edge:
            core = core[:-1]
        if core in model.words:
            return {"hit"}
        if any(core[:n] in model.stems for n in toxicity.STEMS):
            return {"stem"}
        if any(core[:n] in model.weak for n in toxicity.STEMS):
            return {"weak"}
        if core in toxicity.SECOND_PERSON:
            return {"person"}
        if core.isalpha() or len(low) > 64:
            return set()
        out = {"odd"} if any(c.isalpha() for c in core) else set()
        for form in (low, core):
            plain = "".join(d for d in (toxicity.DISGUISES.get(c, c) for c in form) if d.isalpha())
            bare = "".join(c for c in form if c.isalpha())
            if plain in model.words or (len(bare) >= 4 and bare in model.words):
                out.add("hidden")
        return out

    words, x = (text or "").split(), [0.0] * toxicity.WIDTH
    if words:
        kinds, n = [kind(w) for w in words], len(words)
        count = lambda *names: sum(bool(k & set(names)) for k in kinds)
        bad, persons = ([i for i, k in enumerate(kinds) if k & names] for names in ({"hit", "stem", "hidden", "weak"}, {"person"}))
        near = [min(abs(i - j) for j in persons) <= toxicity.NEAR for i in bad] if persons else []
        raw = text.encode()
        share = lambda marks: sum(b in marks for b in raw) / len(raw)
        hits, stems, weak = count("hit", "hidden"), count("stem"), count("stem", "weak")
        different = len({words[i].lower().strip(toxicity.EDGES)[:6] for i in bad})
        log = lambda v: float(np.log1p(v))
        x = [log(n), 100 * hits / n, log(hits), 100 * stems / n, log(stems), different, 100 * count("hidden") / n, log(count("hidden")), 100 * len(persons) / n, np.mean(near) if near else 0.0]
        x += [share(toxicity.UPPER), share(toxicity.MARKS), share(toxicity.PUNCTUATION), 100 * count("odd") / n, 100 * weak / n, log(weak), log(hits + stems + 0.3 * (weak - stems))]
    z = model.trees.base
    for levels, leaves in model.trees.trees:
        at = 0
        for feature, threshold in levels:
            at = 2 * at + int(x[feature[at]] > threshold[at])
        z += leaves[at]
    places, values = model.calibration.at, model.calibration.value
    if z <= places[0]:
        return values[0]
    for (a, p), (b, q) in zip(zip(places, values), zip(places[1:], values[1:])):
        if z <= b:
            return q if a == b else p + (q - p) * (z - a) / (b - a)
    return values[-1]


def test_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op6_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - by_hand(texts[r.doc_id], model)) < 1e-9 and r.predicted == (r.score >= 0.5)
