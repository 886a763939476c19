import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import urlfilter as u


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for r, v in u.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://com", "https://www.Example.com/en/x?q=1&b=2#t", "http://example.com/en/", "http://example.com/en", "http://a.example.com/en/1", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/fr/?a", "http://net/de/", "http://x.org/a//b/c.html", "http://a.net?x://y.com/", "a\nb://h.com/p\nq?z", "ftp://É.com/ÀB", "http://" + "x" * 5000 + ".com/" + "y/" * 3000, "://com/z", "http://www.www.example.com/en/",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, x, "h", 1) for i, x in enumerate(URLS)], "page_id long, url string, host string, score int")
    got = {r.page_id: r for r in u.judge(df).collect()}
    for i, x in enumerate(URLS):
        host, path, rule, verdict = brute(x)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), x
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert u.judge(df.limit(0)).count() == 0
    only = df.where("url = 'http://x.org/a//b/c.html'")
    assert u.judge(only.union(only)).count() == 2


def test_features(spark):
    df = spark.createDataFrame([(x,) for x in URLS], "url string").withColumns(dict(zip(("host", "path"), u.parts())))
    for r in df.select("url", *(f.alias(k) for k, f in u.lexical().items())).collect():
        x = r.url or ""
        counts = Counter(x)
        assert r.entropy == pytest.approx(-sum(n / len(x) * math.log2(n / len(x)) for n in counts.values()) if x else 0, abs=1e-9)
        assert r.length == len(x) and r.digits == pytest.approx(sum(c in "0123456789" for c in x) / max(1, len(x)))
        query = re.match(r"(?s)[^?#]*\?([^#]*)", x)
        assert r.parameters == (len([p for p in query[1].split("&") if p]) if query else 0)


def test_trees_learn(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        bad = rng.random() < 0.4
        path = "/".join("".join(rng.choices("0123456789" if bad and rng.random() < 0.9 else "abcdefgh", k=8)) for _ in range(rng.randint(1, 3)))
        rows.append((f"http://h{rng.randint(1, 9)}.org/{path}", int(bad)))
    df = spark.createDataFrame(rows, "url string, blocked int").withColumns(dict(zip(("host", "path"), u.parts())))
    model = u.fit(df.limit(1000), trees=4)
    out = model.prepare(df).select("blocked", (model.score() >= 0.5).cast("int").alias("p")).collect()
    assert sum(r.blocked == r.p for r in out) > 0.9 * len(out)
    alone = u.fit(df.where("blocked = 1"))
    assert alone.prepare(df).select(alone.score()).first()[0] > 0.9


def test_query_and_plan(spark):
    sf = "/root/testdata/sf0.01"
    out = u.op4_url_filter(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    want = {r.page_id: brute(r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in out.collect():
        assert (r.host, r.path, r.rule) == want[r.page_id][:3] and r.verdict == (want[r.page_id][3] or r.verdict) and r.verdict in ("allow", "block")


def test_columns_with_internal_names_pass_through(spark):
    names = ["_row", "_ruled", "f_length", "f_suffix", "b_length", "length", "blocked", "link"]
    df = spark.createDataFrame([(i, x, "u", *([7] * len(names))) for i, x in enumerate(URLS)], f"page_id long, address string, url string, {', '.join(f'{n} int' for n in names)}")
    out = u.judge(df, url="address").collect()
    assert len(out) == len(URLS) and all(r[n] == 7 for r in out for n in names) and all(r.address == URLS[r.page_id] and r.url == "u" for r in out)
    assert all((r.host, r.path, r.rule) == brute(r.address)[:3] for r in out)


def test_bounded_fit(spark):
    rows = [(f"http://h{i % 7}.org/{'9' * (i % 5) if i % 2 else 'abc'}/{i}", i % 2) for i in range(3000)] + [("http://hot.org/9", 1)] * 1500
    df = spark.createDataFrame(rows, "url string, blocked int").withColumns(dict(zip(("host", "path"), u.parts())))
    model = u.fit(df, trees=3, most=900)
    assert model.trees.trees and set(model.suffixes) and u.fit(df.where("url = 'http://hot.org/9'").withColumn("blocked", (F.rand(1) > 0.5).cast("int")), most=1).prior > 0.3


def test_rules_sql(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(URLS)), "url": URLS}))
    assert {r[0]: r[1:] for r in con.sql(u.OP4_RULES_SQL).fetchall()} == {i: brute(x) for i, x in enumerate(URLS)}
