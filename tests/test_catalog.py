import glob
import math
import os

import duckdb
import pytest

from tessella.plans import catalog
from tessella.plans.fixtures import DUCK

SF = "/root/testdata/sf0.001"
SAMPLE = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    assert [d[0] for d in found.description] == df.columns
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert len(got) == len(want)
    assert all(a == pytest.approx(b, abs=2e-6) for a, b in zip(got, want))


def test_palettes_have_few_colours(spark):
    rows = catalog.queries()["reduce_colors"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.image_id, set()).add((r.a, r.r, r.g, r.b))
    assert max(map(len, by.values())) <= 8 and len(rows) == 500 * 64


WHOLE = sorted(n for n in catalog.queries() if n.endswith("_whole"))


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    texts = [(i, "".join(chr(32 + (7 * i + k * k) % 90) for k in range(n)), n) for i, n in enumerate((0, 1, 40, 1024, 1500, 3001))] + [(9, "é ß\n\u4e2d" * 400, 2000)]
    spark.createDataFrame(texts, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_whole_texts_against_sql(spark, long_texts):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{long_texts}/documents.parquet/*.parquet'")
    assert len(WHOLE) == 10
    for name in WHOLE:
        got = sorted(map(tuple, catalog.queries()[name](spark, long_texts).collect()))
        sql = catalog.oracle_sql().get(name.removesuffix("_whole"))
        if sql:
            assert got == sorted(con.execute(sql.replace(DUCK["doc"], DUCK["whole_doc"])).fetchall()), name
        else:
            assert len(got) == 1 + 32 * (2 + 32 + 47 + 94 + 63), name  # whole rows
