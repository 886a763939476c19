import corpus_pipeline
from pyspark.sql import functions as F
from test_minhash import brute as classes
from test_packing import check
from test_rules import brute as base

from tessella.llm import quality, rules

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"stage{i}")
        steps.append(docs)
        assert i == 3 or docs.columns == columns
    rows = [{r.doc_id: r.text for r in s.collect()} for s in steps[:4]]
    # quality: exactly those at the threshold or above, and no clean document lost
    margins, bias = quality.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    texts = list(rows[0].items())
    scores = quality.probabilities([t for _, t in texts], margins, bias)
    assert set(rows[1]) == {k for (k, _), s in zip(texts, scores) if s >= quality.THRESHOLD}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} & set(rows[0])
    assert len(good & set(rows[1])) > 0.99 * len(good)
    # rules: the base rules by hand, the outliers by numpy's distances from the operator's estimates
    passed = {k for k, t in rows[1].items() if not base(t)[-1]}
    assert set(rows[2]) <= passed and len(rows[2]) > 0.97 * len(passed)
    # near copies: of each class by all pairs the smallest id
    assert set(rows[3]) == {c for _, c in classes(list(rows[2].items()))}
    assert all(rows[3][k] == rows[0][k] for k in rows[3])
    # packing: every piece of every document, in full sequences
    pieces = steps[4].collect()
    assert {r.doc_id for r in pieces} == set(rows[3])
    assert check(pieces, rows[3]) <= -(-sum(r.length for r in pieces) // 2048) + 3


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where(F.col("length") > 0).count() > 50


def test_a_run_leaves_its_result_only(spark):
    from tessella.llm import _shared

    before = set(_shared._written)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(set(_shared._written) - before) == 1 and out.count() > 50
    assert out.count() == out.select("doc_id", "piece").distinct().count()


def test_edge_rows_go_through_every_stage(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names, an empty table."""
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (None, "word " * 60, "en", None, 300)], good.schema)
    extra = good.unionByName(odd).unionByName(good.limit(3)).withColumns({"_score": F.lit(5), "_row": F.lit("r"), "_key": F.lit("k"), "x0": F.lit(1.5)})
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == extra.columns and {(r["_score"], r["_row"], r["_key"], r["x0"]) for r in docs.collect()} <= {(5, "r", "k", 1.5)}
    assert docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty() and docs.count() > 20
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
