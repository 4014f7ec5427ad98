"""The pipeline's stages hand on the columns of documents, and odd inputs do not break them."""

from pyspark.sql import functions as F

import corpus_pipeline
from strandspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count()
        if name != "mix":
            assert out.count() <= n
        docs, n = out, out.count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == n and final.where("n_tokens <> size(ids)").count() == 0


def test_stages_with_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (5001, "", None, None, 0), (5002, None, "en", "s", None)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
