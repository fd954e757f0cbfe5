"""The inverted file against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import inverted, vectors

SF = "/root/testdata/sf0.1"


def pairs(df):
    return {(r["query"], r["vec_id"]) for r in df.collect()}


def test_recall_over_the_embeddings(spark):
    """Every id divisible by 100 against all rows."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = v.filter("vec_id % 100 = 0")
    index = inverted.build(v)
    got, want = pairs(inverted.search(index, queries)), pairs(vectors.top_k(v, queries))
    assert len(want) == 10 * queries.count() and len(got) == len(want)
    assert len(got & want) >= 0.9 * len(want)
    assert index.probes < len(index.centres)
    assert spark.read.parquet(f"{index.folder}/vectors").count() == v.count()


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    queries = v.filter("vec_id % 100 = 0")
    index = inverted.build(v)
    got, want = pairs(inverted.search(index, queries)), pairs(vectors.top_k(v, queries))
    assert index.probes <= len(index.centres) // 4 and len(got & want) >= 0.9 * len(want)


def test_a_hot_list_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 100)
    monkeypatch.setattr(inverted, "ASKED", 3)
    rows = [(k, [1.0, 0.0] if k % 3 else [float(np.cos(k)), float(np.sin(k))]) for k in range(1200)] + [(5000, [0.0, 0.0]), (5001, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = inverted.build(v)
    index.probes = len(index.centres)  # all lists: the exact answer
    queries = v.filter("vec_id % 100 = 0")
    got = {(r["query"], r["rank"]): round(r["score"], 5) for r in inverted.search(index, queries, k=5).collect()}
    want = {(r["query"], r["rank"]): round(r["score"], 5) for r in vectors.top_k(v.filter("embedding is not null"), queries, k=5).collect()}
    assert got == want and len(got) == 5 * queries.count()


def test_an_empty_table(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert inverted.search(inverted.build(v), v).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert inverted.search(inverted.build(one), one).count() == 0


def test_the_best_are_limited_before_the_exchange(spark):
    found = spark.range(1000).select((F.col("id") % 3).alias("query"), F.col("id").alias("vec_id"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in vectors.best_of(found, "vec_id", 4)._jdf.queryExecution().executedPlan().toString()
    assert vectors.best_of(found, "vec_id", 4).count() == 12
