"""The graph of nearest neighbours against the exact search."""

import numpy as np
import pytest
from lodestone.operators import vector_index as X
from lodestone.operators.graph_index import GraphIndex

SCHEMA = "vec_id long, embedding array<float>, node string, score double"


def _hits(rows):
    return {(r.query_id, r.vec_id, r.score) for r in rows.collect()}


@pytest.mark.parametrize(("sf", "share"), [("sf0.01", 1.0), ("sf0.1", 0.2)])
def test_recall_and_share_read(spark, sf, share):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact, index = _hits(X.top_k(vectors, asked, 10)), GraphIndex().fit(vectors)
    got = _hits(index.search(asked, 10))
    assert len(got) == len(exact)
    assert len(exact & got) / len(exact) >= 0.9
    # What a query reads has a bound that doesn't depend on the table, entries apart (some 240 of 500
    # vectors at sf0.01), so the share is a claim for larger tables.
    met = index.met.count() / asked.count()
    assert met <= 24 + 6 * 5 * 2 * index.degree
    assert (met + index.entries) / index.size < share
    degree = index.adjacency.selectExpr("max(size(near))").first()[0]
    assert degree <= 2 * index.degree


def test_copies_odd_rows_and_deleted_vectors(spark):
    rng = np.random.default_rng(3)
    body = [[float(x) for x in v] for v in rng.normal(size=(240, 8))]
    rows = [(i, v) for i, v in enumerate(body)] + [(1000 + i, body[7]) for i in range(120)]  # a third are copies
    good = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], SCHEMA)
    odd = [(5000, None), (5001, []), (5002, [1.0, 2.0]), (5003, [None] + [1.0] * 7), (5004, [float("nan")] * 8), (5005, [0.0] * 8), (None, body[1])]
    vectors = good.unionByName(spark.createDataFrame([(i, v, None, None) for i, v in odd], SCHEMA)).unionByName(good.limit(30))
    asked = good.where("vec_id IN (3, 7, 1005, 200)").selectExpr("vec_id AS query_id", "embedding")
    index = GraphIndex().fit(vectors)
    assert index.size == 240
    exact = _hits(X.top_k(good.select("vec_id", "embedding"), asked, 12))
    got = _hits(index.search(asked.unionByName(spark.createDataFrame([(-1, None), (-2, [1.0])], "query_id long, embedding array<float>")), 12, beam=60))
    assert len(got) == len(exact) and len(got & exact) / len(exact) >= 0.9
    assert {v for q, v, _ in got if q == 7} == {v for q, v, _ in exact if q == 7} == {7, *range(1000, 1011)}
    dead = good.where("vec_id = 7 OR vec_id BETWEEN 1000 AND 1100").select("vec_id")
    left = {v for q, v, _ in _hits(index.search(asked, 12, beam=60, dead=dead)) if q == 7}
    assert left == {*range(1101, 1113)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])]])
def test_tables_of_no_or_one_vector(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = GraphIndex().fit(vectors).search(asked, 3)
    assert got.columns == ["query_id", "vec_id", "score", "rank"]
    assert [r.vec_id for r in got.collect()] == [i for i, v in rows if v]
