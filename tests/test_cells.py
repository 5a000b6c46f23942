"""Cells trained on all vectors against the exact search."""

import numpy as np
import pytest
from lodestone.operators import vector_index as X
from lodestone.operators.cells import Cells, _spread
from lodestone.plans import advisor


def _hits(rows):
    return {(r.query_id, r.vec_id, r.score) for r in rows.collect()}


def _asked(vectors):
    return vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_vectors_without_clusters(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    advised = advisor.advised(vectors)
    assert advised["nlist"] == advised["count"] // 39
    index = Cells(advised["nlist"]).fit(vectors).tuned()
    exact, got = _hits(X.top_k(vectors, _asked(vectors), 10)), _hits(index.search(_asked(vectors), 10))
    print(sf, len(index.centres), index.probes, index.read, len(exact & got) / len(exact))
    assert len(got) == len(exact) and len(exact & got) / len(exact) >= 0.9
    # With all cells probed the search is exact.
    assert _hits(index.search(_asked(vectors), 10, probes=len(index.centres))) == exact


def _clustered(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    body = rng.normal(size=(40, 16))[rng.integers(0, 40, n)] * 3 + rng.normal(size=(n, 16)) * 0.6
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(body)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("n", [1_000, 4_000])
def test_few_probes_on_clusters(spark, n):
    vectors = _clustered(spark, n)
    index = Cells(advisor.advised(vectors)["nlist"]).fit(vectors).tuned()
    exact, got = _hits(X.top_k(vectors, _asked(vectors), 10)), _hits(index.search(_asked(vectors), 10))
    print(n, len(index.centres), index.probes, index.read, len(exact & got) / len(exact))
    assert index.probes <= 0.2 * len(index.centres) and index.read <= 0.2
    assert len(exact & got) / len(exact) >= 0.9


def test_training_sums_equal_one_machine(spark):
    vectors = _clustered(spark, 300)
    index = Cells(12).fit(vectors)
    count, cost, total = index._sums(index.centres)
    rows = X._unit(np.array([r.embedding for r in index.rows.collect()], float))
    near = (rows @ index.centres.T).argmax(1)
    assert np.array_equal(count, np.bincount(near, minlength=12)) and count.sum() == index.sizes.sum() == 300
    assert np.allclose(total, [rows[near == c].sum(0) for c in range(12)])
    assert np.isclose(cost.sum(), (2 - 2 * (rows @ index.centres.T).max(1)).sum())
    # Far fewer than a random choice would give: seeds are far from each other.
    assert cost.sum() < 0.5 * sum((2 - 2 * (rows @ rows[:1].T)).ravel()) and len(index.centres) == 12


def test_odd_rows_copies_and_deleted(spark):
    good = _clustered(spark, 200)
    copies = spark.createDataFrame([(1000 + i, good.where("vec_id = 7").first()[1]) for i in range(100)], good.schema)
    odd = spark.createDataFrame([(5000, None), (5001, []), (5002, [1.0]), (5003, [None] + [1.0] * 15), (5004, [float("nan")] * 16), (5005, [0.0] * 16), (None, [1.0] * 16)], good.schema)
    vectors = good.unionByName(copies).unionByName(odd).unionByName(good.limit(30)).selectExpr("vec_id", "embedding", "'x' AS cell", "0.5 AS score")
    index = Cells(8, copies=2).fit(vectors)
    assert index.rows.count() == 300 and index.sizes.sum() == 600
    asked = _asked(good).unionByName(odd.selectExpr("vec_id AS query_id", "embedding")).unionByName(_asked(good).limit(2))
    exact = _hits(X.top_k(good.unionByName(copies), _asked(good), 12))
    assert _hits(index.search(asked, 12)) == exact  # probes are all cells until tuned
    dead = vectors.where("vec_id BETWEEN 1000 AND 1050").select("vec_id")
    assert _hits(index.search(asked, 12, dead=dead)) == _hits(X.top_k(good.unionByName(copies).where("vec_id NOT BETWEEN 1000 AND 1050"), _asked(good), 12))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])]])
def test_tables_of_no_or_one_vector(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    index = Cells(advisor.advised(vectors)["nlist"]).fit(vectors).tuned()
    assert [r.vec_id for r in index.search(asked, 3).collect()] == [i for i, v in rows if v]
    assert index.search(asked.limit(0), 3).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    from lodestone.operators import cells
    vectors = _clustered(spark, 400)
    index = Cells(10, copies=2).fit(vectors)
    whole = _hits(index.search(_asked(vectors), 5, probes=3))
    monkeypatch.setattr(cells, "BROADCAST_QUERIES", 7)
    assert _hits(index.search(_asked(vectors), 5, probes=3)) == whole


def test_seeds_are_far_apart():
    rows = X._unit(np.repeat(np.eye(4), 50, axis=0))
    assert len(np.unique(_spread(rows, np.ones(200), 4, 1).round(6), axis=0)) == 4
    assert _spread(rows[:3], np.ones(3), 4, 1).shape == (3, 4)
