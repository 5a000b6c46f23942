"""The index of two levels against brute force over what lives."""

import numpy as np
import pytest
from lodestone.operators import vector_index as X
from lodestone.operators.steps import Steps
from lodestone.operators.two_level import TwoLevelIndex, dense_positions

SCHEMA = "vec_id long, embedding array<float>"


def _rows(spark, ids, seed=1):
    body = np.random.default_rng(seed).normal(size=(len(ids), 6))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, body, strict=True)], SCHEMA)


def _hits(rows):
    return {(r.query_id, r.vec_id, r.score, r["rank"]) for r in rows.collect()}


def _ids(rows):
    return {r.vec_id: r.position for r in rows.collect()}


@pytest.mark.parametrize("cells", [None, 4])
def test_search_after_add_delete_replace_compact(spark, cells):
    first, later, turned = _rows(spark, list(range(120))), _rows(spark, list(range(100, 180)), 2), _rows(spark, [3, 150, 500], 3)
    asked = _rows(spark, [1, 2, 3, 4], 9).withColumnRenamed("vec_id", "query_id")
    index = TwoLevelIndex(first, cells, recall=1.0)
    if cells:
        index.index.probes = cells  # all cells: exact
    now = {r.vec_id: r.embedding for r in first.collect()}

    def same():
        truth = spark.createDataFrame(list(now.items()), SCHEMA)
        assert _hits(index.search(asked, 7).select("query_id", "vec_id", "score", "rank")) == _hits(X.top_k(truth, asked, 7))
        assert _ids(index.live()).keys() == now.keys()

    same()
    assert index.add(later) == 60 and index.total == 180
    now |= {r.vec_id: r.embedding for r in later.where("vec_id >= 120").collect()}
    same()
    gone = spark.createDataFrame([(i,) for i in (*range(0, 180, 9), None, 999)], "vec_id long")
    index.delete(gone)
    now = {i: v for i, v in now.items() if i % 9}
    same()
    assert index.replace(turned) == 3
    now |= {r.vec_id: r.embedding for r in turned.collect()}
    same()
    # Dead positions stay empty; the new rows continue after the last.
    assert sorted(_ids(index.live()).values())[-3:] == [180, 181, 182] and index.dead.count() == 15
    order = sorted(now, key=_ids(index.live()).get)
    index.compact()
    if cells:
        index.index.probes = len(index.index.centres)
    same()
    assert _ids(index.live()) == {i: n for n, i in enumerate(order)}
    assert not index.deltas and not index.dead.count() and index.total == len(now)


def test_odd_rows_and_repeats(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0])], SCHEMA)
    index = TwoLevelIndex(odd.selectExpr("*", "0 AS position", "'x' AS level"))
    assert [(r.vec_id, r.embedding) for r in index.live().collect()] == [(1, [0.0, 1.0])]
    assert index.add(odd) == 0 and index.add(odd.limit(0)) == 0 and not index.deltas
    asked = spark.createDataFrame([(9, [0.0, 2.0]), (8, None), (7, [1.0]), (None, [1.0, 1.0])], "query_id long, embedding array<float>")
    assert _hits(index.search(asked)) == {(9, 1, 1.0, 1)}


def test_empty_index_takes_its_width_from_the_first_batch(spark):
    index = TwoLevelIndex(_rows(spark, [1]).limit(0))
    asked = _rows(spark, [1]).withColumnRenamed("vec_id", "query_id")
    assert index.search(asked).count() == 0
    index.delete(_rows(spark, [1]))
    assert index.add(_rows(spark, [5, 6])) == 2
    assert _ids(index.live()) == {5: 0, 6: 1} and index.search(asked).count() == 2
    index.compact()
    assert _ids(index.live()) == {5: 0, 6: 1}


def test_positions_are_dense_over_many_ranges(spark):
    steps = Steps(spark, "t")
    got = dense_positions(spark.range(5000).selectExpr("(id * 7919) % 5000 AS n").repartition(13), "n", 42, steps)
    assert got.where("position <> n + 42").count() == 0 and got.select("position").distinct().count() == 5000
    assert dense_positions(spark.range(0), "id", 3, steps).count() == 0
