"""Layouts of tables, signs of zero, rounded times, and results and memory at larger sizes."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import tasks
from lodestone.operators import vector_index as X
from lodestone.operators.graph_index import _compare
from lodestone.plans import queries as Q
from lodestone.streaming import events as stream

SF = "/root/testdata/sf0.001"


def test_request_rate_rounds_to_milliseconds(spark):
    """61 s less 386 microseconds apart, yet 60,999 ms apart when both are rounded down only."""
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp_micros(1704205036753750)), (2, 'a', timestamp_micros(1704205097753364)), (3, 'b', timestamp_micros(-500)), (4, 'b', timestamp_micros(60998499)) AS t(event_id, k, ts)")
    assert {r.event_id: r.recent for r in tasks.request_rate(rows, "k").collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-1e-7, 1e-7, 0.0, -0.0, -0.1234565, 2.5e-6, -2.5e-6, float("nan")]
    got = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", lambda x: V.rounded(x, 6))).first()[0]
    want = [-0.0, 0.0, 0.0, -0.0, -0.123457, 3e-6, -3e-6]
    assert list(map(repr, got[:-1])) == list(map(repr, want)) and math.isnan(got[-1])


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(1, [-1e-7] + [1.0] * 63)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert repr(Q.vector_normalise(spark, str(tmp_path)).first().unit[0]) == "-0.0"


def test_a_stream_reads_a_folder_of_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/client_changes.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "client_changes.parquet"))
    got, want = Q.stream_keep(spark, str(tmp_path)), Q.stream_keep(spark, SF)
    assert got.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_whole_results_of_streams_are_files(spark):
    """A result that each batch replaces is read from the shared folder, not held by the driver."""
    got = Q.stream_sessions(spark, SF)
    assert got.inputFiles() and got.count() > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stream_sessions")]


def _random_hits(rng, n, asked):
    return pa.table({"query_id": rng.integers(0, asked, n), "vec_id": rng.integers(0, 1 << 40, n), "label": rng.integers(0, 3, n), "score": np.round(rng.random(n), 3)})


def test_held_hits_are_bounded_and_the_best(monkeypatch):
    """However many hits a task meets, it holds no more than a bound, and loses none of the best."""
    monkeypatch.setattr(X, "_AT_ONCE", 4000)
    monkeypatch.setattr(X, "_HELD", 3000)
    rng, ids = np.random.default_rng(3), pa.array([f"q{n}" for n in range(40)])
    for larger in (True, False):
        held, out, every = X._Held(4, larger, ["label"]), [], []
        for n in range(60):
            block, hits = n % 3, _random_hits(rng, 500, 40)
            every += [(block, f"q{r['query_id']}", r["label"], r["score"], r["vec_id"]) for r in hits.to_pylist()]
            out += [(block, b) for b in held.add(block, ids, hits)]
            assert sum(len(t) for _, t in held.tables.values()) <= 3000 + 500
        assert held.limits
        # Blocks are told apart by nothing but their ids, which are the same here.
        got = {tuple(r.values()) for b in [*[b for _, b in out], *held.rest()] for r in b.to_pylist()}
        for block in range(3):
            for q in ids.to_pylist():
                for label in range(3):
                    best = sorted((x for x in every if x[:3] == (block, q, label)), key=lambda x: (-x[3] if larger else x[3], x[4]))[:4]
                    assert {(q, v, label, s) for _, _, _, s, v in best} <= got


def test_buckets_are_met_without_a_row_for_each_candidate(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = X.lsh_search(vectors, asked, 5, flips=1)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    held = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    planes = np.array(X._directions(64, 8, 8, 7))
    signs = {n: planes @ v >= 0 for n, v in held.items()}
    unit = {n: v / np.linalg.norm(v) for n, v in held.items()}
    for q in (n for n in held if n % 20 == 0):
        near = [n for n in held if ((signs[n] != signs[q]).sum(1) <= 1).any()]
        assert {v for a, v in got if a == q} == set(sorted(near, key=lambda n: (-round(unit[n] @ unit[q], 6), n))[:5])


def test_codes_leave_a_task_as_its_best_only(spark):
    """Rows that the search of codes shuffles depend on tasks and queries, not on batches."""
    vectors = spark.range(6000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.xxhash64(F.col("id"), i) % 1000).cast("float")).alias("embedding")).coalesce(1).cache()
    asked = vectors.where("vec_id % 600 = 0").withColumnRenamed("vec_id", "query_id")
    coder = X.ProductQuantizer(parts=4, centres=8, rounds=2).fit(vectors)
    # Of 6 batches of 1,000 rows, 200 each would be 12,000 rows.
    assert coder._nearest_codes(coder.encode(vectors), asked, 200, None, 0).count() == 200 * asked.count()
    assert coder.search(coder.encode(vectors), vectors, asked, 10, rerank=20).count() == 10 * asked.count()


def test_edges_that_cannot_enter_a_full_list_are_not_given(spark):
    rows = [(1, "a", [1.0, 0.0], True, 0.9), (1, "b", [1.0, 1.0], True, -2.0), (1, "c", [1.0, 0.1], True, -2.0)]
    groups = spark.createDataFrame(rows, "grp int, node string, embedding array<float>, fresh boolean, worst double")
    assert {(r.src, r.dst) for r in _compare(groups, 2, 2).collect()} == {("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")}
