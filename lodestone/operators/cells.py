"""Cells of vectors (an inverted file), trained on all vectors and searched by probes.

Training is k-means|| with cosine: a few rounds pick some ``cells`` candidates each, vectors
far from all candidates so far with a higher chance; the candidates, weighted by how many
vectors are nearest to each, are reduced to ``cells`` centres, which all vectors then move in
``iterations`` passes.  A pass sums in its tasks: what is shuffled is one row for each task and
cell, and what reaches the driver is one row for each cell.  Centres and candidates are
bounded by ``cells``, 4,096 at most, and are all that is broadcast beside a block of queries.

Each vector is kept in its ``copies`` nearest cells (a second copy costs as much as the probes
it saves, on the vectors measured), in a table sorted by cell, so a search of
few cells skips the rest by the row groups' statistics, and a large cell is many files.  How
many cells a search probes is measured: ``tuned`` searches a bounded sample of vectors exactly
and takes the least number of probes that finds the wanted share of their neighbours.

Defined results: vectors that are null, empty, zero, of another width than the widest or with a
null or a number that isn't finite, and rows without id, are not indexed; queries like these
get no row; rows of one id are one, with the least vector; repeated queries are one; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..shipping import ship
from .steps import Steps
from .vector_index import _SLACK, BROADCAST_QUERIES, _best, _matrix, _unit, blocks, merge_segments, top_k

#: Most centres, as the advisor has it; candidates, their weights and a block's probes follow from it.
MOST_CELLS = 4096
#: Rows that are compared with all centres at a time.
_SLICE = 1024


def _order(rows: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest centres of each row, the nearest first."""
    out = np.empty((len(rows), count), np.int32)
    for a in range(0, len(rows), _SLICE):
        near = -(rows[a : a + _SLICE] @ centres.T)
        out[a : a + _SLICE] = near.argmin(1)[:, None] if count == 1 else np.argsort(near, axis=1, kind="stable")[:, :count]
    return out


def _spread(rows: np.ndarray, weights: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` centres of weighted rows: seeds far from each other, then k-means."""
    if len(rows) <= count:
        return rows
    rng = np.random.default_rng(seed)
    centres = rows[[int(weights.argmax())]]
    far = np.maximum(2 - 2 * rows @ centres[0], 0)
    while len(centres) < count and (far * weights).sum() > 1e-9:
        n = rng.choice(len(rows), p=far * weights / (far * weights).sum())
        centres, far = np.vstack([centres, rows[n]]), np.minimum(far, np.maximum(2 - 2 * rows @ rows[n], 0))
    for _ in range(5):
        cell, total = _order(rows, centres, 1)[:, 0], np.zeros_like(centres)
        np.add.at(total, cell, rows * weights[:, None])
        centres = _moved(centres, total)
    return centres


def _moved(centres: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Centres in the direction of their members' sums; those without members stay."""
    return np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-9, _unit(total), centres)


class Cells:
    """An inverted file of ``cells`` cells; see the module's text."""

    def __init__(self, cells: int, copies: int = 1, rounds: int = 3, iterations: int = 6, seed: int = 7):
        self.cells, self.rounds, self.iterations, self.seed = min(max(cells, 1), MOST_CELLS), rounds, iterations, seed
        self.copies, self.probes = copies, self.cells

    def fit(self, vectors: DataFrame) -> Cells:
        """Train on, and index, every usable row of ``vectors`` (vec_id, embedding)."""
        ship(vectors.sparkSession)
        self.steps = Steps(vectors.sparkSession, "cells")
        self.width = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
        good = vectors.where(F.col("vec_id").isNotNull() & V.usable(F.col("embedding"), self.width))
        self.rows = self.steps.save(good.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
        self.centres = self._train()
        self.copies = min(self.copies, len(self.centres))
        self.table = self.steps.save(self._assigned().repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell"), "cells")
        held = {r["cell"]: r["count"] for r in self.table.groupBy("cell").count().collect()}
        self.sizes = np.array([held.get(n, 0) for n in range(len(self.centres))])
        return self

    def _units(self, rows: DataFrame) -> np.ndarray:
        """The unit vectors of a table of bounded size."""
        values = rows.select("embedding").toArrow().column(0).combine_chunks()
        return _unit(_matrix(values, self.width)[1])

    def _train(self) -> np.ndarray:
        chosen = self._units(self.rows.orderBy(F.xxhash64("vec_id", F.lit(self.seed)), "vec_id").limit(1))
        if not len(chosen):
            return chosen
        for n in range(self.rounds):
            cost = self._sums(chosen, False)[1].sum()
            if cost <= 1e-9:  # every vector is a candidate already
                break
            chosen = np.vstack([chosen, self._units(self._picked(chosen, self.cells / cost, n))])
        centres = _spread(chosen, self._sums(chosen, False)[0], self.cells, self.seed)
        for _ in range(self.iterations):
            centres = _moved(centres, self._sums(centres)[2])
        return centres

    def _picked(self, chosen: np.ndarray, factor: float, n: int) -> DataFrame:
        """Vectors picked with a chance of ``factor`` times their squared distance to the
        nearest of ``chosen``; the chance is drawn from the id, so a lost task picks the same."""
        shared, width = self.rows.sparkSession.sparkContext.broadcast(chosen), self.width
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(self.seed + 1 + n)), F.lit(1 << 53)) / F.lit(float(1 << 53))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _unit(_matrix(batch.column(0), width)[1])
                near = _order(rows, shared.value, 1)[:, 0]
                far = np.maximum(2 - 2 * np.einsum("ij,ij->i", rows, shared.value[near]), 0)
                yield batch.filter(pa.array(batch.column(1).to_numpy() < factor * far))

        rows = self.rows.select("embedding", drawn.alias("drawn"))
        saved = self.steps.save(rows.mapInArrow(run, rows.schema), f"picked-{n}")
        shared.destroy()
        return saved

    def _sums(self, centres: np.ndarray, totals: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each centre, of the vectors nearest to it: their number, the sum of their squared
        distances, and (with ``totals``) their sum."""
        shared, width = self.rows.sparkSession.sparkContext.broadcast(centres), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(shared.value)
            count, cost, total = np.zeros(size), np.zeros(size), np.zeros((size, width if totals else 0))
            for batch in batches:
                rows = _unit(_matrix(batch.column(0), width)[1])
                near = _order(rows, shared.value, 1)[:, 0]
                count += np.bincount(near, minlength=size)
                cost += np.bincount(near, np.maximum(2 - 2 * np.einsum("ij,ij->i", rows, shared.value[near]), 0), size)
                if totals:
                    np.add.at(total, near, rows)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int32()), "count": count[used], "cost": cost[used], "total": pa.array(list(total[used]), pa.list_(pa.float64()))})

        def add(part: pa.Table) -> pa.Table:
            # Sorted sums don't depend on the order in which tasks' rows arrive.
            total = np.sort(np.array(part["total"].to_pylist()).reshape(len(part), -1), axis=0).sum(0)
            sums = [[float(np.sort(part[c].to_numpy()).sum())] for c in ("count", "cost")]
            return pa.table({"cell": part["cell"].slice(0, 1), "count": sums[0], "cost": sums[1], "total": pa.array([total], pa.list_(pa.float64()))})

        schema = "cell int, count double, cost double, total array<double>"
        parts = self.rows.select("embedding").mapInArrow(run, schema).groupBy("cell").applyInArrow(add, schema).collect()
        shared.destroy()
        count, cost, total = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros((len(centres), self.width if totals else 0))
        for r in parts:
            count[r["cell"]], cost[r["cell"]], total[r["cell"]] = r["count"], r["cost"], r["total"]
        return count, cost, total

    def _assigned(self) -> DataFrame:
        """cell, vec_id, embedding: each vector in its nearest cells."""
        centres, width, copies = self.rows.sparkSession.sparkContext.broadcast(self.centres), self.width, self.copies
        rows = self.rows.select("embedding", "vec_id")
        schema = T.StructType([T.StructField("cell", T.IntegerType()), rows.schema["vec_id"], rows.schema["embedding"]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _order(_unit(_matrix(batch.column(0), width)[1]), centres.value, copies)
                again = batch.take(pa.array(np.repeat(np.arange(len(near)), copies)))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1)), again.column(1), again.column(0)], schema.names)

        return rows.mapInArrow(run, schema)

    def tuned(self, recall: float = 0.95, k: int = 10, asked: int = 256) -> Cells:
        """Set ``probes`` to the least number that finds ``recall`` of the ``k`` nearest
        others of ``asked`` vectors of the index, compared with all vectors."""
        if not len(self.centres):
            return self
        sample = self.steps.save(self.rows.orderBy(F.xxhash64("vec_id", F.lit(self.seed)), "vec_id").limit(asked).select(F.col("vec_id").alias("query_id"), "embedding"), "sample")
        hits = top_k(self.rows, sample, k + 1).where("query_id <> vec_id").select("query_id", "vec_id")
        cells = hits.join(self.table.select("vec_id", "cell"), "vec_id").groupBy("query_id", "vec_id").agg(F.collect_list("cell").alias("cells")).collect()
        held = sample.collect()
        order = _order(_unit(np.array([r.embedding for r in held], float)), self.centres, len(self.centres))
        places = {r.query_id: np.argsort(o) for r, o in zip(held, order, strict=True)}
        needed = sorted(min(places[r.query_id][c] for c in r.cells) + 1 for r in cells)
        self.probes = int(needed[math.ceil(recall * len(needed)) - 1]) if needed else len(self.centres)
        return self

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, dead: DataFrame | None = None) -> DataFrame:
        """query_id, vec_id, score, rank: the k nearest by cosine in the probed cells.

        ``dead`` (vec_id) are left out before scoring.  ``read`` is then the number of
        rows that a query meets, on average, as a share of the vectors.
        """
        good = queries.where(F.col("query_id").isNotNull() & V.usable(F.col("embedding"), self.width))
        asked = self.steps.save(good.groupBy("query_id").agg(F.min("embedding").alias("embedding")), "queries")
        table = self.table if dead is None else self.table.join(dead.select("vec_id").distinct(), "vec_id", "left_anti")
        probes, met, found = min(probes or self.probes, len(self.centres)), [], []
        for n, part in enumerate(blocks(asked, BROADCAST_QUERIES)):
            hits, rows = self._block(table, part, k, probes, f"hits-{n}")
            met.append(rows)
            found.append(hits)
        self.read = float(np.concatenate(met).mean() * self.copies / max(self.sizes.sum(), 1)) if any(map(len, met)) else 0.0
        return merge_segments(reduce(DataFrame.unionByName, found), k)

    def _block(self, table: DataFrame, part: DataFrame, k: int, probes: int, name: str) -> tuple[DataFrame, np.ndarray]:
        """Hits of a block of queries as a table, and how many rows of the index each of them meets."""
        held = part.select("query_id", "embedding").toArrow()
        rows = _unit(_matrix(held["embedding"].combine_chunks(), self.width)[1]) if len(held) else np.zeros((0, self.width))
        near = np.zeros((len(rows), len(self.centres)), bool)
        if len(rows) and probes:
            np.put_along_axis(near, _order(rows, self.centres, probes), True, axis=1)
        wanted = np.flatnonzero(near.any(0))
        if len(wanted) < len(self.centres):
            table = table.where(F.col("cell").isin(wanted.tolist()))
        shared, width, most = part.sparkSession.sparkContext.broadcast((held["query_id"].combine_chunks(), rows, near)), self.width, k * max(self.copies, 1)
        schema = T.StructType([T.StructField("query_id", part.schema["query_id"].dataType), T.StructField("vec_id", table.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, near = shared.value
            kept: list[pa.Table] = []
            for batch in batches:
                cells, body = batch.column(0).to_numpy(), _unit(_matrix(batch.column(2), width)[1])
                for cell in np.unique(cells):
                    q, inside = np.flatnonzero(near[:, cell]), np.flatnonzero(cells == cell)
                    scores = np.round(body[inside] @ asked[q].T, 6) + 0.0
                    least = np.partition(scores, len(inside) - k, axis=0)[len(inside) - k] if len(inside) > k else -np.inf
                    at, to = np.nonzero(scores >= least)
                    kept.append(pa.table([ids.take(pa.array(q[to])), batch.column(1).take(pa.array(inside[at])), pa.array(scores[at, to])], names=schema.names))
                if sum(map(len, kept)) > _SLACK * most * BROADCAST_QUERIES:
                    kept = [_best(pa.concat_tables(kept), most, True, [])]
            if kept:
                yield from _best(pa.concat_tables(kept), most, True, []).combine_chunks().to_batches()

        hits = table.select("cell", "vec_id", "embedding").mapInArrow(run, schema)
        saved = self.steps.save(hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), name)
        shared.destroy()
        return saved, near @ self.sizes
