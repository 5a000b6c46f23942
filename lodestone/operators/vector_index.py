"""Vector search over a table of vectors (vec_id, embedding, segment columns).

Queries are a stated set: they are read in blocks of ``BROADCAST_QUERIES`` vectors,
each sent to every task.  A scan of the vectors meets all blocks, one at a time in
memory, as a matrix product for each Arrow batch; a task keeps its own best k for
each query, so what is shuffled doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..shipping import ship

BROADCAST_QUERIES = 4096
#: Hits of ``Cells`` that a task holds for each query before it drops the worse ones.
_SLACK = 4
#: Scores that a task computes at a time, and hits that it holds before it hands them on.
_AT_ONCE, _HELD = 1 << 20, 1 << 21

#: Direction in which each metric ranks: True if larger is nearer.
METRICS = {"cosine": True, "inner_product": True, "l2": False}


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    return {"cosine": lambda: V.dot(V.normalise(a), V.normalise(b)), "inner_product": lambda: V.dot(a, b), "l2": lambda: V.squared_distance(a, b)}[metric]()


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``width`` numbers, and these vectors as rows."""
    lengths = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == width)
    chosen = values if len(places) == len(values) else values.take(pa.array(places))
    return places, chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), width)


def _products(rows: np.ndarray, asked: np.ndarray, metric: str) -> np.ndarray:
    """Scores of every row against every query."""
    if metric == "cosine":
        return _unit(rows) @ _unit(asked).T
    if metric == "inner_product":
        return rows @ asked.T
    return np.maximum((rows * rows).sum(1)[:, None] + (asked * asked).sum(1)[None, :] - 2 * (rows @ asked.T), 0.0)


def _query_blocks(queries: DataFrame) -> list[Broadcast]:
    """Ids and matrices of at most ``BROADCAST_QUERIES`` queries of one width each;
    the driver holds a block at a time."""
    context, id_type = queries.sparkSession.sparkContext, queries.schema["query_id"].dataType
    rows = queries.where("query_id IS NOT NULL AND size(embedding) > 0").select("query_id", "embedding")
    out: list[Broadcast] = []
    held: dict[int, tuple[list, list]] = {}

    def close(width: int) -> None:
        ids, vectors = held.pop(width)
        out.append(context.broadcast((pa.array(ids, pa.int64() if isinstance(id_type, (T.LongType, T.IntegerType)) else pa.string()), np.array(vectors, np.float64))))

    for row in rows.toLocalIterator():
        ids, vectors = held.setdefault(len(row.embedding), ([], []))
        ids.append(row.query_id)
        vectors.append(row.embedding)
        if len(ids) == BROADCAST_QUERIES:
            close(len(row.embedding))
    for width in list(held):
        close(width)
    return out


def _block_of(shared: Broadcast, blocks: list[Broadcast]) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a block; where there are several, a worker keeps one at a time."""
    value = shared.value
    if len(blocks) > 1:
        shared.__dict__.pop("_value", None)
    return value


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers in the order of the column's values, null first."""
    values = column.to_numpy(zero_copy_only=False) if column.null_count == 0 else np.array([("",) if x is None else (" ", x) for x in column.to_pylist()], object)
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def _best(hits: pa.Table, k: int, larger: bool, by: list[str]) -> pa.Table:
    """The first k hits of each query (and each value of ``by``)."""
    keys = [_codes(hits.column(c).combine_chunks()) for c in ("query_id", *by)]
    values = hits.column("score").to_numpy()
    order = np.lexsort((_codes(hits.column("vec_id").combine_chunks()), -values if larger else values, *reversed(keys)))
    group = np.column_stack([x[order] for x in keys])
    first = np.concatenate(([True], (group[1:] != group[:-1]).any(1)))[: len(order)]
    begins = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return hits.take(pa.array(order[np.arange(len(order)) - begins < k]))


class _Held:
    """The best ``k`` hits of each query (and each value of ``by``) that a task has met, for
    each block of queries; hits are tables whose ``query_id`` is a place in the block.

    Hits beyond ``_HELD`` are handed on, so what is held depends neither on the number of
    queries nor on that of vectors.  The k-th best scores (``limits``) stay, and what is
    worse than them isn't held at all.
    """

    def __init__(self, k: int, larger: bool, by: list[str] | None = None):
        self.k, self.larger, self.by = k, larger, by or []
        self.tables: dict[int, tuple[pa.Array, pa.Table]] = {}
        #: Hits of a block when its worse ones were dropped last.
        self.kept: dict[int, int] = {}
        self.limits: dict[tuple, np.ndarray] = {}

    def wanted(self, block: int, scores: np.ndarray, group: tuple = ()) -> np.ndarray:
        """Which scores, of rows against all queries of a block, can be among the best; those
        that aren't finite can't."""
        limit = self.limits.get((block, *group))
        if limit is None:
            return np.isfinite(scores) & _near(scores, self.k, self.larger)
        good = scores >= limit if self.larger else scores <= limit
        return good if np.isfinite(limit).all() else good & np.isfinite(scores) & _near(scores, self.k, self.larger)

    def add(self, block: int, ids: pa.Array, hits: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(hits):
            return
        both = pa.concat_tables([self.tables[block][1], hits]) if block in self.tables else hits
        if len(both) > _AT_ONCE // 4 + 2 * self.kept.get(block, 0):
            both = self._dropped(block, len(ids), both)
        self.tables[block] = (ids, both)
        if sum(len(table) for _, table in self.tables.values()) > _HELD:
            yield from self.rest()

    def _dropped(self, block: int, asked: int, hits: pa.Table) -> pa.Table:
        """The best of ``hits``; their worst scores become the limits."""
        best = _best(hits, self.k, self.larger, self.by)
        self.kept[block] = len(best)
        query, scores = best.column("query_id").to_numpy(), best.column("score").to_numpy()
        groups = list(zip(*[best.column(c).to_pylist() for c in self.by], strict=True)) if self.by else [()] * len(best)
        names = {g: n for n, g in enumerate(dict.fromkeys(groups))}
        if len(names) * asked > _AT_ONCE:
            return best
        # The hits of a query and group follow each other, the best first.
        of = query * len(names) + np.fromiter((names[g] for g in groups), np.int64, len(groups))
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
        full = last[np.diff(np.append(-1, last)) == self.k]
        worst = np.full(asked * len(names), -np.inf if self.larger else np.inf)
        worst[of[full]] = scores[full]
        for g, n in names.items():
            self.limits[(block, *g)] = worst[n :: len(names)].copy()
        return best

    def rest(self) -> Iterator[pa.RecordBatch]:
        for ids, table in self.tables.values():
            best = _best(table, self.k, self.larger, self.by)
            yield from best.set_column(0, "query_id", ids.take(best.column("query_id").combine_chunks())).combine_chunks().to_batches()
        self.tables, self.kept = {}, {}


def _pieces(count: int, asked: int) -> list[slice]:
    """Parts of ``count`` rows whose scores against ``asked`` queries are ``_AT_ONCE`` at most."""
    size = max(1, _AT_ONCE // max(asked, 1))
    return [slice(a, a + size) for a in range(0, count, size)]


def _near(scores: np.ndarray, k: int, larger: bool) -> np.ndarray:
    """What reaches the k-th place in its column: the rest can't be among the best."""
    if len(scores) <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if larger else np.partition(scores, k - 1, axis=0)[k - 1]
    return scores >= least if larger else scores <= least


def _scan(vectors: DataFrame, queries: DataFrame, metric: str, round_to: int, keep: Callable[[np.ndarray], np.ndarray] | None = None, k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """query_id, the columns of ``vectors`` but the embedding, score, for the pairs that
    ``keep`` selects in a matrix of scores; with ``k``, those that can be among the k nearest
    of a query (and each value of ``by``), a task's best only.

    Vectors without a query of their width have no score and give no row.
    """
    ship(vectors.sparkSession)
    blocks, larger, by = _query_blocks(queries), METRICS[metric], by or []
    body = vectors.select("embedding", *[c for c in vectors.columns if c != "embedding"])
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), *body.schema.fields[1:], T.StructField("score", T.DoubleType())]
    names = [f.name for f in fields]

    def grouped(batch: pa.RecordBatch, places: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
        """Rows by their values of ``by``, as places in ``places``."""
        if not by:
            return [((), np.arange(len(places)))]
        values: dict[tuple, list[int]] = {}
        for n, value in enumerate(zip(*[batch.column(c).take(pa.array(places)).to_pylist() for c in by], strict=True)):
            values.setdefault(value, []).append(n)
        return [(value, np.array(at)) for value, at in values.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(k or 0, larger, by)
        for batch in batches:
            for n, shared in enumerate(blocks):
                ids, asked = _block_of(shared, blocks)
                places, rows = _matrix(batch.column(0), asked.shape[1])
                for group, members in grouped(batch, places):
                    for part in _pieces(len(members), len(asked)):
                        scores = np.round(_products(rows[members[part]], asked, metric), round_to) + 0.0
                        wanted = np.ones(scores.shape, bool) if k is None else held.wanted(n, scores, group)
                        at, q = np.nonzero(wanted & keep(scores) if keep else wanted)
                        columns = batch.take(pa.array(places[members[part][at]])).columns[1:]
                        if k is None:
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *columns, pa.array(scores[at, q])], names)
                        else:
                            yield from held.add(n, ids, pa.table([pa.array(q), *columns, pa.array(scores[at, q])], names=names))
        yield from held.rest()

    return body.mapInArrow(run, T.StructType(fields))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", by: list[str] | None = None, round_to: int = 6) -> DataFrame:
    """query_id, the columns of ``vectors`` but the embedding, score, rank: the k
    nearest for each query (and each value of ``by``); ties go to the smaller id."""
    larger, places = METRICS[metric], by or []
    order = F.desc("score") if larger else F.asc("score")
    window = Window.partitionBy("query_id", *places).orderBy(order, "vec_id")
    return _scan(vectors, queries, metric, round_to, k=k, by=places).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def merge_segments(hits: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """The best k of each query over hits of many segments."""
    order = F.desc("score") if METRICS[metric] else F.asc("score")
    window = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """All vectors within a radius (or above a similarity) of each query."""
    return _scan(vectors, queries, metric, 6, (lambda s: s >= radius) if METRICS[metric] else (lambda s: s <= radius))


def without(vectors: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Vectors that are not deleted; applied before scoring."""
    return vectors.join(tombstones.select("vec_id").distinct(), "vec_id", "left_anti")


def upsert(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Vectors with changed ones replaced and new ones added: the last write wins."""
    return vectors.join(changes.select("vec_id"), "vec_id", "left_anti").unionByName(changes.select(vectors.columns))


def merge_two_way(cache: DataFrame, dump: DataFrame, k: int) -> DataFrame:
    """Two lists of (query_id, vec_id, distance) merged by distance, ties to ``dump``."""
    both = dump.withColumn("source_rank", F.lit(0)).unionByName(cache.withColumn("source_rank", F.lit(1)))
    window = Window.partitionBy("query_id").orderBy("distance", "source_rank", "vec_id")
    return both.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def statistics(vectors: DataFrame, segment: str = "label") -> DataFrame:
    """Count, dimension, id range and memory estimate of each segment."""
    d = F.max(F.size("embedding"))
    return vectors.groupBy(segment).agg(
        F.count("*").alias("vectors"), d.cast("int").alias("dimension"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"),
        (F.count("*") * d * 4 + F.count("*") * 8).cast("long").alias("memory_bytes"),
    )


def consistent(vectors: DataFrame, segment: str = "label") -> DataFrame:
    """Segments with a single dimension above zero and ids that don't repeat."""
    return vectors.groupBy(segment).agg(((F.min(F.size("embedding")) == F.max(F.size("embedding"))) & (F.min(F.size("embedding")) > 0) & (F.count("*") == F.count_distinct("vec_id"))).alias("consistent"))


def _centres(rows: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centres of some rows."""
    if not len(rows):
        return np.zeros((1, rows.shape[1] if rows.ndim == 2 else 0))
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(count, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = _products(rows, centres, "l2").argmin(1)
        order, sizes = np.argsort(nearest, kind="stable"), np.bincount(nearest, minlength=len(centres))
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums = np.add.reduceat(rows[order], np.minimum(begins, len(rows) - 1), axis=0)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _sampled(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` unit vectors, those with the least hashes of their ids."""
    sample = vectors.where("size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toArrow()
    values = sample.column(0).combine_chunks()
    width = int(values.value_lengths()[0].as_py()) if len(values) else 0
    return _unit(_matrix(values, width)[1]) if width else np.zeros((0, 0))


class InvertedIndex:
    """Cells of k-means centres; a search reads the ``probes`` nearest cells only.

    The centres are fitted on a bounded sample (``sample_rows``); every vector is
    assigned to its nearest centre.
    """

    def __init__(self, cells: int = 16, sample_rows: int = 20_000, rounds: int = 15, seed: int = 7):
        self.cells, self.sample_rows, self.rounds, self.seed, self.centres = cells, sample_rows, rounds, seed, np.zeros((1, 0))

    def fit(self, vectors: DataFrame) -> InvertedIndex:
        self.centres = _centres(_sampled(vectors, self.sample_rows), self.cells, self.rounds, self.seed)
        return self

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with their cell; write it partitioned by cell to prune searches."""
        ship(vectors.sparkSession)
        centres, body = self.centres, vectors.select("embedding", *[c for c in vectors.columns if c != "embedding"])
        schema = T.StructType([*body.schema.fields, T.StructField("cell", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, rows = _matrix(batch.column(0), centres.shape[1])
                cells = _products(_unit(rows), centres, "l2").argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(places)).columns, pa.array(cells)], schema.names)

        return body.mapInArrow(run, schema).select(*vectors.columns, "cell")

    def search(self, assigned: DataFrame, queries: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
        """query_id, vec_id, score, rank: nearest by cosine among the probed cells."""
        blocks, centres = _query_blocks(queries), self.centres
        fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", assigned.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(k, True)
            for batch in batches:
                places, rows = _matrix(batch.column(1), centres.shape[1])
                cells = batch.column(2).to_numpy()[places]
                for n, shared in enumerate(blocks):
                    ids, asked = _block_of(shared, blocks)
                    if asked.shape[1] != centres.shape[1]:
                        continue
                    order = np.argsort(_products(_unit(asked), centres, "l2"), axis=1)[:, :probes]
                    for cell in np.unique(cells):
                        q, inside = np.flatnonzero((order == cell).any(1)), np.flatnonzero(cells == cell)
                        for part in _pieces(len(inside), len(q)):
                            scores = np.round(_products(rows[inside[part]], asked[q], "cosine"), 6) + 0.0
                            at, to = np.nonzero(_near(scores, k, True))
                            yield from held.add(n, ids, pa.table([pa.array(q[to]), batch.column(0).take(pa.array(places[inside[part][at]])), pa.array(scores[at, to])], names=[f.name for f in fields]))
            yield from held.rest()

        return merge_segments(assigned.select("vec_id", "embedding", "cell").mapInArrow(run, T.StructType(fields)), k)


def blocks(queries: DataFrame, size: int = BROADCAST_QUERIES) -> list[DataFrame]:
    """The query set in parts of ``size`` rows at most, by their places in the order of ids."""
    n = queries.count()
    if n <= size:
        return [queries]
    cuts = [r.query_id for r in queries.select("query_id").orderBy("query_id").withColumn("n", F.monotonically_increasing_id()).toLocalIterator()][::size]
    return [queries.where((F.col("query_id") >= a) & (F.lit(True) if b is None else F.col("query_id") < b)) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def _directions(d: int, tables: int, bits: int, seed: int) -> list[list[list[float]]]:
    import random

    rng = random.Random(seed)
    return [[[rng.gauss(0, 1) for _ in range(d)] for _ in range(bits)] for _ in range(tables)]


def _dimension(vectors: DataFrame) -> int:
    return vectors.select(F.max(F.size("embedding"))).first()[0] or 0


def lsh_candidates(vectors: DataFrame, tables: int = 8, bits: int = 8, seed: int = 7) -> DataFrame:
    """vec_id, table, bucket: signs of projections on rule-made directions."""
    hashed = [
        F.struct(F.lit(t).alias("table"), F.concat(*[F.when(V.dot(F.col("embedding"), F.array(*[F.lit(x) for x in w])) >= 0, "1").otherwise("0") for w in planes]).alias("bucket"))
        for t, planes in enumerate(_directions(_dimension(vectors), tables, bits, seed))
    ]
    return vectors.select("vec_id", "embedding", F.explode(F.array(*hashed)).alias("h")).select("vec_id", "embedding", "h.table", "h.bucket")


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, bits: int = 8, flips: int = 2, seed: int = 7) -> DataFrame:
    """query_id, vec_id, score, rank: nearest by cosine among the vectors that share a
    bucket with the query, or a bucket whose signs differ in at most ``flips`` places.

    A batch of vectors meets a block of queries at a time: for each table, the rows of a
    bucket are marked against the queries that probe it, and what is marked is scored
    once.  Vectors and queries of another width than the widest have no bucket.
    """
    ship(vectors.sparkSession)
    asked_blocks, width = _query_blocks(queries), _dimension(vectors)
    planes = np.array(_directions(width, tables, bits, seed)).reshape(tables * bits, width)
    close = np.array([n.bit_count() <= flips for n in range(1 << bits)])
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())]

    def coded(rows: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table, as a number."""
        signs = (rows @ planes.T >= 0).reshape(len(rows), tables, bits)
        return signs @ (1 << np.arange(bits)[::-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(k, True)
        for batch in batches:
            places, rows = _matrix(batch.column(1), width)
            rows, codes = _unit(rows), coded(rows)
            for n, shared in enumerate(asked_blocks):
                ids, asked = _block_of(shared, asked_blocks)
                if asked.shape[1] != width or not len(rows):
                    continue
                probed = coded(asked)
                asked = _unit(asked)
                buckets = [np.unique(codes[:, t], return_inverse=True) for t in range(tables)]
                probes = [close[bucket[:, None] ^ probed[None, :, t]] for t, (bucket, _) in enumerate(buckets)]
                for part in _pieces(len(rows), len(asked)):
                    marked = np.zeros((len(rows[part]), len(asked)), bool)
                    for (_, of), near in zip(buckets, probes, strict=True):
                        marked |= near[of[part]]
                    scores = np.where(marked, np.round(rows[part] @ asked.T, 6) + 0.0, -np.inf)
                    at, q = np.nonzero(held.wanted(n, scores))
                    yield from held.add(n, ids, pa.table([pa.array(q), batch.column(0).take(pa.array(places[part][at])), pa.array(scores[at, q])], names=[f.name for f in fields]))
        yield from held.rest()

    return merge_segments(vectors.select("vec_id", "embedding").mapInArrow(run, T.StructType(fields)), k)


class ProductQuantizer:
    """Codes of ``parts`` bytes for each vector, one for the nearest of ``centres`` in
    each part of it.  A search ranks by the distances of codes and scores the best
    ``rerank * k`` of each query again, exactly.

    The centres are fitted on a bounded sample (``sample_rows``); every vector is coded.
    """

    def __init__(self, parts: int = 16, centres: int = 64, sample_rows: int = 20_000, rounds: int = 12, seed: int = 7):
        self.parts, self.centres, self.sample_rows, self.rounds, self.seed = parts, centres, sample_rows, rounds, seed
        self.books: list[np.ndarray] = []

    def fit(self, vectors: DataFrame) -> ProductQuantizer:
        rows = _sampled(vectors, self.sample_rows)
        self.books = [_centres(part, self.centres, self.rounds, self.seed) for part in np.array_split(rows, self.parts, axis=1)]
        return self

    def _parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(_unit(rows), self.parts, axis=1)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with ``code``, a byte for each part, in place of the embedding."""
        ship(vectors.sparkSession)
        body = vectors.select("embedding", *[c for c in vectors.columns if c != "embedding"])
        schema = T.StructType([*body.schema.fields[1:], T.StructField("code", T.BinaryType())])
        books, split, width = self.books, self._parts, sum(b.shape[1] for b in self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, rows = _matrix(batch.column(0), width)
                codes = np.column_stack([_products(p, b, "l2").argmin(1) for p, b in zip(split(rows), books, strict=True)]).astype(np.uint8)
                kept = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array([c.tobytes() for c in codes], pa.binary())], schema.names)

        return body.mapInArrow(run, schema)

    def search(self, coded: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = 10, cells: InvertedIndex | None = None, probes: int = 4) -> DataFrame:
        """query_id, vec_id, score, rank by cosine; ``coded`` is the index of ``vectors``.

        With ``cells`` (and their column ``cell`` in ``coded``) a query meets the codes of
        its ``probes`` nearest cells only.
        """
        most = k * rerank
        near = merge_segments(self._nearest_codes(coded, queries, most, cells, probes), most, "l2").select("query_id", "vec_id")
        exact = near.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", F.col("embedding").alias("query")), "query_id")
        return merge_segments(exact.select("query_id", "vec_id", F.round(score(F.col("embedding"), F.col("query")), 6).alias("score")), k)

    def _nearest_codes(self, coded: DataFrame, queries: DataFrame, most: int, cells: InvertedIndex | None, probes: int) -> DataFrame:
        """query_id, vec_id, score: of each task's codes the ``most`` nearest to each query."""
        blocks, books, split = _query_blocks(queries), self.books, self._parts
        centres = None if cells is None else cells.centres
        fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", coded.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(most, False)
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books))
                for block, shared in enumerate(blocks):
                    ids, asked = _block_of(shared, blocks)
                    if asked.shape[1] != sum(b.shape[1] for b in books):
                        continue
                    tables = [_products(b, q, "l2") for b, q in zip(books, split(asked), strict=True)]
                    near = None
                    if centres is not None:
                        near = np.zeros((len(centres), len(asked)), bool)
                        np.put_along_axis(near, np.argsort(_products(_unit(asked), centres, "l2"), axis=1)[:, :probes].T, True, axis=0)
                    for part in _pieces(len(codes), len(asked)):
                        distances = np.zeros((len(codes[part]), len(asked)))
                        for n, table in enumerate(tables):
                            distances += table[codes[part, n]]
                        if near is not None:
                            distances[~near[batch.column(2).to_numpy()[part]]] = np.inf
                        at, q = np.nonzero(held.wanted(block, distances))
                        hits = pa.table([pa.array(q), batch.column(0).slice(part.start, len(distances)).take(pa.array(at)), pa.array(distances[at, q])], names=[f.name for f in fields])
                        yield from held.add(block, ids, hits)
            yield from held.rest()

        return coded.select("vec_id", "code", *(["cell"] if cells is not None else [])).mapInArrow(run, T.StructType(fields))


def read_segments(spark: SparkSession, path: str, segments: list[int] | None = None) -> DataFrame:
    """Vectors of a dataset partitioned by ``index_id``; other segments are not read."""
    rows = spark.read.parquet(path)
    return rows if segments is None else rows.where(F.col("index_id").isin(segments))


def write_segments(vectors: DataFrame, path: str, segment: str = "label", mode: str = "overwrite") -> None:
    vectors.withColumn("index_id", F.col(segment)).repartition("index_id").write.mode(mode).partitionBy("index_id").parquet(path)


def search_by(kind: str, vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = 8, probes: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank by an index of one of the advisor's types; a
    graph (HNSW) is one of nearest neighbours without layers (``graph_index``)."""
    from .graph_index import GraphIndex

    body = vectors.select("vec_id", "embedding")
    if kind == "Flat":
        return top_k(body, queries, k)
    if kind == "PQ":
        coder = ProductQuantizer().fit(body)
        return coder.search(coder.encode(body), body, queries, k)
    if kind == "HNSW":
        return GraphIndex().fit(body).search(queries, k)
    index = InvertedIndex(cells).fit(body)
    if kind == "IVF":
        return index.search(index.assign(body), queries, k, probes)
    if kind != "IVFPQ":
        raise ValueError(f"unknown index type {kind!r}")
    coder = ProductQuantizer().fit(body)
    return coder.search(coder.encode(index.assign(body)), body, queries, k, cells=index, probes=probes)


def added(vectors: DataFrame, batch: DataFrame, dimension: int) -> DataFrame:
    """``vectors`` and the unit vectors of a batch: those with ``dimension`` numbers whose
    ids are neither there nor earlier in the batch's order of hashes."""
    good = batch.where(V.valid(F.col("embedding"), dimension)).dropDuplicates(["vec_id"])
    fresh = good.join(vectors.select("vec_id"), "vec_id", "left_anti")
    return vectors.unionByName(fresh.withColumn("embedding", V.normalise(F.col("embedding")).cast(vectors.schema["embedding"].dataType)).select(*vectors.columns))


def numbered_after(batch: DataFrame, order: str, last: int) -> DataFrame:
    """The rows of a batch of checked size with ``int_id`` from ``last + 1`` on, in order:
    the positions that an index appends them at."""
    return batch.withColumn("int_id", F.row_number().over(Window.orderBy(order)) + F.lit(last))


def segments(spark: SparkSession, path: str) -> list[int]:
    """The indexes of a dataset, from its partitions alone."""
    return sorted(r.index_id for r in spark.read.parquet(path).select("index_id").distinct().collect())


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder with its files; whether it was there."""
    target, files = _place(spark, path)
    return bool(files.delete(target, True))


def drop_segment(spark: SparkSession, path: str, segment: int) -> bool:
    """Delete an index with its files; whether it was there."""
    return drop_folder(spark, f"{path}/index_id={segment}")


def rebuild_segment(vectors: DataFrame, path: str, segment: int) -> None:
    """Replace an index by ``vectors``; the other indexes stay as they are."""
    vectors.drop("index_id").write.mode("overwrite").parquet(f"{path}/index_id={segment}")
