"""Nearest neighbours by a graph of vectors, built and searched by joins.

Building is NN-descent over an edge table (src, dst, score): groups of vectors that share a
hash give first edges; then, in rounds, the neighbours of each node (those that it names and
the nearest of those that name it) are compared with each other, because a neighbour's
neighbour is likely a neighbour.  Only pairs with an edge of the last round are compared, and
rounds end when few edges change.  A group holds ``2 * listed`` vectors at most, so no task
holds more; a node that many name is in many groups, and its rows go through joins with
plain exchanges, which adaptive execution splits.

A search is a beam: the best ``beam`` nodes of a query so far are its pool; each step joins
the best ``width`` that have not been followed yet to their adjacency, scores what the query
has not met, and keeps the best again.  Steps are bounded (``steps``), and end early when
every pool has been followed.  The first pools come from ``sqrt(n)`` entry nodes.

Nodes are distinct vectors: rows with equal vectors are members of one node, so a large group
of copies neither fills the lists of its neighbours nor cuts the graph.  All tables between
rounds are Parquet in the shared folder.

Defined results: vectors that are null, empty, of another width than the widest or with a
null or a number that isn't finite, and rows without id, are not indexed; queries like these
get no row; repeated rows are one; ties go to the smaller id; an empty table gives an empty
result; columns beyond vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shipping import ship
from .steps import Steps
from .vector_index import _matrix, _unit, merge_segments, score, top_k


def _compare(groups: DataFrame, degree: int, width: int) -> DataFrame:
    """src, dst, score: for each member of each group (``grp``, node, embedding, fresh, worst) its
    best ``degree`` others, among the pairs of which one is fresh; what is below the member's
    ``worst``, the last score of a list that is full, can't enter the list and isn't given."""
    ship(groups.sparkSession)
    rows = groups.groupBy("grp").agg(F.collect_list(F.struct("node", "fresh", "embedding", "worst")).alias("held")).where(F.size("held") > 1).select("held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, held = batch.column(0), batch.column(0).flatten()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            names = held.field("node").to_numpy(zero_copy_only=False)
            fresh = held.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            body = _matrix(held.field("embedding"), width)[1]
            worst = held.field("worst").to_numpy(zero_copy_only=False)
            src, dst, scores = [], [], []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                if not fresh[a:b].any():
                    continue
                members, first, of = np.unique(names[a:b].astype(str), return_index=True, return_inverse=True)
                new = np.bincount(of, fresh[a:b], len(members)) > 0  # a node can be there both ways
                rows = _unit(body[a:b][first])
                near = np.round(rows @ rows.T, 6) + 0.0
                near[~(new[:, None] | new[None, :])] = -np.inf
                np.fill_diagonal(near, -np.inf)
                order = np.argsort(-near, axis=1, kind="stable")[:, :degree]
                best = np.take_along_axis(near, order, axis=1)
                at, place = np.nonzero(np.isfinite(best) & (best >= worst[a:b][first][:, None]))
                src.extend(members[at].tolist())
                dst.extend(members[order[at, place]].tolist())
                scores.extend(best[at, place].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(scores, pa.float64())], ["src", "dst", "score"])

    return rows.mapInArrow(run, "src string, dst string, score double")


def _first(edges: DataFrame, of: str, other: str, count: int) -> DataFrame:
    """The ``count`` best edges of each node in the column ``of``."""
    window = Window.partitionBy(of).orderBy(F.desc("score"), other)
    return edges.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= count).drop("_n")


class GraphIndex:
    """A graph of ``degree`` nearest neighbours; see the module's text.

    While it is built, lists hold ``listed`` neighbours: with ``degree`` only, it would find
    too few of the nearest.  ``rounds`` bounds the building, which ends earlier when at most
    ``settled`` of all edges are new; ``starts`` is the number of groupings by hash.
    """

    def __init__(self, degree: int = 12, listed: int = 24, rounds: int = 12, settled: float = 0.005, starts: int = 2, seed: int = 7):
        self.degree, self.listed, self.rounds, self.settled, self.starts, self.seed = degree, max(listed, degree), rounds, settled, starts, seed

    def fit(self, vectors: DataFrame) -> GraphIndex:
        """Index every usable row of ``vectors`` (vec_id, embedding)."""
        self.steps = steps = Steps(vectors.sparkSession, "graph")
        self.width = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
        good = vectors.where(F.col("vec_id").isNotNull() & V.usable(F.col("embedding"), self.width))
        named = good.select(F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>"))).alias("node"), "vec_id", "embedding")
        self.members = steps.save(named.select("node", "vec_id").distinct(), "members")
        self.nodes = steps.save(named.groupBy("node").agg(F.first("embedding").alias("embedding")), "nodes")
        self.size = self.nodes.count()
        edges = steps.save(_first(self._descend(steps.save(self._begin(), "edges-0")), "src", "dst", self.degree), "edges")
        both = edges.select("src", "dst").unionByName(_first(edges, "dst", "src", self.degree).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        self.adjacency = steps.save(both.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("near")), "adjacency")
        return self

    def _begin(self) -> DataFrame:
        """Edges within groups of some ``2 * listed`` nodes that share a hash."""
        groups = max(1, self.size // (2 * self.listed))
        places = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.pmod(F.xxhash64("node", F.lit(self.seed + s)), F.lit(groups)).alias("b")) for s in range(self.starts)]))
        found = _compare(self.nodes.select(places.alias("grp"), "node", "embedding", F.lit(True).alias("fresh"), F.lit(-2.0).alias("worst")), self.listed, self.width)
        return _first(found.distinct().withColumn("fresh", F.lit(True)), "src", "dst", self.listed)

    def _descend(self, edges: DataFrame) -> DataFrame:
        """Rounds of comparing neighbours' neighbours."""
        for n in range(1, self.rounds + 1):
            named = edges.select(F.col("src").alias("grp"), F.col("dst").alias("node"), "fresh")
            naming = _first(edges, "dst", "src", self.listed).select(F.col("dst").alias("grp"), F.col("src").alias("node"), "fresh")
            full = edges.groupBy(F.col("src").alias("node")).agg(F.when(F.count("*") >= self.listed, F.min("score")).otherwise(-2.0).alias("worst"))
            nodes = self.nodes.join(full, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
            found = _compare(named.unionByName(naming).join(nodes, "node"), self.listed, self.width)
            # An edge that was there is not fresh again.
            merged = edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
            merged = merged.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
            edges = self.steps.save(_first(merged, "src", "dst", self.listed), f"edges-{n}")
            if edges.where("fresh").count() <= self.settled * self.listed * self.size:
                break
        return edges

    def search(self, queries: DataFrame, k: int = 10, beam: int = 24, width: int = 6, steps: int = 5, dead: DataFrame | None = None) -> DataFrame:
        """query_id, vec_id, score, rank: the k nearest by cosine that the beam met.

        ``dead`` (vec_id) are left out of the result, yet still lead the way.  ``met`` then
        holds (query_id, node) of all that was scored, entry nodes apart.
        """
        keep, save = max(beam, k), self.steps.save
        asked = save(queries.where(F.col("query_id").isNotNull() & V.usable(F.col("embedding"), self.width)).select("query_id", "embedding"), "queries")
        entries = self.nodes.orderBy("node").limit(self.entries).select(F.col("node").alias("vec_id"), "embedding")
        pool = save(top_k(entries, asked, keep).select("query_id", F.col("vec_id").alias("node"), "score", F.lit(False).alias("done")), "pool-0")
        self.met = pool.select("query_id", "node")
        query = asked.select("query_id", F.col("embedding").alias("query"))
        for n in range(1, steps + 1):
            by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
            chosen = save(pool.where("NOT done").withColumn("_n", F.row_number().over(by_query)).where(F.col("_n") <= width).select("query_id", "node"), f"chosen-{n}")
            if not chosen.limit(1).count():
                break
            reached = chosen.join(self.adjacency, "node").select("query_id", F.explode("near").alias("node")).distinct()
            unmet = reached.join(self.met, ["query_id", "node"], "left_anti")
            scored = unmet.join(self.nodes, "node").join(query, "query_id").select("query_id", "node", F.round(score(F.col("embedding"), F.col("query")), 6).alias("score"))
            scored = save(scored, f"scored-{n}")
            followed = pool.join(chosen.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "score", (F.col("done") | F.col("now").isNotNull()).alias("done"))
            both = followed.unionByName(scored.withColumn("done", F.lit(False)))
            pool = save(_first(both, "query_id", "node", keep), f"pool-{n}")
            self.met = self.met.unionByName(scored.select("query_id", "node"))
        live = self.members if dead is None else self.members.join(dead.select("vec_id").distinct(), "vec_id", "left_anti")
        # More than k members of a node can't be among a query's k nearest.
        live = live.join(pool.select("node").distinct(), "node", "left_semi")
        live = live.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("_n") <= k).drop("_n")
        return merge_segments(pool.join(live, "node").select("query_id", "vec_id", "score"), k)

    @property
    def entries(self) -> int:
        """How many nodes each query meets first; this grows with the index."""
        return max(32, math.isqrt(self.size))
