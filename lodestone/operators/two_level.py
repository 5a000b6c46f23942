"""An index of two levels: a main one that stays as it is, and a delta of what was added since.

Adding writes only the batch; deleting writes the positions that are dead in the main level and
resets the delta to what is left of it; a search asks both levels and merges their best; compacting
makes one main level of all that lives.  Positions are dense numbers: a batch continues where
the index ends, and a position isn't given twice until compacting numbers all rows anew.
The tables are Parquet in the shared folder, so no state is lost with an executor.

Defined results: vectors that are null, empty, zero, of another width than the first table's
widest or with a null or a number that isn't finite, and rows without id, are left out; rows of one
id in a batch are one, with the least vector; ids that live already are left out of a batch
(``replace`` deletes them first); deleting unknown or null ids changes nothing; an id deleted
and added again lives with its new vector; other columns are ignored; empty tables give empty
results.  Where the first table has no vector, the first batch with one gives the width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .cells import Cells
from .steps import Steps
from .vector_index import merge_segments, top_k


def dense_positions(rows: DataFrame, order: str, start: int, steps: Steps, name: str = "dense") -> DataFrame:
    """``rows`` with ``position``, from ``start`` on without gaps, by a column without repeats.

    Rows are dealt in ranges of the column; a range starts after the rows of those before
    it, whose sizes, one row a range, are all that passes one task.
    """
    dealt = steps.save(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), name)
    before = F.sum("count").over(Window.orderBy("_range")) - F.col("count")
    sizes = dealt.groupBy("_range").count().select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(sizes), "_range").withColumn("position", F.col("_place") + F.col("_before") + F.lit(start)).drop("_range", "_place", "_before")


class TwoLevelIndex:
    """See the module's text.  With ``cells``, the main level is searched by that many cells
    (approximate, ``recall`` measured on a sample); without, both are searched exactly."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.95):
        self.steps, self.cells, self.recall, self.width = Steps(vectors.sparkSession, "two-level"), cells, recall, 0
        self._begin(self._clean(vectors), "vec_id")

    def _clean(self, rows: DataFrame) -> DataFrame:
        self.width = self.width or rows.select(F.max(F.size("embedding"))).first()[0] or 0
        good = rows.where(F.col("vec_id").isNotNull() & V.usable(F.col("embedding"), self.width))
        return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def _begin(self, rows: DataFrame, order: str) -> None:
        self.main = self.steps.save(dense_positions(rows, order, 0, self.steps).select("vec_id", "position", "embedding"), "main")
        self.total = self.main.count()
        self.deltas: list[DataFrame] = []
        self.dead = self.main.select("vec_id", "position").limit(0)
        self.index = None if self.cells is None else Cells(self.cells).fit(self.main).tuned(self.recall)

    @property
    def delta(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.deltas, self.main.limit(0))

    def live(self) -> DataFrame:
        """vec_id, position, embedding, level of all that was added and not deleted."""
        main = self.main.join(self.dead.select("position"), "position", "left_anti").withColumn("level", F.lit("main"))
        return main.unionByName(self.delta.withColumn("level", F.lit("delta")))

    def add(self, batch: DataFrame) -> int:
        """Append a batch (vec_id, embedding) to the delta; how many rows were new."""
        fresh = self._clean(batch).join(self.live().select("vec_id"), "vec_id", "left_anti")
        part = self.steps.save(dense_positions(fresh, "vec_id", self.total, self.steps).select(*self.main.columns), "delta")
        added = part.count()
        if added:
            self.deltas.append(part)
            self.total += added
        return added

    def delete(self, ids: DataFrame) -> None:
        """Delete ids (vec_id): noted for the main level, taken out of the delta."""
        gone = self.steps.save(ids.where("vec_id IS NOT NULL").select("vec_id").distinct(), "gone")
        noted = self.main.select("vec_id", "position").join(gone, "vec_id", "left_semi")
        self.dead = self.steps.save(self.dead.unionByName(noted).distinct(), "dead")
        if self.deltas:
            self.deltas = [self.steps.save(self.delta.join(gone, "vec_id", "left_anti").select(*self.main.columns), "delta")]

    def replace(self, batch: DataFrame) -> int:
        """Append a batch whose usable rows replace what lives with their ids."""
        rows = self.steps.save(self._clean(batch), "batch")
        self.delete(rows)
        return self.add(rows)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, vec_id, position, level, score, rank: the k nearest by cosine."""
        live, columns = self.live(), ["query_id", "vec_id", "position", "level", "score"]
        asked = queries.where(F.col("query_id").isNotNull() & V.usable(F.col("embedding"), self.width)).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
        asked = self.steps.save(asked, "queries")
        if self.index is None:
            return merge_segments(top_k(live, asked, k).select(*columns), k)
        main = self.index.search(asked, k, dead=self.dead).join(self.main.select("vec_id", "position"), "vec_id").withColumn("level", F.lit("main"))
        delta = top_k(live.where("level = 'delta'"), asked, k)
        return merge_segments(main.select(*columns).unionByName(delta.select(*columns)), k)

    def compact(self) -> None:
        """One main level of all that lives, numbered anew in the order of positions."""
        self._begin(self.live().select("vec_id", F.col("position").alias("_old"), "embedding"), "_old")
