"""Places and running sums within keys, one of which may hold most of the rows.

The rows are dealt in ranges of (key, order) and written in that order, so a key spans
as many partitions as its share of the table asks for.  Places count inside a partition;
what a partition adds for the key that goes on from the one before comes from a table of
at most one row a partition, the only thing that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Wide enough for any sum of longs.
SUM = "decimal(38,0)"


def in_order(rows: DataFrame, key: str, order: list[Column], workspace: Workspace, parts: int | None = None) -> DataFrame:
    """``rows`` as a saved table with ``_part`` (its range) and ``_at`` (its place in the range),
    sorted by ``key`` (not null), then ``order``."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    at = F.monotonically_increasing_id()
    return workspace.save(dealt.withColumn("_id", at).withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "in-order")


def running(table: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """A table of ``in_order`` with running sums within ``key`` (this row included), exact.

    A range holds the end of one key, whole keys, and the start of one, so at most one
    key of each range goes on from earlier ones.
    """
    here = table.groupBy(key, "_part").agg(*[F.sum(c.cast(SUM)).alias(f"_{name}") for name, c in sums.items()])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = here.select(F.col(key).alias("_key"), F.col("_part").alias("_in"), F.count("*").over(before).alias("_n"), *[F.sum(f"_{name}").over(before).alias(f"_{name}") for name in sums])
    carried = F.broadcast(carried.where("_n > 0").drop("_n"))
    inside = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    added = table.withColumns({name: F.sum(c.cast(SUM)).over(inside) for name, c in sums.items()})
    joined = added.join(carried, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_in")), "left")
    return joined.withColumns({name: F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0)) for name in sums}).drop("_key", "_in", *[f"_{name}" for name in sums])
