"""Sinks: snapshots, JSON replies and micro-batch upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import latest, placed


def write_snapshot(rows: DataFrame, path: str, partition_by: list[str] | None = None, files: int | None = None) -> None:
    """Replace a table; with ``files`` it is compacted to so many files."""
    out = rows if files is None else rows.coalesce(files)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_id_map(rows: DataFrame, path: str) -> None:
    """string_id, int_id as one JSON object; the map of one index."""
    rows.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("string_id", "int_id")))).alias("map")).write.mode("overwrite").json(path)


def reply(rows: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """keys, reply: the rows of each key as {"results": [...]}, in order."""
    item = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r"))
    results = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])
    return rows.groupBy(*keys).agg(F.to_json(F.struct(results.alias("results"))).alias("reply"))


def paged_reply(rows: DataFrame, keys: list[str], fields: list[str], order: str, ties: list[str], size: int = 100) -> DataFrame:
    """keys, page (from 0), reply: the same, ``size`` rows to a page, so no string grows with its key."""
    pages = placed(rows, keys, order, ties, "_n").withColumn("page", F.floor((F.col("_n") - 1) / size))
    return reply(pages, [*keys, "page"], fields, ["_n"])


def upsert_batches(path_of: Callable[[int], str], keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: the latest row of each key, one folder for each batch,
    so that a batch that runs again replaces its own output."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, keys, F.desc(order)).write.mode("overwrite").parquet(path_of(epoch))

    return write
