"""Which index to build for a segment, and with which parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def index_type(count: Column, dimension: Column) -> Column:
    """Exact for small segments, a graph for middling ones, cells beyond."""
    return F.when(count < 1000, "Flat").when(count < 100_000, "HNSW").when(dimension > 512, "IVFPQ").otherwise("IVF")


def index_parameters(kind: Column, count: Column, dimension: Column) -> Column:
    """struct(nlist, m, ef_construction, nbits); null where a kind has none."""
    cells, coded = kind.isin("IVF", "IVFPQ"), kind.isin("PQ", "IVFPQ")
    return F.struct(
        F.when(cells, F.least(F.lit(4096), F.floor(count / 39))).cast("int").alias("nlist"),
        F.when(kind == "HNSW", 16).when(coded, F.floor(dimension / 8)).cast("int").alias("m"),
        F.when(kind == "HNSW", 200).alias("ef_construction"),
        F.when(coded, 8).alias("nbits"),
    )


def scan_cost(count: Column, dimension: Column) -> Column:
    """Multiply-adds of an exact search of one query."""
    return count.cast("long") * dimension


def advised(vectors: DataFrame) -> Row:
    """count, dimension, index_type and the parameters of cells (nlist, 1 at least) for a table
    of vectors, whatever type is advised."""
    shape = vectors.select(F.count("embedding").alias("count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
    count, dimension = F.col("count"), F.col("dimension")
    cells = F.greatest(F.lit(1), index_parameters(F.lit("IVF"), count, dimension)["nlist"])
    return shape.select("count", "dimension", index_type(count, dimension).alias("index_type"), cells.alias("nlist")).first()
