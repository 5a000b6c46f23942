"""Intermediate tables in the folder that the whole cluster shares.

Multi-pass operators cut their lineage by writing a Parquet table and reading
it back.  The table lives under ``spark.checkpoint.dir``; when the session has
none, a temporary folder is used, which is only allowed for a local master.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Rows of keys that a join sends to every task.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _LOCAL[app]


class Workspace:
    """Named Parquet tables of one operator call, under one unique folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._step = 0

    def path(self, name: str) -> str:
        self._step += 1
        return f"{self.root}/{self._step:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; its lineage ends here."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            path = getattr(table, "_lodestone_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rows_of_keys(docs: DataFrame, keys: DataFrame, text_col: str, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_sha256) is in ``keys``, a column of such
    structs (or is not, by ``left_anti``): one row for each, that with the least hash
    over its columns.

    Rows that agree are combined on the map side, so a row that repeats in a third
    of the table is sent once by each task.
    """
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    key = F.struct(F.col(id_col).alias("doc_id"), sha.alias("text_sha256"))
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    hashed = [F.col("_row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    one = rows.groupBy("_key").agg(F.min_by("_row", F.xxhash64(*hashed)).alias("_row"))
    return one.join(keys, F.col("_key") == F.col(f"`{keys.columns[0]}`"), how).select("_row.*")


def bounded(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table of keys as the broadcast side of a join if it is counted to be small enough."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def rows_without(docs: DataFrame, gone: DataFrame, known: DataFrame, ws: Workspace, text_col: str, id_col: str) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_sha256) is in ``gone``; of rows that agree
    in both, one stays.  ``known`` is a saved table with both columns for every row.

    Rows that are neither dropped nor repeated aren't shuffled, unless those that are
    are many; repeated ones meet on the map side first.
    """
    name, key = fresh(docs.columns, "_gone"), F.struct("doc_id", "text_sha256")
    gone = ws.save(gone.select(key.alias(name)).distinct(), "gone")
    repeated = ws.save(known.groupBy("doc_id", "text_sha256").count().where("count > 1").select(key.alias(name)), "repeated")
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    own = F.struct(F.col(id_col).alias("doc_id"), sha.alias("text_sha256"))
    out = docs.join(bounded(ws.save(gone.union(repeated).distinct(), "not-as-it-is")), own == F.col(name), "left_anti")
    if repeated.limit(1).count():
        once = ws.save(repeated.join(gone.select(F.col(name).alias("_other")), F.col(name) == F.col("_other"), "left_anti"), "once")
        out = out.unionByName(rows_of_keys(docs.join(bounded(once), own == F.col(name), "left_semi"), once, text_col, id_col))
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: Python objects are made for few at a time."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
