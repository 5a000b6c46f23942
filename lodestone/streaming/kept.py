"""A table of the last state of each key, kept up to date by a stream of changes.

Keys are dealt into ``buckets``.  A micro-batch rewrites the buckets that it touches, as a
new version below its epoch, and then commits the list of them; readers take each bucket's
last committed version.  So a batch that broke off leaves nothing visible, and one that runs
again changes nothing.  States are merged by their order, not by arrival: a late
older change loses, also against a deletion, which stays in the table as a mark.

Defined results: changes without key are left out; of changes with equal order the greater
row, column by column, wins (null is least); a null ``deleted`` condition doesn't delete; an
empty batch commits nothing; other columns may have any name but ``bucket``, ``gone`` and ``state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.vector_index import drop_folder

_COMMITS = "epoch long, bucket int"


class KeptTable:
    """The table below ``path``: rows of ``schema``, the last by ``order`` for each ``key``,
    without those whose last change meets ``deleted`` (SQL)."""

    def __init__(self, path: str, schema: T.StructType, key: str, order: list[str], deleted: str, buckets: int = 64):
        self.path, self.key, self.deleted, self.buckets = path.rstrip("/"), key, deleted, buckets
        if clash := {"bucket", "gone", "state"} & set(schema.names):
            raise ValueError(f"columns can't be named {sorted(clash)}")
        #: The order first, so that the greatest struct is the last state.
        self.columns = [*order, *[c for c in schema.names if c not in {key, *order}]]
        self.names = schema.names
        self.stored = T.StructType([schema[key], *[schema[c] for c in self.columns], T.StructField("gone", T.BooleanType()), T.StructField("bucket", T.IntegerType())])

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last state of each key, of rows as they are stored."""
        state = F.max(F.struct(*self.columns, "gone")).alias("state")
        return rows.groupBy(self.key, "bucket").agg(state).select(self.key, "state.*", "bucket")

    def _commits(self, spark: SparkSession) -> DataFrame:
        spark.createDataFrame([], _COMMITS).write.mode("ignore").parquet(f"{self.path}/commits/none")
        return spark.read.schema(_COMMITS).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")

    def _versions(self, spark: SparkSession) -> dict[int, int]:
        """Each bucket's last committed epoch."""
        return {r["bucket"]: r["epoch"] for r in self._commits(spark).groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()}

    def _folder(self, bucket: int, epoch: int) -> str:
        return f"{self.path}/versions/epoch={epoch}/bucket={bucket}"

    def _read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """Stored rows of some buckets, marks of deletion included; other buckets aren't read."""
        chosen = [self._folder(b, e) for b, e in sorted(self._versions(spark).items()) if buckets is None or b in buckets]
        if not chosen:
            return spark.createDataFrame([], self.stored)
        kept = T.StructType([*self.stored.fields, T.StructField("epoch", T.LongType())])
        return spark.read.schema(kept).option("basePath", f"{self.path}/versions").parquet(*chosen).drop("epoch")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).where("NOT gone").select(*self.names)

    def apply(self, batch: DataFrame, epoch: int) -> bool:
        """Merge a batch of changes; False, and nothing done, if the epoch is in already."""
        spark = batch.sparkSession
        if self._commits(spark).where(F.col("epoch") >= epoch).limit(1).count():
            return False
        changes = batch.where(F.col(self.key).isNotNull()).withColumn("gone", F.coalesce(F.expr(self.deleted), F.lit(False)))
        changes = changes.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        staged = f"{self.path}/staged/epoch={epoch}"
        self._last(changes).select(*self.stored.names).write.mode("overwrite").parquet(staged)
        fresh = spark.read.schema(self.stored).parquet(staged)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        if touched:
            merged = self._last(self._read(spark, touched).unionByName(fresh))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/versions/epoch={epoch}")
            spark.createDataFrame([(epoch, b) for b in touched], _COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/epoch={epoch}")
        drop_folder(spark, staged)
        return bool(touched)

    def vacuum(self, spark: SparkSession) -> int:
        """Delete versions that later ones have replaced, when nobody reads them; how many."""
        last = self._versions(spark)
        old = [r for r in self._commits(spark).collect() if r["epoch"] < last[r["bucket"]]]
        return sum(drop_folder(spark, self._folder(r["bucket"], r["epoch"])) for r in old)

    def keep(self, changes: DataFrame) -> None:
        """Run a stream over what is there; its checkpoint belongs to the table, so that
        epochs go on where they ended."""
        def step(batch: DataFrame, epoch: int) -> None:
            self.apply(batch, epoch)

        changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
