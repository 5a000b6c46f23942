"""Tables between the rounds of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Parquet tables of one call, below ``spark.checkpoint.dir``; a local session without
    that setting gets a temporary folder, a cluster without it an error."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        self.spark, self.root, self._made = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; its lineage ends here."""
        self._made += 1
        path = f"{self.root}/{self._made:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
