"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: Spark's default rows of an Arrow batch, and what is used in its place: texts are
#: long, and a batch is held on both sides, so smaller ones bound a worker's memory.
_BATCH_ROWS, _DEFAULT_ROWS, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, once for each application, and
    Arrow batches small unless the session says how large they are."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH_ROWS, _ROWS)
    if context.applicationId not in _SENT:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="lodestone-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    return spark
