"""The retrieval service: upload, index, search and delete, by application.

Tables live under one root and are read and written by Spark: ``documents``,
``chunks`` and ``vectors``, each partitioned by application and project (one for
each embedding model), so that a search reads its own projects only.  Every
upload appends; deletions are rows of ``deleted`` that reads leave out, and
``compact`` rewrites the tables without them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import scalars as S
from .functions import vectors as V
from .operators import catalog, chunking, embedding
from .operators import vector_index as X
from .sources import readers, sinks

_SCHEMAS = {
    "documents": "document_id string, file string, text string, hash string, status int, added timestamp, app_id string, model string",
    "chunks": "chunk_id string, document_id string, chunk_index int, content string, app_id string, model string",
    "vectors": "vec_id string, document_id string, embedding array<float>, app_id string, model string",
    "deleted": "document_id string, app_id string",
    "states": "document_id string, status int, app_id string, model string",
}


class Engine:
    """One store with its embedding providers by model name."""

    def __init__(self, spark: SparkSession, root: str, providers: dict[str, embedding.Provider] | None = None, applications: list[str] | None = None):
        """``applications`` names those that may upload; None lets all."""
        self.spark, self.root, self.applications = spark, root.rstrip("/"), applications
        self.providers = providers or {"hashed-64": embedding.hashed_provider(64)}

    def table(self, name: str, app_id: str | None = None, model: str | None = None) -> DataFrame:
        """A table's rows that aren't deleted."""
        rows = self._stored(name)
        if app_id is not None:
            rows = rows.where(F.col("app_id") == app_id)
        if model is not None and name != "deleted":
            rows = rows.where(F.col("model") == model)
        return rows if name == "deleted" else rows.join(self._stored("deleted"), ["app_id", "document_id"], "left_anti").select(rows.columns)

    def _stored(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], _SCHEMAS[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        keys = [k for k in ("app_id", "model") if k in rows.columns]
        rows.write.mode("append").partitionBy(*keys).parquet(f"{self.root}/{name}")

    def _reached(self, rows: DataFrame, status: int) -> None:
        """Note that documents (document_id, app_id, model) have come to a state."""
        self._append("states", rows.select("document_id", F.lit(status).alias("status"), "app_id", "model").distinct())

    def models(self) -> list[str]:
        return sorted(self.providers)

    def embed_texts(self, rows: DataFrame, model: str, text_col: str = "text") -> DataFrame:
        return embedding.embed(rows, self.providers[model], text_col)

    def upload(self, app_id: str, files: DataFrame, model: str) -> DataFrame:
        """Add files (file, text); a name that the project has already is left out.
        Returns the new documents: file, document_id, status."""
        if not 0 < len(app_id) <= 128:
            raise ValueError("an application id has 1 to 128 characters")
        if self.applications is not None and app_id not in self.applications:
            raise PermissionError(f"{app_id!r} is not one of the applications served here")
        known = self.table("documents", app_id, model).select("file")
        fresh = files.select("file", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["file"]).join(known, "file", "left_anti")
        stamp = F.current_timestamp()
        rows = fresh.select(
            F.sha2(F.concat_ws("\x1f", F.lit(app_id), F.lit(model), "file", "text", stamp.cast("string")), 256).substr(1, 32).alias("document_id"),
            "file", "text", F.sha2("text", 256).alias("hash"), F.lit(catalog.UNPROCESSED).alias("status"), stamp.alias("added"), F.lit(app_id).alias("app_id"), F.lit(model).alias("model"),
        )
        self._append("documents", rows)
        return self.table("documents", app_id, model).join(files.select("file").distinct(), "file", "left_semi").select("file", "document_id", "status")

    def build_index(self, app_id: str, model: str, config: chunking.ChunkConfig = chunking.PIPELINE, strategy: str = "fixed_size") -> int:
        """Chunk and embed the documents that have no chunks yet; the number of new chunks."""
        done = self.table("states", app_id, model).where(F.col("status") >= catalog.CHUNKED).select("document_id").distinct()
        waiting = self.table("documents", app_id, model).join(done, "document_id", "left_anti")
        self._reached(waiting, catalog.PARSED)
        parts = chunking.chunk(waiting, strategy, config, id_col="document_id")
        index = F.row_number().over(catalog.Window.partitionBy("document_id").orderBy(parts.columns[1])) - 1
        chunks = parts.select(
            F.sha2(F.concat_ws("\x1f", "document_id", F.col(parts.columns[1]).cast("string")), 256).substr(1, 32).alias("chunk_id"), "document_id", index.alias("chunk_index"), "content",
            F.lit(app_id).alias("app_id"), F.lit(model).alias("model"),
        )
        # A build that broke off has chunks without the state: they aren't stored twice.
        known = self.table("chunks", app_id, model).select("chunk_id")
        chunks, report = readers.counted(chunks.join(known, "chunk_id", "left_anti").select(*chunks.columns), f"chunks-{uuid.uuid4().hex}")
        self._append("chunks", chunks)
        parsed = self.table("states", app_id, model).where(F.col("status") == catalog.PARSED)
        self._reached(parsed, catalog.CHUNKED)
        stored = self.table("chunks", app_id, model)
        missing = stored.join(self.table("vectors", app_id, model).select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_anti")
        self._append("vectors", embedding.embed(missing, self.providers[model]).select(F.col("chunk_id").alias("vec_id"), "document_id", "embedding", "app_id", "model"))
        self._reached(self.table("vectors", app_id, model), catalog.VECTORISED)
        return report()["files"]

    def chunks(self, app_id: str, document_id: str, model: str) -> DataFrame:
        """A document's chunks in their order."""
        return self.table("chunks", app_id, model).where(F.col("document_id") == document_id).orderBy("chunk_index")

    def owner(self, app_id: str, ids: list[str]) -> DataFrame:
        """document_id, model: the project that each document is in; null for unknown ones."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
        return catalog.owners(self.table("documents", app_id), asked, "document_id", "model")

    def search(self, app_id: str, text: str, k: int = 10, model: str | None = None, rerank: bool = True) -> DataFrame:
        """id, similarity, distance, model, rank, content, file: the nearest chunks over
        the projects of an application; ``rerank=False`` keeps each project's own ranks."""
        found = None
        for name in [model] if model else self.models():
            asked = self.embed_texts(self.spark.createDataFrame([(0, text)], "query_id long, text string"), name)
            vectors = self.table("vectors", app_id, name).select("vec_id", "document_id", "model", "embedding")
            hits = X.top_k(vectors, asked, k)
            found = hits if found is None else found.unionByName(hits)
        if rerank and not model:
            found = X.merge_segments(found, k)
        chunks = self.table("chunks", app_id, model).select(F.col("chunk_id").alias("vec_id"), "content")
        docs = self.table("documents", app_id).select("document_id", "file")
        return found.join(chunks, "vec_id", "left").join(docs, "document_id", "left").select(
            F.col("vec_id").alias("id"), F.col("score").alias("similarity"), V.similarity_to_distance(F.col("score")).alias("distance"), "model", "rank", "content", "file"
        )

    def search_reply(self, app_id: str, text: str, k: int = 10, model: str | None = None) -> str:
        """The same as JSON, ``{"results": [...]}``."""
        row = sinks.reply(self.search(app_id, text, k, model).withColumn("one", F.lit(1)), ["one"], ["id", "similarity", "model", "content", "file"], ["rank"]).first()
        return row.reply if row else '{"results":[]}'

    def documents_info(self, app_id: str, ids: list[str] | None = None) -> DataFrame:
        """Documents with their state and file path."""
        rows = self.table("documents", app_id)
        rows = rows if ids is None else rows.where(F.col("document_id").isin(ids))
        done = self.table("states", app_id).groupBy("document_id").agg(F.max("status").alias("done"))
        path = F.concat_ws("/", F.lit(self.root), "app_id", F.lit("documents"), "file")
        return rows.join(done, "document_id", "left").select("document_id", "file", "model", F.coalesce("done", "status").alias("status"), path.alias("file_path"), S.document_type(F.col("file")).alias("kind"), "added")

    def document_files(self, app_id: str) -> DataFrame:
        """file, status: 1 for files that can be found, else 0, as older clients ask for them."""
        return self.documents_info(app_id).select("file", F.when(F.col("status") == catalog.VECTORISED, 1).otherwise(0).alias("status"))

    def delete_documents(self, app_id: str, ids: list[str]) -> int:
        """Delete documents with their chunks and vectors; how many there were."""
        gone = self.table("documents", app_id).where(F.col("document_id").isin(ids)).select("document_id", "app_id")
        n = gone.count()
        self._append("deleted", gone.select("document_id", "app_id"))
        return n

    def status(self, app_id: str) -> DataFrame:
        """Documents by state."""
        return self.documents_info(app_id).groupBy("status").agg(F.count("*").alias("documents"))

    def destroy_index(self, app_id: str) -> None:
        """Delete all that an application has, its files too."""
        for name in _SCHEMAS:
            X.drop_folder(self.spark, f"{self.root}/{name}/app_id={app_id}")

    def rebuild_index(self, app_id: str, model: str) -> int:
        """Embed all chunks of a project anew; how many vectors there are then."""
        chunks = self.table("chunks", app_id, model)
        vectors = embedding.embed(chunks, self.providers[model]).select(F.col("chunk_id").alias("vec_id"), "document_id", "embedding")
        vectors.write.mode("overwrite").parquet(f"{self.root}/vectors/app_id={app_id}/model={model}")
        return self.table("vectors", app_id, model).count()

    def compact(self, target: str) -> Engine:
        """Write the tables without deleted rows to ``target``, an engine of its own."""
        out = Engine(self.spark, target, self.providers, self.applications)
        for name in ("documents", "chunks", "vectors", "states"):
            out._append(name, self.table(name))
        return out
