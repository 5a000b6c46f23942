"""Text chunkers: a table of documents to a table of chunks.

All but the fixed-size chunker are SQL expressions.  That one moves its start by
where the last cut fell, so it runs over Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import unicode_trim
from ..shipping import ship

#: Where a chunk may end: punctuation and white space.
BREAK = r"[\p{P}\p{Z}\x09-\x0D\x85]"
SENTENCE_BREAK = "[.!?]"


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes are in code points."""

    max_size: int = 1000
    overlap: int = 100
    min_size: int = 50
    separator: str = "\n\n"
    keep_sentences: bool = False
    resume_at_cut: bool = False

    @property
    def valid(self) -> bool:
        return 0 < self.max_size <= 100_000 and 0 <= self.overlap < self.max_size and 0 < self.min_size <= self.max_size

    @property
    def break_class(self) -> str:
        return SENTENCE_BREAK if self.keep_sentences else BREAK


#: The sizes used when documents are indexed.
PIPELINE = ChunkConfig(512, 50, 50)


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"[.!?]+[\s\p{Z}]+"), unicode_trim)
    return F.filter(parts, lambda s: F.length(s) > 0)


def paragraphs(text: Column, separator: str) -> Column:
    parts = F.transform(F.split(text, re.escape(separator).replace("\\\n", "\n")), unicode_trim)
    return F.filter(parts, lambda s: F.length(s) > 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda s: F.length(s) > 0)


def packed(parts: Column, glue: str, max_size: int) -> Column:
    """Parts joined greedily as long as they fit into ``max_size``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(F.length(state["open"]) == 0, part).otherwise(F.concat(state["open"], F.lit(glue), part))
        full = (F.length(joined) > max_size) & (F.length(state["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("open")
        )

    return F.aggregate(parts, start, add, lambda s: F.when(F.length(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def _rows(docs: DataFrame, chunks: Column, id_col: str) -> DataFrame:
    exploded = docs.select(F.col(id_col), F.posexplode(chunks).alias("chunk_index", "content"))
    return exploded.select(id_col, "chunk_index", "content", F.length("content").alias("length"), F.size(words(F.col("content"))).alias("word_count"))


def chunk_sentences(docs: DataFrame, config: ChunkConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return _rows(docs, packed(sentences(F.col(text_col)), " ", config.max_size), id_col)


def chunk_paragraphs(docs: DataFrame, config: ChunkConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return _rows(docs, packed(paragraphs(F.col(text_col), config.separator), config.separator, config.max_size), id_col)


def chunk_sliding(docs: DataFrame, config: ChunkConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Windows at fixed steps whose ends move back to a break."""
    text = F.col(text_col)
    step = config.max_size - config.overlap or config.max_size // 2
    # Windows are cut inside the row, so a long text isn't copied beside each of them.
    window = lambda k: F.struct(k.alias("start"), F.substring(text, k + 1, F.lit(config.max_size)).alias("raw"), (F.length(text) - k).alias("left"))
    cuts = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), window)
    windows = docs.where(F.length(text) > 0).select(id_col, F.explode(cuts).alias("w")).select(id_col, "w.*")
    cut = F.length(F.regexp_extract(F.substring("raw", 2, config.max_size), f"(?s)^.*{config.break_class}", 0))
    size = F.when(F.col("left") <= config.max_size, F.col("left")).when(cut > 0, cut + 1).otherwise(config.max_size)
    sized = windows.select(id_col, "start", "raw", size.alias("size"))
    trimmed = sized.select(id_col, "start", (F.col("start") + F.col("size")).alias("end"), unicode_trim(F.substring(F.col("raw"), F.lit(1), F.col("size"))).alias("content"))
    return trimmed.where(F.length("content") >= config.min_size)


def _chunk_end(start: int, size: int, cuts: list[int], config: ChunkConfig) -> int:
    """Behind the last break within reach, or at the full size; the least size holds."""
    limit = start + config.max_size
    if limit >= size:
        return size
    behind = bisect_right(cuts, limit)
    end = cuts[behind - 1] if behind and cuts[behind - 1] > start + 1 else limit
    return max(end, min(start + config.min_size, size))


def _next_start(start: int, end: int, config: ChunkConfig) -> int:
    """The overlap before the end, if that gets on; otherwise a full step, or the end itself."""
    behind = end - config.overlap
    step = end if config.resume_at_cut else start + max(1, config.max_size - config.overlap)
    return behind if behind > start else step


def fixed_spans(text: str, config: ChunkConfig, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    """[start, end) of each fixed-size chunk before trimming."""
    cuts, start = [m.end() for m in breaks.finditer(text)], 0
    while start < len(text):
        end = _chunk_end(start, len(text), cuts, config)
        yield start, end
        start = _next_start(start, end, config)


def chunk_fixed(docs: DataFrame, config: ChunkConfig = PIPELINE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, chunk_index, start, end, content; a text without breaks is cut at the size."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), *(T.StructField(c, T.IntegerType()) for c in ("chunk_index", "start", "end")), T.StructField("content", T.StringType())]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        breaks, edges = regex.compile(config.break_class), regex.compile(r"^[\p{Z}\s\x85]+|[\p{Z}\s\x85]+$")
        # Few rows at a time: each is a Python string with its chunks.
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                index = 0
                for start, end in fixed_spans(text or "", config, breaks) if config.valid else ():
                    content = edges.sub("", text[start:end])
                    if content:
                        at.append(k)
                        rows.append((index, start, end, content))
                        index += 1
            columns = [pa.array([r[c] for r in rows], pa.int32() if c < 3 else pa.string()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


class FixedChunks:
    """``chunk_fixed`` of one text as rows of a table function, with the pipeline's sizes."""

    def __init__(self):
        import regex

        self._breaks, self._edges = regex.compile(PIPELINE.break_class), regex.compile(r"^[\p{Z}\s\x85]+|[\p{Z}\s\x85]+$")

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        index = 0
        for start, end in fixed_spans(text or "", PIPELINE, self._breaks):
            content = self._edges.sub("", text[start:end])
            if content:
                yield index, start, end, content
                index += 1


def register_table_functions(spark: SparkSession) -> None:
    """``fixed_chunks(text)`` for LATERAL in SQL: a row for each chunk; null and empty texts have none."""
    ship(spark)
    spark.udtf.register("fixed_chunks", F.udtf(FixedChunks, returnType="chunk_index int, start int, `end` int, content string"))


#: Bounds of the splitter for retrieval of live documents.
SPLIT_LEAST, SPLIT_MOST = 200, 300


def legacy_split(text: Column, least: int = SPLIT_LEAST, most: int = SPLIT_MOST) -> Column:
    """Clauses gathered into pieces of between ``least`` and ``most`` code points.

    White space becomes one space and single quotes double ones; clause marks are
    lost.  A longer piece is cut hard; what is left over goes to the next piece,
    and at the end to a piece of its own if it is long enough.
    """
    clean = F.translate(F.regexp_replace(text, "[\\s\\p{Z}\\x{85}\\x{200B}]+", " "), "'", '"')
    clauses = F.filter(F.split(clean, "[\\n，；。,.]"), lambda s: F.length(s) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("over"))

    def add(state: Column, clause: Column) -> Column:
        piece = F.concat(state["over"], clause)
        n = F.length(piece)
        full = F.floor(n / most).cast("int")
        cuts = F.when(full > 0, F.transform(F.sequence(F.lit(0), F.greatest(full, F.lit(1)) - 1), lambda k: F.substring(piece, k * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
        return (
            F.when(n > most, F.struct(F.concat(state["done"], cuts).alias("done"), F.substring(piece, full * most + 1, n).alias("over")))
            .when((n > least) & (n < most), F.struct(F.array_append(state["done"], piece).alias("done"), F.lit("").alias("over")))
            .otherwise(F.struct(state["done"].alias("done"), piece.alias("over")))
        )

    def end(state: Column) -> Column:
        count = F.size(state["done"])
        return F.when((F.length(state["over"]) > least) | (count == 0), F.array_append(state["done"], state["over"])).otherwise(
            F.concat(F.slice(state["done"], F.lit(1), F.greatest(count - 1, F.lit(0))), F.array(F.concat(F.element_at(state["done"], F.greatest(count, F.lit(1))), state["over"])))
        )

    return F.aggregate(clauses, start, add, end)


def chunk_legacy(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", name: Column | None = None, most_chunks: int = 100) -> DataFrame:
    """Pieces of ``legacy_split``, with a long file name in front, at most ``most_chunks``."""
    pieces = legacy_split(F.col(text_col))
    if name is not None:
        pieces = F.concat(F.when(F.octet_length(name) > 14, F.array(name)).otherwise(F.array().cast("array<string>")), pieces)
    rows = docs.select(F.col(id_col), F.posexplode(F.slice(pieces, 1, most_chunks)).alias("chunk_index", "content"))
    return rows.where(F.length("content") > 0)


def chunk_statistics(text: Column, config: ChunkConfig) -> Column:
    """struct: length, estimate, sentences, paragraphs, words."""
    step = config.max_size - config.overlap if config.max_size > config.overlap else config.max_size
    return F.struct(
        F.length(text).alias("length"),
        F.floor((F.length(text) + step - 1) / step).cast("int").alias("estimate"),
        F.size(sentences(text)).alias("sentences"),
        F.size(paragraphs(text, config.separator)).alias("paragraphs"),
        F.size(words(text)).alias("words"),
    )


def chunk_totals(docs: DataFrame, config: ChunkConfig = PIPELINE, text_col: str = "text") -> DataFrame:
    """documents, chunks, average, skipped: what a run over ``docs`` makes, by the estimate for each text."""
    n = chunk_statistics(F.col(text_col), config)["estimate"]
    return docs.agg(F.count("*").alias("documents"), F.sum(n).cast("long").alias("chunks"), F.avg(n).alias("average"), F.count_if(F.length(text_col) == 0).alias("skipped"))


def chunk(docs: DataFrame, strategy: str = "fixed_size", config: ChunkConfig = PIPELINE, **columns: str) -> DataFrame:
    """Chunks by the name of a strategy; an invalid configuration gives none."""
    kinds = {"fixed_size": chunk_fixed, "sentence": chunk_sentences, "paragraph": chunk_paragraphs, "sliding": chunk_sliding, "semantic": chunk_sentences}
    return kinds[strategy](docs if config.valid else docs.limit(0), config, **columns)
