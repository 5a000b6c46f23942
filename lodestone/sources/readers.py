"""File sources: text, directory listings, parsers by file type, JSON catalogues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

LARGEST_FILE, LARGEST_IMAGE = 50 * 1024 * 1024, 20 * 1024 * 1024


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files as text, by their own encoding."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", S.decoded(F.col("content")).alias("content"))


def listing(spark: SparkSession, path: str, recursive: bool = True, blacklist: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """path, size, modified, file_type of files; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    place = F.regexp_replace("path", "^file:/*", "/")
    rows = files.select(place.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.where(S.path_allowed(F.col("path"), blacklist or []))
    if largest is not None:
        rows = rows.where(F.col("size") <= largest)
    return rows.withColumn("file_type", S.document_type(F.col("path")))


def properties(files: DataFrame) -> DataFrame:
    """Base properties as text, as they are indexed: path, size, lastModified, fileType."""
    return files.select("path", F.col("size").cast("string").alias("size"), S.compact_time(F.col("modified")).alias("lastModified"), F.col("file_type").alias("fileType"))


@dataclass
class Parser:
    """A reader of file contents with weights for suffixes and MIME types."""

    name: str
    suffixes: dict[str, float]
    parse: Callable[[Column], Column] | None = None
    mimes: dict[str, float] = field(default_factory=dict)
    #: Bytes of the largest file that it reads.
    largest: int = LARGEST_FILE


@dataclass
class ParserRegistry:
    """Parsers by name; the best for a file is chosen by an expression."""

    parsers: dict[str, Parser] = field(default_factory=dict)

    def register(self, parser: Parser) -> None:
        self.parsers[parser.name] = parser

    def unregister(self, name: str) -> None:
        self.parsers.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.parsers)

    def statistics(self) -> dict[str, int]:
        return {name: len(p.suffixes) + len(p.mimes) for name, p in sorted(self.parsers.items())}

    def _best(self, value: Column, tables: dict[str, dict[str, float]]) -> Column:
        rules = [
            F.when(F.lower(value) == pattern, F.struct((-F.lit(weight)).alias("w"), F.lit(name).alias("name")))
            for name, table in sorted(tables.items())
            for pattern, weight in table.items()
        ]
        return F.array_min(F.array_compact(F.array(*rows_or_none(rules))))["name"]

    def choose(self, path: Column, mime: Column | None = None) -> Column:
        """The name of the heaviest parser by suffix, else by MIME type; ties by name."""
        by_suffix = self._best(S.suffix(path), {n: p.suffixes for n, p in self.parsers.items()})
        return by_suffix if mime is None else F.coalesce(by_suffix, self._best(mime, {n: p.mimes for n, p in self.parsers.items()}))

    def parse(self, files: DataFrame) -> DataFrame:
        """path, parser, content for files (path, content as binary) that a parser reads; a file
        that is too large for its parser, or without text, gives no row."""
        chosen = files.withColumn("parser", self.choose(F.col("path")))
        content = F.lit(None).cast("string")
        for name, parser in self.parsers.items():
            if parser.parse is not None:
                content = F.when((F.col("parser") == name) & (F.octet_length("content") <= parser.largest), parser.parse(F.col("content"))).otherwise(content)
        return chosen.select("path", "parser", content.alias("content")).where("content IS NOT NULL AND content != ''")


def rows_or_none(rules: list[Column]) -> list[Column]:
    return rules or [F.lit(None).cast("struct<w: double, name: string>")]


def default_registry() -> ParserRegistry:
    """Text and HTML are read here; PDF, office and image files need a reader of the
    caller's (``Parser.parse``), since no extractor is at hand."""
    registry = ParserRegistry()
    registry.register(Parser("text", {"txt": 1.0, "md": 0.9, "csv": 0.8, "log": 0.8, "json": 0.8, "xml": 0.7}, S.decoded, {"text/plain": 1.0}))
    registry.register(Parser("html", {"html": 1.0, "htm": 1.0}, lambda c: S.html_to_text(S.decoded(c)), {"text/html": 1.0}))
    registry.register(Parser("pdf", {"pdf": 1.0}, None, {"application/pdf": 1.0}))
    registry.register(Parser("office", dict.fromkeys(S.DOCUMENT_TYPES["office"], 0.9)))
    registry.register(Parser("image", dict.fromkeys(S.DOCUMENT_TYPES["image"], 0.6), largest=LARGEST_IMAGE))
    return registry


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one JSON object or array of them."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """string_id, int_id from a JSON file {"map": {id: number}}."""
    return json_objects(spark, path, "map map<string, long>").select(F.explode("map").alias("string_id", "int_id"))


def first_columns(spark: SparkSession, sql: str, count: int = 3) -> DataFrame:
    """The first columns of a statement's result."""
    rows = spark.sql(sql)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns[:count]])


def installed_models(replies: DataFrame, body: str) -> DataFrame:
    """model, architectures, size, is_embedding from the JSON object that a model tool
    prints, {model: {architectures: [...], size: ...}}; another shape gives no row."""
    parsed = F.from_json(body, "map<string, struct<architectures: array<string>, size: long>>")
    rows = replies.select(F.explode(parsed).alias("model", "info"))
    return rows.select("model", "info.architectures", "info.size", S.has_architecture(F.col("info.architectures")).alias("is_embedding"))


def media_properties(files: DataFrame) -> DataFrame:
    """path, resolution, duration of image and sound files (path, content as binary), as
    far as their headers say; null for other formats."""
    size, seconds = S.image_size(F.col("content")), S.wave_seconds(F.col("content"))
    resolution = F.concat(size["width"].cast("string"), F.lit("*"), size["height"].cast("string"))
    return files.select("path", resolution.alias("resolution"), S.clock(F.round(seconds * 1000).cast("long")).alias("duration"))


def counted(rows: DataFrame, name: str = "indexed") -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``rows`` and a function that tells, after they were read by one action, how many
    there were and how many milliseconds passed since."""
    from time import monotonic

    from pyspark.sql import Observation

    seen, began = Observation(name), monotonic()
    return rows.observe(seen, F.count(F.lit(1)).alias("files")), lambda: {**seen.get, "elapsed_ms": int((monotonic() - began) * 1000)}
