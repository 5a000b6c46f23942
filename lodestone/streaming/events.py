"""Structured Streaming over file and task events (event_id, ts, ...)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tasks import Limit, advance, outcome_of
from ..operators.vector_index import drop_folder
from ..shipping import ship

WATERMARK = "10 minutes"
_PAYLOAD = re.compile(r"data: (\{.*\})\s*")


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder's table, one Parquet file or a folder of them, as a stream; a column ``ts``
    becomes a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream takes a single file, as well as a folder, where the path is a pattern.
    rows = reader.parquet(f"{folder}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def route(events: DataFrame, kind: Column) -> DataFrame:
    """``action``: create for new and renamed-to files, delete for deleted and
    renamed-from ones; other events go."""
    action = F.when(kind.isin("new", "rename_to"), "create").when(kind.isin("delete", "rename_from"), "delete")
    return events.withColumn("action", action).where("action IS NOT NULL")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, key: str, width: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """Events by key and window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", WATERMARK).groupBy(window, key).agg(F.count("*").alias("events")).select(key, F.col("window.start").alias("start"), "events")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", WATERMARK).groupBy(window, key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def throttled(events: DataFrame, key: str) -> DataFrame:
    """key, event_id, concurrency: the limit after each event, by keyed state.  The events
    of a micro-batch are taken in their order; one that comes in a later batch counts
    when it comes."""
    ship(events.sparkSession)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = Limit(*state.get) if state.exists else Limit()
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"], kind="stable")
        levels = []
        for ms, ok, code in zip(rows.ms, rows.ok, rows.code, strict=True):
            limit = advance(limit, int(ms), outcome_of(bool(ok), int(code)))
            levels.append(limit.level)
        state.update(tuple(limit))
        yield pd.DataFrame({key: keys[0], "event_id": rows.event_id, "concurrency": levels})

    rows = events.select(key, F.unix_millis("ts").alias("ms"), "event_id", "ok", "code")
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} string, event_id long, concurrency int", "concurrency int, shrink double, successes int, failures int, adjusted long", "append", GroupStateTimeout.NoTimeout
    )


def reframed(parts: DataFrame, key: str, size: int = 8000) -> DataFrame:
    """key, frame, data, status: byte parts of a key put into frames of ``size``;
    what doesn't fill a frame waits in the state.  A part with ``last`` flushes."""
    ship(parts.sparkSession)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else (b"", 0)
        rest = bytes(rest)
        rows: list[dict[str, Any]] = []
        for part in pd.concat(list(frames)).sort_values("seq").itertuples():
            rest += bytes(part.data)
            while len(rest) >= size:
                rows.append({"frame": n, "data": rest[:size], "status": "first" if n == 0 else "continue"})
                rest, n = rest[size:], n + 1
            if part.last:
                rows.append({"frame": n, "data": rest, "status": "last"})
                rest, n = b"", n + 1
        state.update((rest, n))
        yield pd.DataFrame([{key: keys[0], **r} for r in rows], columns=[key, "frame", "data", "status"])

    return parts.groupBy(key).applyInPandasWithState(step, f"{key} long, frame int, data binary, status string", "rest binary, n int", "append", GroupStateTimeout.NoTimeout)


def carried_payloads(parts: DataFrame, key: str) -> DataFrame:
    """key, payload: the JSON objects of an event stream that comes in parts (key, seq,
    text) cut anywhere; what follows the last whole line waits in the state."""
    ship(parts.sparkSession)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, out = state.get[0] if state.exists else "", []
        for frame in sorted(frames, key=lambda f: f.seq.min()):
            *lines, rest = (rest + "".join(frame.sort_values("seq").text)).split("\n")
            out += [m[1] for line in lines if (m := _PAYLOAD.fullmatch(line))]
        state.update((rest,))
        yield pd.DataFrame({key: [keys[0]] * len(out), "payload": out})

    kind = parts.schema[key].dataType.simpleString()
    return parts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, payload string", "rest string", "append", GroupStateTimeout.NoTimeout)


def buffered(rows: DataFrame, key: str, size: int = 100, wait_ms: int = 10_000) -> DataFrame:
    """key, segment, ids: ids gathered in a buffer of each key, flushed as a segment when
    ``size`` of them are there, and ``wait_ms`` after the last batch whatever there is."""
    ship(rows.sparkSession)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out: list[list[int]] = []
        if state.hasTimedOut:
            out, held = [held] if held else [], []
        for frame in frames:
            held += sorted(frame.id.tolist())
            while len(held) >= size:
                out.append(held[:size])
                held = held[size:]
        state.update((held, n + len(out)))
        if held:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame({key: [keys[0]] * len(out), "segment": list(range(n, n + len(out))), "ids": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, segment int, ids array<long>", "held array<long>, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Job:
    """A stream that can be paused and resumed: its checkpoint, in the shared folder,
    says how far it is, and each start takes up there."""

    def __init__(self, stream: DataFrame, target: str, checkpoint: str):
        self.stream, self.target, self.checkpoint, self.query = stream, target, checkpoint, None

    def start(self, once: bool = True) -> Job:
        writer = self.stream.writeStream.format("parquet").option("path", self.target).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        return self

    def wait(self) -> Job:
        self.query.awaitTermination()
        return self

    def pause(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def progress(self) -> list[dict]:
        return [] if self.query is None else [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in self.query.recentProgress]


def shared_folder(spark: SparkSession, name: str) -> str | None:
    """A new folder below ``spark.checkpoint.dir``; None where the session has none (local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}" if root else None


def table_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table: shared where the session names one, else, in local runs
    only, a temporary one."""
    folder = shared_folder(spark, name)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return folder or "file://" + tempfile.mkdtemp(prefix="lodestone-")


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its rows as a table.

    The state and the rows are files below a new folder (``table_folder``).  A whole result
    that each batch replaces (mode "complete") is a table for each batch, of which the last
    is returned.
    """
    spark, folder = stream.sparkSession, table_folder(stream.sparkSession, name)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    written: list[str] = []

    def replace(batch: DataFrame, epoch: int) -> None:
        path = f"{folder}/rows-{epoch}"
        batch.write.mode("overwrite").parquet(path)
        for old in written:
            if old != path:
                drop_folder(spark, old)
        written[:] = [path]

    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*written) if written else spark.createDataFrame([], stream.schema)
