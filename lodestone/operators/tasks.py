"""Rolling statistics, rates and adaptive limits of task events
(task_type, ts, event_id, and what each function names)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .catalog import placed

#: How many tasks of a local type may run at a time.
LOCAL_LIMITS = {"Chat": 2, "FunctionCalling": 1, "ImageGeneration": 1, "TextToSpeech": 2, "SpeechToText": 2, "OCR": 3, "Embedding": 4, "Search": 6}
DEFAULT_LIMIT = 4


def rolling(events: DataFrame, key: str, value: str, last: int = 100, stretch: int = 10_000) -> DataFrame:
    """Mean and sum over the last samples of each key.

    The samples of a key are numbered, cut into stretches, and each stretch is given
    the samples that its first frames reach back to; so one key is many partitions.
    """
    numbered = placed(events, [key], "ts", ["event_id"], "_n")
    at, back = F.floor((F.col("_n") - 1) / stretch), (F.col("_n") - 1) % stretch >= stretch - (last - 1)
    both = numbered.withColumn("_at", F.explode(F.when(back, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_at") == at)
    w = Window.partitionBy(key, "_at").orderBy("_n").rowsBetween(-(last - 1), 0)
    framed = both.withColumn("rolling_avg", F.avg(value).over(w)).withColumn("rolling_sum", F.sum(value).over(w))
    return framed.where("_own").drop("_n", "_at", "_own")


def request_rate(events: DataFrame, key: str, seconds: int = 60, stretch_s: int = 3600) -> DataFrame:
    """Requests of each key that are not more than ``seconds`` whole seconds old.

    Times count in milliseconds, rounded to the nearest (half a one away from the epoch).
    Time is cut into stretches, each with the requests that its first frames reach
    back to.
    """
    reach, width = seconds * 1000 + 999, max(stretch_s, seconds + 1) * 1000
    timed = events.withColumn("_ms", F.call_function("div", F.round(F.unix_micros(F.col("ts").cast("timestamp")), -3), F.lit(1000)))
    at = F.floor(F.col("_ms") / width)
    both = timed.withColumn("_at", F.explode(F.when(F.col("_ms") - at * width >= width - reach, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_at") == at)
    w = Window.partitionBy(key, "_at").orderBy("_ms").rangeBetween(-reach, 0)
    return both.withColumn("recent", F.count("*").over(w)).where("_own").drop("_ms", "_at", "_own")


def retained_time(events: DataFrame, key: str, value: str, last: int = 100) -> DataFrame:
    """key, total_time: the sum over the last samples of each key; only so many of a key
    leave a task."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("_n", n).where(F.col("_n") <= last).groupBy(key).agg(F.sum(value).alias("total_time"))


def kind_counts(events: DataFrame, key: str, value: str, pending: Column) -> DataFrame:
    """key, events, pending, total_time."""
    return events.groupBy(key).agg(F.count("*").alias("events"), F.count_if(pending).alias("pending"), F.sum(value).alias("total_time"))


def stage_statistics(tasks: DataFrame, limits: dict[str, int], default: int = 4) -> DataFrame:
    """stage, queued, running, limit, usage (percent of the limit) from (stage, state)."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col("stage")), F.lit(default)) if limits else F.lit(default)
    counted = tasks.groupBy("stage").agg(F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "running").alias("running"))
    return counted.select("stage", "queued", "running", limit.alias("limit"), (F.col("running") * 100.0 / limit).alias("usage"))


def needs(tasks: DataFrame, maps: str) -> DataFrame:
    """resource, used: requirement maps (name to amount) of all tasks, summed name by name."""
    return tasks.select(F.explode(maps).alias("resource", "_amount")).groupBy("resource").agg(F.sum("_amount").alias("used"))


def flushed(rows: DataFrame, key: str, order: str, ties: list[str], size: int = 100) -> DataFrame:
    """``rows`` with the ``segment`` (from 0) that they are written to when a buffer of
    each key is flushed at every ``size`` rows."""
    return placed(rows, [key], order, ties, "_n").withColumn("segment", F.floor((F.col("_n") - 1) / size)).drop("_n")


def success_rate(events: DataFrame, key: str, ok: str) -> DataFrame:
    """Share of successes by key; 1.0 where none was counted."""
    return events.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col(ok), 1.0).otherwise(0.0)), F.lit(1.0)).alias("success_rate"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Spells of each key without an idle time of ``gap``: start, end, events."""
    ts = F.col("ts").cast("timestamp")
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.coalesce((ts > F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def dispatch_order(tasks: DataFrame, priority: str, enqueued: str, tie: str) -> DataFrame:
    """Tasks by priority (critical first), first come first served inside."""
    rank = F.when(F.col(priority) == "critical", 0).when(F.col(priority) == "high", 1).when(F.col(priority) == "normal", 2).otherwise(3)
    return tasks.withColumn("priority_rank", rank).orderBy("priority_rank", enqueued, tie)


class Limit(NamedTuple):
    """The concurrency of a key: its level, what a refusal multiplies it by, the runs
    of successes and refusals, and when the level last changed."""

    level: int = 5
    factor: float = 0.8
    successes: int = 0
    refusals: int = 0
    changed_ms: int | None = None


#: Bounds of the level, growth, least factor and its step, runs, cooldown.
LEAST_LEVEL, MOST_LEVEL, GROWTH, LEAST_FACTOR, FACTOR_STEP, SUCCESS_RUN, REFUSAL_RUN, COOLDOWN_MS = 1, 100, 1.1, 0.5, 0.1, 10, 3, 5_000
#: How each outcome moves the runs: what it adds to a run, or None to end it.
_RUNS = {"success": (1, None), "refused": (None, 1), "failed": (0, None)}


def outcome_of(ok: bool, code: int) -> str:
    """Code 429 is a refusal; other errors are failures."""
    return "success" if ok else "refused" if code == 429 else "failed"


def _counted(limit: Limit, outcome: str) -> Limit:
    runs = (limit.successes, limit.refusals)
    moved = [0 if step is None else run + step for run, step in zip(runs, _RUNS[outcome], strict=True)]
    return limit._replace(successes=moved[0], refusals=moved[1])


def _wanted(limit: Limit, outcome: str) -> int:
    scale = {"success": GROWTH if limit.successes >= SUCCESS_RUN else 1.0, "refused": limit.factor, "failed": 1.0}[outcome]
    return min(MOST_LEVEL, max(LEAST_LEVEL, int(limit.level * scale)))


def advance(limit: Limit, at_ms: int, outcome: str) -> Limit:
    """The limit after an outcome; outcomes within the cooldown of a change don't count."""
    if limit.changed_ms is not None and at_ms < limit.changed_ms + COOLDOWN_MS:
        return limit
    counted = _counted(limit, outcome)
    level = _wanted(counted, outcome)
    if level == counted.level:
        return counted
    changed = counted._replace(level=level, changed_ms=at_ms)
    if level > counted.level:
        return changed._replace(successes=0)
    steps = int(counted.refusals >= REFUSAL_RUN)
    return changed._replace(factor=max(LEAST_FACTOR, counted.factor - steps * FACTOR_STEP))


def admit(tasks: DataFrame, kind: str = "kind", state: str = "state", order: list[str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """``tasks`` with ``admitted``: the queued tasks of each kind that its free slots
    take, in ``order``; slots are the kind's limit less its running tasks.

    Few slots a kind: what is running is counted by a grouped aggregate, and only
    the first ``limit`` queued tasks of a kind are ranked (the rank limit applies
    in each task before the shuffle).
    """
    order = order or ["priority_rank", "enqueued"]
    table = LOCAL_LIMITS if limits is None else limits
    limit = F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()]), lambda x: x["k"] == F.col(kind)), F.lit(0))["v"], F.lit(DEFAULT_LIMIT))
    busy = tasks.groupBy(kind).agg(F.count_if(F.col(state) == "running").alias("running"))
    most = max([*table.values(), DEFAULT_LIMIT])
    first = tasks.where(F.col(state) == "queued").withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_n") <= most)
    chosen = first.join(F.broadcast(busy), kind).where(F.col("_n") <= limit - F.col("running")).drop("_n", "running")
    return chosen.withColumn("admitted", F.lit(True))


def throttled(events: DataFrame, key: str) -> DataFrame:
    """key, event_id, concurrency after each event (ts, ok, code).

    The state of a key is sequential; its events come sorted in batches, so a
    long history isn't held at once.
    """
    ship(events.sparkSession)
    rows = events.select(key, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "ok", "code")
    ordered = rows.repartition(key).sortWithinPartitions(key, "ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limit = object(), Limit()
        for batch in batches:
            out = []
            for k, ms, ok, code in zip(batch[key], batch.ms, batch.ok, batch.code, strict=True):
                limit = advance(limit if k == current else Limit(), int(ms), outcome_of(bool(ok), int(code)))
                current = k
                out.append(limit.level)
            yield pd.DataFrame({key: batch[key], "event_id": batch.event_id, "concurrency": out})

    return ordered.mapInPandas(run, f"{key} string, event_id long, concurrency int")


class Sessions(NamedTuple):
    """Live sessions of one host: the time of each application's last request."""

    last_ms: dict[str, int] = {}


#: Sessions that a host has at most, and how long an idle one lives.
MOST_SESSIONS, IDLE_MS = 50, 30 * 60 * 1000


def opened(sessions: Sessions, app: str, at_ms: int, most: int = MOST_SESSIONS, idle_ms: int = IDLE_MS) -> tuple[Sessions, str]:
    """The sessions after a request and what became of it: reused, created or refused.
    Idle sessions end first; a refused request leaves the others as they are."""
    live = {a: t for a, t in sessions.last_ms.items() if at_ms - t <= idle_ms}
    known = app in live
    if not known and len(live) >= most:
        return Sessions(live), "refused"
    return Sessions({**live, app: at_ms}), "reused" if known else "created"


def session_requests(events: DataFrame, host: str, app: str, most: int = MOST_SESSIONS, idle_ms: int = IDLE_MS) -> DataFrame:
    """host, event_id, result of each request (ts), in order; hosts are independent, and
    at most ``most`` sessions of one are held."""
    ship(events.sparkSession)
    kind = events.schema[host].dataType.simpleString()
    rows = events.select(F.col(host).alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", F.col(app).cast("string").alias("app"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sessions = object(), Sessions()
        for batch in batches:
            out = []
            for h, ms, a in zip(batch.host, batch.ms, batch.app, strict=True):
                sessions, result = opened(sessions if h == current else Sessions(), a, int(ms), most, idle_ms)
                current = h
                out.append(result)
            yield pd.DataFrame({"host": batch.host, "event_id": batch.event_id, "result": out})

    return rows.repartition("host").sortWithinPartitions("host", "ms", "event_id").mapInPandas(run, f"host {kind}, event_id long, result string")


def run_tasks(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any work on batches of task rows, in the workers; the schema is what it returns."""
    ship(rows.sparkSession)
    return rows.mapInPandas(lambda batches: map(work, batches), schema)
