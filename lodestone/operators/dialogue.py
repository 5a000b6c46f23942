"""Chat histories, streamed replies and the registry of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sse_payloads


def history(turns: DataFrame) -> DataFrame:
    """conv_id, messages (JSON): the first system message in front, then user and
    assistant messages with content in order; other roles go."""
    kept = turns.where("role IN ('system', 'user', 'assistant') AND length(text) > 0")
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    kept = kept.withColumn("n", n).where("role != 'system' OR n = 1")
    item = F.struct(F.when(F.col("role") == "system", -1).otherwise(F.col("turn")).alias("ord"), "role", F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(item))
    return kept.groupBy("conv_id").agg(F.to_json(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("messages"))


def last_message(turns: DataFrame, role: str) -> DataFrame:
    """The last message of a conversation if it is of ``role``, else empty."""
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m"))
    return last.select("conv_id", F.when(F.col("m.role") == role, F.col("m.text")).otherwise("").alias("text"))


def ordered_concat(rows: DataFrame, keys: list[str], order: str, text: str, out: str) -> DataFrame:
    """Texts of each key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias(out))


def sse_deltas(bodies: DataFrame, keys: list[str], body: str, order: str) -> DataFrame:
    """keys, seq, delta from server-sent event bodies."""
    shape = "struct<choices: array<struct<delta: struct<content: string>>>>"
    rows = bodies.select(*keys, order, F.posexplode(sse_payloads(F.col(body))).alias("at", "payload"))
    delta = F.from_json("payload", shape)["choices"][0]["delta"]["content"]
    return rows.select(*keys, F.struct(order, "at").alias("seq"), F.coalesce(delta, F.lit("")).alias("delta"))


def merge_tool_calls(parts: DataFrame) -> DataFrame:
    """conv_id, index: the last id and kind, names and arguments joined in order."""
    rows = parts.groupBy("conv_id", "index").agg(
        F.max_by("id", F.when(F.length("id") > 0, F.col("seq"))).alias("id"),
        F.max_by("kind", F.when(F.length("kind") > 0, F.col("seq"))).alias("kind"),
        F.array_sort(F.collect_list(F.struct("seq", "name", "arguments"))).alias("p"),
    )
    joined = lambda f: F.array_join(F.transform("p", lambda x: F.coalesce(x[f], F.lit(""))), "").alias(f)
    return rows.select("conv_id", "index", "id", "kind", joined("name"), joined("arguments"))


def running_transcript(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The transcript of a key after each part."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("transcript", F.array_join(F.collect_list(text).over(w), ""))


def running_digest(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """chars, digest (MD5) of the transcript of a key after each part.

    Transcripts grow with the square of a conversation, so they are made one after
    the other and only their digests are rows; a conversation meets in one row.
    """
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.coalesce(x[text], F.lit(""))), "")
    ends = F.aggregate(
        "p", F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.coalesce(F.length(x[text]), F.lit(0))))
    )
    each = rows.select(key, whole.alias("whole"), F.transform(F.arrays_zip("p", ends.alias("end")), lambda z: F.struct(z["p"][order].alias(order), z["end"].alias("chars"))).alias("z"))
    return each.select(key, F.explode(F.transform("z", lambda z: F.struct(z[order].alias(order), z["chars"].alias("chars"), F.md5(F.substring(F.col("whole"), F.lit(1), z["chars"]).cast("binary")).alias("digest")))).alias("z")).select(key, "z.*")


def speech_text(body: Column) -> Column:
    """The words of a recognition reply, ``ws[].cw[].w``, joined."""
    parsed = F.from_json(body, "struct<ws: array<struct<cw: array<struct<w: string>>>>>")
    return F.array_join(F.flatten(F.transform(parsed["ws"], lambda w: F.transform(w["cw"], lambda c: c["w"]))), "")


def tool_list(names: Column) -> Column:
    """JSON of a tool list for functions with these names."""
    return F.to_json(F.transform(names, lambda n: F.struct(F.lit("function").alias("type"), F.struct(n.alias("name")).alias("function"))))


def registry_models(registry: DataFrame) -> DataFrame:
    """kind, provider, model, enabled: a nested registry as rows.

    ``registry`` has defaults map<kind, provider> and providers map<provider, map<kind, model>>.
    """
    rows = registry.select("defaults", F.explode("providers").alias("provider", "models")).select("defaults", "provider", F.explode("models").alias("kind", "model"))
    enabled = F.coalesce(F.try_element_at("defaults", F.col("kind")) == F.col("provider"), F.lit(False))
    return rows.select("kind", "provider", "model", enabled.alias("enabled"))


def registry_nested(models: DataFrame) -> DataFrame:
    """provider, models (map of kind to model): the way back, for writing JSON.
    Providers without a model are left out."""
    named = models.where(F.length("model") > 0)
    return named.groupBy("provider").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "model")))).alias("models"))


def models_where(registry: DataFrame, kind: str | None = None, provider: str | None = None, model: str | None = None) -> DataFrame:
    """The registry's models of a capability, a provider or a name."""
    rows = registry_models(registry)
    for column, value in (("kind", kind), ("provider", provider), ("model", model)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def capabilities(registry: DataFrame) -> DataFrame:
    """kind, providers: who has each capability, in order."""
    return registry_models(registry).groupBy("kind").agg(F.array_sort(F.collect_set("provider")).alias("providers"))


def tool_definitions(tools: Column) -> Column:
    """JSON of a tool list from structs (name, description, parameters as JSON text)."""
    function = lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), F.parse_json(t["parameters"]).alias("parameters"))
    return F.to_json(F.transform(tools, lambda t: F.struct(F.lit("function").alias("type"), function(t).alias("function"))))


def joined_audio(parts: DataFrame, key: str, order: str, last: int = 2) -> DataFrame:
    """key, audio, complete: the Base64 parts (code, status, audio) of a key decoded and
    joined in order up to the first one with the ``last`` status; an error (code other
    than 0) ends the audio before it."""
    part = F.struct(F.col(order).alias("o"), "code", "status", F.unbase64("audio").alias("data"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("p"))
    ends = lambda cond: F.coalesce(F.array_min(F.transform(F.filter("p", cond), lambda x: x["o"])), F.lit(None))
    bounded = rows.select(key, "p", ends(lambda x: x["code"] != 0).alias("error"), ends(lambda x: (x["code"] == 0) & (x["status"] == last)).alias("end"))
    kept = F.filter("p", lambda x: (x["code"] == 0) & (F.col("error").isNull() | (x["o"] < F.col("error"))) & (F.col("end").isNull() | (x["o"] <= F.col("end"))))
    audio = F.aggregate(F.transform(kept, lambda x: F.coalesce(x["data"], F.lit(b""))), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return bounded.select(key, audio.alias("audio"), (F.col("end").isNotNull() & (F.col("error").isNull() | (F.col("end") < F.col("error")))).alias("complete"))


def until_abort(deltas: DataFrame, aborts: DataFrame, key: str, order: str) -> DataFrame:
    """Deltas before the first abort of their key (key, order); all of a key without one."""
    first = aborts.groupBy(key).agg(F.min(order).alias("_abort"))
    return deltas.join(first, key, "left").where(F.col("_abort").isNull() | (F.col(order) < F.col("_abort"))).drop("_abort")
