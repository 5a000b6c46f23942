"""Catalog of projects, documents and chunks as snapshots of tables.

Plain Parquet has no in-place update, so a change is a new snapshot: anti joins
delete, a patch is joined and coalesced, an upsert keeps the latest row of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a document, and of a project.
UNPROCESSED, PARSED, CHUNKED, VECTORISED = range(4)
ACTIVE, PAUSED, DELETED, BUILDING, ERROR = range(1, 6)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables, the highest version of each key."""
    return latest(old.unionByName(new), keys, F.desc(version))


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of ``patch`` where it has some."""
    changed = [c for c in patch.columns if c != key]
    joined = rows.join(patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns])


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys in ``gone``."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def delete_paths(rows: DataFrame, gone: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is neither in ``gone`` nor below one that is.

    Each path meets the deleted ones by its own prefixes, an equi-join.
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = rows.select(path, F.explode(prefixes).alias("_prefix")).join(gone.select(F.col(path).alias("_prefix")).distinct(), "_prefix", "left_semi")
    return rows.join(hit.select(path).distinct(), path, "left_anti")


def _escaped(text: str) -> str:
    """``text`` for LIKE, where its own wildcards are plain characters."""
    return "".join("\\" + c if c in "%_\\" else c for c in text)


def search_names(rows: DataFrame, query: str, columns: list[str], order: str, tie: str) -> DataFrame:
    """Rows with ``query`` (without case) in a column, newest first."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{_escaped(query)}%"), F.lit(False))
    return rows.where(found).orderBy(F.desc(order), tie)


def placed(rows: DataFrame, keys: list[str], order: str, ties: list[str], out: str = "place", parts: int = 64) -> DataFrame:
    """``rows`` with their place (from 1) within ``keys`` by ``order`` (a number or time,
    null first), then ``ties``.

    The rows of a key are ranked in ``parts`` ranges of ``order``, whose bounds are
    quantiles of the whole table, and a range starts after the rows of those before
    it; so a key that holds most rows is ranked by many tasks.
    """
    cuts = rows.agg(F.percentile_approx(F.col(order), [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    slot = F.lit(0)
    if cuts:
        slot = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))) + 1)
    dealt = rows.withColumn("_slot", slot)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_slot").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("r._slot") == F.col("s._slot")]
    matched = dealt.alias("r").join(sizes.alias("s"), same).select("r.*", "s._before")
    inside = Window.partitionBy(*keys, "_slot").orderBy(F.asc_nulls_first(order), *ties)
    return matched.withColumn(out, F.row_number().over(inside) + F.col("_before")).drop("_slot", "_before")


def collision_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``unique_name``: a name that was there before gets the count before its dot."""
    numbered = placed(rows, [name], order[0], order[1:], "_n")
    stem, ext, n = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2), F.col("_n") - 1
    return numbered.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))).drop("_n")


def reconcile(statuses: DataFrame, stored: DataFrame, key: str = "file") -> DataFrame:
    """Statuses agreed with the stored data: success without data goes, what was
    under way becomes an error (3), data without a status becomes a success (1)."""
    have = stored.select(key).distinct()
    lost = statuses.where("status = 1").join(have, key, "left_anti").select(key)
    kept = statuses.join(lost, key, "left_anti").withColumn("status", F.when(F.col("status") == 0, 3).otherwise(F.col("status")))
    return kept.select(key, "status").unionByName(have.join(statuses, key, "left_anti").select(key, F.lit(1).alias("status")))


def stale(listing: DataFrame, index: DataFrame, key: str, modified: str) -> DataFrame:
    """key, action: create, update, skip or delete."""
    a, b = listing.select(key, F.col(modified).alias("_a")), index.select(key, F.col(modified).alias("_b"))
    action = F.when(F.col("_b").isNull(), "create").when(F.col("_a").isNull(), "delete").when(F.col("_a") != F.col("_b"), "update").otherwise("skip")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def config_layers(defaults: DataFrame, settings: DataFrame, runtime: DataFrame) -> DataFrame:
    """key, value: the runtime's, else the settings', else the default."""
    names = defaults.select("key").union(settings.select("key")).union(runtime.select("key")).distinct()
    out = names
    for label, layer in (("r", runtime), ("s", settings), ("d", defaults)):
        out = out.join(layer.select("key", F.col("value").alias(label)), "key", "left")
    return out.select("key", F.coalesce("r", "s", "d").alias("value"))


def evict(cache: DataFrame, limit: int, parts: int = 64) -> DataFrame:
    """Entries (index_id, size, last_access) that go, least recently used first,
    until the rest fits.  Sums run inside ranges of the last access, each of which
    starts at the sum of the newer ranges."""
    cuts = cache.agg(F.percentile_approx("last_access", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    slot = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("last_access"))) if cuts else F.lit(0)
    dealt = cache.withColumn("_slot", F.when(F.col("last_access").isNull(), -1).otherwise(slot))
    newer = Window.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sums = dealt.groupBy("_slot").agg(F.sum("size").alias("_sum")).withColumn("_newer", F.coalesce(F.sum("_sum").over(newer), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_slot").orderBy(F.desc("last_access"), "index_id").rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.join(F.broadcast(sums), "_slot").withColumn("_held", F.sum("size").over(inside) + F.col("_newer"))
    return held.where(F.col("_held") > limit).select(*cache.columns)


def with_status(docs: DataFrame, status: int, order: str = "added", tie: str = "document_id") -> DataFrame:
    """Documents in a state, newest first; a null state is the first one."""
    return docs.where(F.coalesce("status", F.lit(UNPROCESSED)) == status).orderBy(F.desc(order), tie)


def processing_states(docs: DataFrame, key: str, folder: Column, name: Column) -> DataFrame:
    """key, file_path, status, progress, legacy_status: where a document's copy lies and how
    far it is, in quarters of the way; older clients know only whether it is searchable."""
    status = F.coalesce("status", F.lit(UNPROCESSED))
    return docs.select(key, F.concat_ws("/", folder, F.lit("documents"), name).alias("file_path"), status.alias("status"), F.round(status * 100 / VECTORISED, 2).alias("progress"), F.when(status == VECTORISED, 1).otherwise(0).alias("legacy_status"))


def document_totals(docs: DataFrame, failed: Column | None = None) -> DataFrame:
    """total, processed, failed; ``failed`` tells failures from what is known of a row."""
    lost = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    return docs.agg(F.count("*").alias("total"), F.count_if((F.col("status") > UNPROCESSED) & ~lost).alias("processed"), F.count_if(lost).alias("failed"))


def advanced(docs: DataFrame, done: DataFrame, key: str, status: int, values: list[str] | None = None) -> DataFrame:
    """``docs`` where the keys in ``done`` have reached ``status`` (a state is never
    taken back), with the ``values`` columns of ``done`` stored."""
    values = values or []
    latest_done = done.select(key, *values).dropDuplicates([key]).select(key, F.lit(True).alias("_done"), *[F.col(c).alias(f"_new_{c}") for c in values])
    reached = F.when(F.col("_done"), F.greatest(F.coalesce("status", F.lit(UNPROCESSED)), F.lit(status))).otherwise(F.col("status"))
    joined = docs.join(latest_done, key, "left")
    return joined.select(*[reached.alias(c) if c == "status" else F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in docs.columns])


def accepted_chunks(chunks: DataFrame, batch: str, id_col: str = "id", content: str = "content", longest: int = 64) -> DataFrame:
    """The chunks of the batches in which every row has an id of 1 to ``longest``
    characters and a content; one bad row rejects its batch."""
    good = F.coalesce(F.length(id_col).between(1, longest) & (F.length(content) > 0), F.lit(False))
    bad = chunks.where(~good).select(batch).distinct()
    return chunks.join(bad, chunks[batch].eqNullSafe(bad[batch]), "left_anti")


def inserted_chunks(documents: DataFrame, key: str, parts: str) -> DataFrame:
    """key, chunk_index, content: a document's list of chunks as rows, in list order.
    Written as one Parquet job, they are there all or not at all."""
    return documents.select(key, F.posexplode(parts).alias("chunk_index", "content"))


def owners(documents: DataFrame, asked: DataFrame, key: str, project: str) -> DataFrame:
    """key, project: the first project that has each document asked for; null if none has."""
    found = documents.join(asked.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(project).alias(project))
    return asked.select(key).distinct().join(found, key, "left")


def document_list(statuses: DataFrame, lines: DataFrame, cached: DataFrame, success: int = 1) -> DataFrame:
    """file, status, content: every file, with the first line (by id) of those that
    succeeded: the stored one, else the cached one."""
    first = lambda rows, name: rows.groupBy("file").agg(F.min_by("content", "id").alias(name))
    joined = statuses.join(first(lines, "_stored"), "file", "left").join(first(cached, "_cached"), "file", "left")
    return joined.select("file", "status", F.when(F.col("status") == success, F.coalesce("_stored", "_cached")).alias("content"))


def cache_statistics(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """entries, size, hit_rate (0 without requests); a request hits if its index is held."""
    held = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    known = cache.select("index_id").distinct().withColumn("_hit", F.lit(1))
    rate = requests.join(known, "index_id", "left").agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)).alias("hit_rate"))
    return held.join(rate)  # one row each


def projects_of(projects: DataFrame, app_id: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Projects that aren't deleted, of an application or with given ids."""
    rows = projects.where(F.col("status") != DELETED)
    rows = rows if app_id is None else rows.where(F.col("app_id") == app_id)
    return rows if ids is None else rows.where(F.col("project_id").isin(ids))


def project_totals(documents: DataFrame, project: str, size: str, key: str) -> DataFrame:
    """project, documents, chars, first_id: what a project holds."""
    return documents.groupBy(F.col(project).alias("project")).agg(F.count("*").alias("documents"), F.sum(size).alias("chars"), F.min(key).alias("first_id"))


def project_updated(projects: DataFrame, totals: DataFrame) -> DataFrame:
    """Projects with their current totals; a project without documents has none."""
    new = totals.select(F.col("project").alias("project_id"), F.col("documents").alias("_n"))
    return projects.join(new, "project_id", "left").withColumn("total_documents", F.coalesce("_n", F.lit(0))).drop("_n").select(*projects.columns)


def copies(rows: DataFrame, key: str, content: str) -> DataFrame:
    """hash, copies, first_id: contents that more than one row has."""
    return rows.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def next_id(rows: DataFrame, key: str) -> DataFrame:
    """The number after the largest one; 0 for an empty table."""
    return rows.agg(F.coalesce(F.max(key) + 1, F.lit(0)).alias("next_id"))


def missing(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of the catalog whose key isn't stored."""
    return rows.join(stored.select(key), key, "left_anti")


def upkeep(index: DataFrame, events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``index`` after file events (key, action, and the columns of ``index``): the last
    event of a key decides; ``create`` replaces its row, ``delete`` takes it away."""
    last = latest(events, [key], *order)
    kept = index.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("action = 'create'").select(*index.columns))


def delete_matching(rows: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Rows whose path fits none of the patterns; ``*`` is any run of characters, ``?`` is one."""
    sql = ["".join({"*": "%", "?": "_"}.get(c, _escaped(c)) for c in p) for p in patterns]
    hit = F.lit(False)
    for p in sql:
        hit = hit | F.col(path).like(p)
    return rows.where(~F.coalesce(hit, F.lit(False)))


def without_gone(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed: files deleted while they were under way, sessions
    of clients that left.  Either side may be a stream, the list a table."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
