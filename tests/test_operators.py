"""Queries against their SQL, plans, recall, streams and sources."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import catalog, dialogue, tasks
from lodestone.operators import vector_index as X
from lodestone.sources import readers, sinks
from lodestone.streaming import events as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations client_changes".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle(spark):
    text = plan(registry.QUERIES["knn_topk"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2 and "MapInArrow" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").repartition(3)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    scanned = X._scan(vectors, asked, "cosine", 6, lambda s: s > -9, 2, [])
    assert scanned.count() <= 2 * 3 * asked.count()


def test_vectors_of_other_widths_and_nulls(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "s"), ("b", [0.0, 2.0], "s"), ("c", [1.0], None), ("d", None, "t"), ("e", [3.0, 0.0], None)], "vec_id string, embedding array<float>, part string")
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("r", [5.0]), ("n", None)], "query_id string, embedding array<float>")
    got = [(r.query_id, r.vec_id, r.score, r["rank"]) for r in X.top_k(rows, asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q", "a", 1.0, 1), ("q", "e", 1.0, 2), ("r", "c", 1.0, 1)]
    assert {(r.query_id, r.vec_id) for r in X.top_k(rows, asked, 1, "l2", by=["part"]).collect()} == {("q", "a"), ("q", "e"), ("r", "c")}
    assert {(r.query_id, r.vec_id) for r in X.within(rows, asked, 1.0).collect()} == {("q", "a"), ("q", "e")}
    assert X.top_k(rows.limit(0), asked).count() == 0 and X.top_k(rows, asked.limit(0)).count() == 0


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["newest_first"](spark, SF))
    assert "EqualTo(lang,fr)" in text and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text and "Sort [doc_id" in text


def test_segments_are_pruned(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    X.write_segments(vectors, str(tmp_path / "v"))
    some = X.read_segments(spark, str(tmp_path / "v"), [1, 2])
    assert some.count() == vectors.where("label IN (1, 2)").count() and "PartitionFilters: [isnotnull(index_id" in plan(some).replace("#", "").replace("PartitionFilters: [index_id", "PartitionFilters: [isnotnull(index_id")


def test_recall_of_cells(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in X.top_k(vectors, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.QUERIES["ann_ivf"](spark, SF).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_recall_of_buckets(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id): r.score for r in X.top_k(vectors, asked, 10).collect()}
    got = registry.QUERIES["ann_lsh"](spark, SF).collect()
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(found) == len(got) == 10 * asked.count()
    assert len(exact.keys() & found.keys()) / len(exact) >= 0.9
    assert all(abs(exact[p] - found[p]) < 1e-6 for p in exact.keys() & found.keys())
    same = X.lsh_search(vectors, asked, 10, flips=0).where("query_id = vec_id AND rank = 1").count()
    assert same == asked.count()


@pytest.mark.parametrize("name", ["ann_ivf", "ann_lsh", "ann_pq", "ann_ivfpq"])
def test_recall_at_full_size(spark, name):
    sf = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    exact = {(r.query_id, r.vec_id) for r in X.top_k(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.QUERIES[name](spark, sf).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_search_by_index_type(spark):
    vectors = rows_of(spark, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {tuple(r) for r in X.top_k(vectors, asked, 3).collect()}
    assert {tuple(r) for r in X.search_by("Flat", vectors, asked, 3).collect()} == exact
    for kind in ("IVF", "HNSW", "PQ", "IVFPQ"):
        assert {r.query_id for r in X.search_by(kind, vectors, asked, 1).collect()} == {r[0] for r in exact}
    with pytest.raises(ValueError):
        X.search_by("tree", vectors, asked)


def test_query_blocks_give_the_same(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, X.top_k(vectors, asked, 3).collect()))
    monkeypatch.setattr(X, "BROADCAST_QUERIES", 5)
    assert sorted(map(tuple, X.top_k(vectors, asked, 3).collect())) == whole


def test_streams_agree_with_batch(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    by = registry.QUERIES["stream_rate"](spark, SF).groupBy("event_type").agg(F.sum("events").alias("n"))
    assert dict(map(tuple, by.collect())) == dict(map(tuple, rows.groupBy("event_type").count().collect()))
    batch = {tuple(r) for r in registry.QUERIES["adaptive_throttle"](spark, SF).collect()}
    assert {tuple(r) for r in registry.QUERIES["stream_throttle"](spark, SF).collect()} == batch


def test_stream_reframing(spark, tmp_path):
    parts = spark.createDataFrame([(1, 0, bytearray(b"a" * 5), False), (1, 1, bytearray(b"b" * 9), False), (1, 2, bytearray(b"c"), True), (2, 0, bytearray(b"d" * 4), True)], "id long, seq long, data binary, last boolean")
    parts.write.parquet(str(tmp_path / "parts"))
    source = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "parts"))
    got = stream.drain(stream.reframed(source, "id", 6), "reframed").orderBy("id", "frame").collect()
    assert [(r.id, bytes(r.data), r.status) for r in got] == [(1, b"aaaaab", "first"), (1, b"bbbbbb", "continue"), (1, b"bbc", "last"), (2, b"dddd", "last")]


def test_stream_upsert_sink(spark, tmp_path):
    rows = stream.read_stream(spark, SF, "events")
    write = sinks.upsert_batches(lambda epoch: str(tmp_path / f"out/{epoch}"), ["user_id"], "event_id")
    rows.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/0")).count() == rows_of(spark, "events").select("user_id").distinct().count()


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("héllo\n")
    (tmp_path / "in/sub/b.html").write_text("<p>x &lt; y</p>")
    (tmp_path / "in/sub/c.bin").write_bytes(b"\x00\x01")
    listed = readers.listing(spark, str(tmp_path / "in"))
    assert {(r.path.rpartition("/")[2], r.file_type) for r in listed.collect()} == {("a.txt", "text"), ("b.html", "html"), ("c.bin", "text")}
    assert {r.path.rpartition("/")[2] for r in readers.listing(spark, str(tmp_path / "in"), recursive=False).collect()} == {"a.txt"}
    assert {r.size for r in readers.properties(listed).collect()} == {"7", "15", "2"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    registry_ = readers.default_registry()
    assert {r.content for r in registry_.parse(files).collect()} == {"héllo\n", "x < y"}
    registry_.unregister("html")
    assert "html" not in registry_.names() and registry_.statistics()["text"] == 7
    assert {r.content for r in readers.text_files(spark, str(tmp_path / "in/a.txt")).collect()} == {"héllo\n"}
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "string_id string, int_id long")
    sinks.write_id_map(ids, str(tmp_path / "ids"))
    assert sorted(map(tuple, readers.id_map(spark, str(tmp_path / "ids")).collect())) == [("a", 1), ("b", 2)]
    sinks.write_snapshot(ids, str(tmp_path / "t"), files=1)
    sinks.append(ids, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_catalog_edges(spark):
    rows = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",)], "path string")
    assert {r.path for r in catalog.delete_paths(rows, spark.createDataFrame([("/a",), ("/c",)], "path string")).collect()} == {"/ab"}
    cache = spark.createDataFrame([("x", 5, 1), ("y", 5, 2), ("z", 5, 3)], "index_id string, size int, last_access int")
    assert {r.index_id for r in catalog.evict(cache, 10).collect()} == {"x"}


def test_dialogue_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "system", "s"), (1, 2, "system", "t"), (1, 3, "tool", "x"), (1, 4, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert dialogue.history(turns).first().messages == '[{"role":"system","content":"s"},{"role":"user","content":"a"}]'
    assert dialogue.last_message(turns, "user").first().text == ""
    nested = dialogue.registry_nested(spark.createDataFrame([("p", "Chat", "m")], "provider string, kind string, model string")).first()
    assert nested.models == {"Chat": "m"}
    assert spark.range(1).select(dialogue.tool_list(F.array(F.lit("f"))).alias("t")).first().t == '[{"type":"function","function":{"name":"f"}}]'


def test_success_rate_defaults_to_one(spark):
    empty = spark.createDataFrame([("a", None)], "k string, ok boolean")
    assert tasks.success_rate(empty.limit(0), "k", "ok").count() == 0


def test_places_of_a_hot_key(spark):
    """Places equal a plain rank, for a key with most rows, ties and nulls; stretches give the frames of one window."""
    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("k"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") % 700)).alias("ts"), (F.col("id") % 13).cast("double").alias("v"))
    plain = F.row_number().over(catalog.Window.partitionBy("k").orderBy(F.asc_nulls_first("ts"), "event_id"))
    assert catalog.placed(rows, ["k"], "ts", ["event_id"]).withColumn("plain", plain).where("place != plain").count() == 0
    w = catalog.Window.partitionBy("k").orderBy(F.asc_nulls_first("ts"), "event_id").rowsBetween(-6, 0)
    framed = tasks.rolling(rows, "k", "v", 7, 50).select("event_id", "rolling_sum")
    want = rows.select("event_id", F.sum("v").over(w).alias("rolling_sum"))
    assert framed.exceptAll(want).count() == 0 and framed.count() == 3000
    known = rows.where("ts IS NOT NULL")
    near = catalog.Window.partitionBy("k").orderBy(F.unix_millis("ts")).rangeBetween(-5999, 0)
    assert tasks.request_rate(known, "k", 5, 40).select("event_id", "recent").exceptAll(known.select("event_id", F.count("*").over(near).alias("recent"))).count() == 0
    assert catalog.placed(rows.limit(0), ["k"], "ts", []).count() == 0 and catalog.evict(spark.createDataFrame([], "index_id string, size int, last_access int"), 1).count() == 0


def test_sessions_are_reused_capped_and_expire():
    sessions, results = tasks.Sessions(), []
    for app, at in [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("c", 10_000), ("b", 10_001)]:
        sessions, result = tasks.opened(sessions, app, at, most=2, idle_ms=5_000)
        results.append(result)
    assert results == ["created", "created", "reused", "refused", "created", "created"] and set(sessions.last_ms) == {"c", "b"}


def test_session_requests_match_the_rule(spark):
    got = {r.event_id: r.result for r in registry.QUERIES["session_cap"](spark, SF).collect()}
    rows = sorted(rows_of(spark, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", F.col("user_id").cast("string").alias("app")).collect())
    live, want = {}, {}
    for r in rows:
        own = live.setdefault(r.event_type, {})
        for app in [a for a, t in own.items() if r.ms - t > 1_800_000]:
            del own[app]
        want[r.event_id] = "reused" if r.app in own else "created" if len(own) < 50 else "refused"
        if want[r.event_id] != "refused":
            own[r.app] = r.ms
    assert got == want


def test_carried_payloads(spark, tmp_path):
    text = "".join('data: {"result": "%d é"}\n\n' % k for k in range(9)) + "data: [DONE]\n"
    cuts = [0, 5, 6, 40, 41, 90, len(text)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame([(1, k, text[a:b]), (2, k, text[a:b])], "id long, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    source = spark.readStream.schema("id long, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "parts"))
    got = stream.drain(stream.carried_payloads(source, "id"), "payloads").collect()
    assert sorted(r.payload for r in got if r.id == 1) == sorted(r.payload for r in got if r.id == 2) == ['{"result": "%d é"}' % k for k in range(9)]


def test_buffered_flush(spark, tmp_path):
    spark.range(250).select(F.col("id"), F.lit("a").alias("app")).coalesce(1).write.parquet(str(tmp_path / "rows"))
    source = spark.readStream.schema("id long, app string").parquet(str(tmp_path / "rows"))
    # A timeout asks for further batches for ever, so the query is stopped when its rows are there.
    query = stream.buffered(source, "app", 100, 3_600_000).writeStream.format("memory").queryName("flushes").start()
    for _ in range(60):
        if spark.table("flushes").count() >= 2:
            break
        query.awaitTermination(1)
    query.stop()
    got = spark.table("flushes").orderBy("segment").collect()
    assert [(r.segment, len(r.ids), r.ids[0]) for r in got] == [(0, 100, 0), (1, 100, 100)]


def test_job_resumes_from_its_checkpoint(spark, tmp_path):
    def job():
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.Job(source, str(tmp_path / "out"), str(tmp_path / "check"))

    spark.range(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = job().start().wait()
    assert sum(p["rows"] for p in first.progress()) == 10
    first.pause()
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sum(p["rows"] for p in job().start().wait().progress()) == 5
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_segments_are_listed_rebuilt_and_dropped(spark, tmp_path):
    vectors, path = rows_of(spark, "embeddings"), str(tmp_path / "v")
    X.write_segments(vectors, path)
    labels = sorted(r.label for r in vectors.select("label").distinct().collect())
    assert X.segments(spark, path) == labels
    X.rebuild_segment(vectors.where(F.col("label") == labels[0]).limit(1), path, labels[0])
    assert X.read_segments(spark, path, [labels[0]]).count() == 1
    assert X.drop_segment(spark, path, labels[1]) and not X.drop_segment(spark, path, 99) and X.segments(spark, path) == [labels[0], *labels[2:]]
    assert [r.int_id for r in X.numbered_after(vectors.limit(3), "vec_id", 41).orderBy("vec_id").collect()] == [42, 43, 44]


def test_more_sources(spark, tmp_path):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 48)
    gif, bmp = b"GIF89a" + struct.pack("<HH", 300, 7), b"BM" + b"\0" * 16 + struct.pack("<ii", 70_000, 9)
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 16000 * 61)
    files = spark.createDataFrame([("p", bytearray(png)), ("g", bytearray(gif)), ("b", bytearray(bmp)), ("w", bytearray(wav)), ("x", bytearray(b"zz"))], "path string, content binary")
    got = {r.path: (r.resolution, r.duration) for r in readers.media_properties(files).collect()}
    assert got == {"p": ("640*48", None), "g": ("300*7", None), "b": ("70000*9", None), "w": (None, "000101"), "x": (None, None)}
    assert readers.first_columns(spark, "SELECT 1 AS a, 2 AS b, 3 AS c, 4 AS d").columns == ["a", "b", "c"]
    rows, report = readers.counted(spark.range(7))
    rows.collect()
    assert report()["files"] == 7 and report()["elapsed_ms"] >= 0
    for name, data in (("u.txt", "é".encode("utf-8-sig")), ("l.txt", "é".encode("latin-1")), ("w.txt", "é".encode("utf-16"))):
        (tmp_path / name).write_bytes(data)
    assert {r.content for r in readers.text_files(spark, str(tmp_path)).collect()} == {"é"}
    assert readers.installed_models(spark.createDataFrame([("nonsense",)], "body string"), "body").count() == 0
    assert tasks.run_tasks(spark.range(3), lambda f: f.assign(id=f.id * 2), "id long").agg(F.sum("id")).first()[0] == 6


def test_more_catalog(spark):
    docs = spark.createDataFrame([("a", 0, None), ("b", 3, "old"), ("c", None, None)], "id string, status int, content string")
    done = spark.createDataFrame([("a", "new"), ("b", "new"), ("a", "new")], "id string, content string")
    assert sorted((r.id, r.status, r.content) for r in catalog.advanced(docs, done, "id", 1, ["content"]).collect()) == [("a", 1, "new"), ("b", 3, "new"), ("c", None, None)]
    names = spark.createDataFrame([("100%",), ("100x",), ("a_b",), ("aXb",)], "n string")
    assert {r.n for r in catalog.search_names(names, "0%", ["n"], "n", "n").collect()} == {"100%"} and {r.n for r in catalog.delete_matching(names, ["a_b", "*%"], "n").collect()} == {"100x", "aXb"}
    tools = F.array(F.struct(F.lit("f").alias("name"), F.lit("does").alias("description"), F.lit('{"type":"object"}').alias("parameters")))
    assert spark.range(1).select(dialogue.tool_definitions(tools).alias("t")).first().t == '[{"type":"function","function":{"name":"f","description":"does","parameters":{"type":"object"}}}]'
    parts = spark.createDataFrame([(1, 0, 0, 1, "YQ=="), (1, 1, 7, 1, "Yg=="), (1, 2, 0, 2, "Yw=="), (2, 0, 0, 2, "YQ=="), (2, 1, 0, 1, "Yg==")], "k long, o long, code int, status int, audio string")
    assert {r.k: (bytes(r.audio), r.complete) for r in dialogue.joined_audio(parts, "k", "o").collect()} == {1: (b"a", False), 2: (b"a", True)}
    from lodestone.operators import embedding

    providers = embedding.Providers()
    providers.register("zero", lambda n=2: lambda texts: [[0.0] * n for _ in texts])
    assert providers.names() == ["hashed", "zero"] and providers.create("zero", n=3)(["x"]) == [[0.0] * 3]
    with pytest.raises(KeyError):
        providers.create("none")
