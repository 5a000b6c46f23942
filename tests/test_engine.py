"""The service end to end."""

import json

import pytest

from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import embedding


def test_upload_index_search_delete(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("a.txt", "cats and dogs. " * 60), ("b.pdf", "ships and harbours at sea"), ("c.txt", "")], "file string, text string")
    model = engine.models()[0]
    added = engine.upload("app", files, model).collect()
    assert {r.file for r in added} == {"a.txt", "b.pdf", "c.txt"} and {r.status for r in added} == {0}
    again = engine.upload("app", files, model)
    assert again.count() == 3 and engine.table("documents", "app").count() == 3
    n = engine.build_index("app", model)
    assert n == engine.table("chunks", "app").count() > 2 and engine.build_index("app", model) == 0
    top = engine.search("app", "harbours and ships", 1).first()
    assert top.file == "b.pdf" and top.rank == 1 and 0 < top.similarity <= 1 and top.content.startswith("ships")
    assert json.loads(engine.search_reply("app", "sea", 2))["results"][0]["file"] == "b.pdf"
    assert engine.search("other", "sea").count() == 0
    info = {r.file: r for r in engine.documents_info("app").collect()}
    assert info["b.pdf"].status == 3 and info["c.txt"].status == 2 and info["b.pdf"].kind == "pdf"
    assert dict(map(tuple, engine.status("app").collect())) == {3: 2, 2: 1}
    assert engine.rebuild_index("app", model) == n and [r.chunk_index for r in engine.chunks("app", info["a.txt"].document_id, model).collect()] == list(range(n - 1))
    assert dict(map(tuple, engine.owner("app", [info["a.txt"].document_id, "none"]).collect())) == {info["a.txt"].document_id: model, "none": None}
    assert dict(map(tuple, engine.document_files("app").collect())) == {"a.txt": 1, "b.pdf": 1, "c.txt": 0}
    assert engine.delete_documents("app", [info["b.pdf"].document_id, "nothing"]) == 1
    assert engine.search("app", "harbours", 5).where("file = 'b.pdf'").count() == 0
    assert engine.compact(str(tmp_path / "smaller"))._stored("documents").count() == 2
    engine.destroy_index("app")
    assert engine.table("vectors", "app").count() == 0 and engine.table("documents", "app").count() == 0 and not (tmp_path / "store/vectors/app_id=app").exists()


def test_only_served_applications_upload(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), applications=["a"])
    files = spark.createDataFrame([("x.txt", "text")], "file string, text string")
    assert engine.upload("a", files, engine.models()[0]).count() == 1
    with pytest.raises(PermissionError):
        engine.upload("b", files, engine.models()[0])


def test_embedding_batches_and_replies(spark):
    rows = spark.createDataFrame([(k, f"word{k}") for k in range(40)], "id long, content string")
    provider = embedding.hashed_provider(8)
    got = embedding.embed(rows, provider, batch=7, prefix="query: ").collect()
    assert all(list(r.embedding) == provider([f"query: word{r.id}"])[0] for r in got)
    parse = lambda s: spark.range(1).select(embedding.parse_reply(F.lit(s)).alias("v")).first().v
    assert parse('{"data":[{"embedding":[1.0,2.0]},{"embedding":[3.0]}]}') == [[1.0, 2.0], [3.0]] and parse("[]") == [] and parse("x") == []
