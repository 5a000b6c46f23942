"""A table kept by a stream of changes."""

import random

import pytest
from lodestone.streaming.kept import KeptTable

SCHEMA = "key long, seq long, op string, value string"


def _table(spark, path, buckets=4):
    return KeptTable(str(path), spark.createDataFrame([], SCHEMA).schema, "key", ["seq"], "op = 'D'", buckets)


def _expected(rows):
    last = {}
    for key, seq, op, value in rows:
        if key is not None:
            order = (seq is not None, seq or 0, op or "", value or "")
            last[key] = max(last.get(key, order), order)
    return {(k, s, o or None, v or None) for k, (_, s, o, v) in last.items() if o != "D"}


def _rows(table, spark):
    return {tuple(r) for r in table.rows(spark).collect()}


def test_batches_late_changes_deletions_and_replays(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(40), n, rng.choice("IUUD"), f"v{n}") for n in range(1, 400)]
    rng.shuffle(rows)  # late changes
    rows += [(None, 1, "I", "x"), (7, 9999, "D", None), (7, 10, "I", "late")]
    table = _table(spark, tmp_path / "t")
    for epoch, at in enumerate(range(0, len(rows), 150)):
        batch = spark.createDataFrame(rows[at : at + 150] + rows[at : at + 5], SCHEMA)
        assert table.apply(batch, epoch) and _rows(table, spark) == _expected(rows[: at + 150])
        assert not table.apply(batch, epoch) and not table.apply(batch, 0)
        assert _rows(table, spark) == _expected(rows[: at + 150])
    assert not table.apply(batch.limit(0), 9) and not table.apply(batch.where("key IS NULL"), 10)
    assert table.vacuum(spark) == 8 and table.vacuum(spark) == 0
    assert _rows(table, spark) == _expected(rows) and 7 not in {r[0] for r in _rows(table, spark)}


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path / "t")
    first, second = [(k, 1, "I", "a") for k in range(20)], [(k, 2, "U", "b") for k in range(10)]
    table.apply(spark.createDataFrame(first, SCHEMA), 0)
    broken = _table(spark, tmp_path / "t")

    def fail(*_):
        raise OSError("lost")

    commits = broken._commits
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: fail() if schema == "epoch long, bucket int" and data else create(self, data, schema, **k))
    with pytest.raises(OSError):
        broken.apply(create(spark, second, SCHEMA), 1)  # its buckets are written, its commit isn't
    monkeypatch.undo()
    assert commits(spark).where("epoch = 1").count() == 0 and _rows(table, spark) == _expected(first)
    assert table.apply(spark.createDataFrame(second, SCHEMA), 1)
    assert _rows(table, spark) == _expected(first + second)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = _table(spark, tmp_path / "t", 16)
    table.apply(spark.createDataFrame([(k, 1, "I", "a") for k in range(200)], SCHEMA), 0)
    table.apply(spark.createDataFrame([(3, 2, "U", "b")], SCHEMA), 1)
    assert sorted(table._versions(spark).values()) == [0] * 15 + [1]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    table, folder, rows = _table(spark, tmp_path / "t"), str(tmp_path / "in"), []
    for n in range(3):
        part = [(k, n, "D" if k == n else "U", f"{n}") for k in range(n, 12)]
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        table.keep(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
        assert _rows(table, spark) == _expected(rows)
    assert table._commits(spark).select("epoch").distinct().count() == 3
    table.keep(spark.readStream.schema(SCHEMA).parquet(folder))
    assert _rows(table, spark) == _expected(rows)


def test_columns_with_reserved_names(spark, tmp_path):
    with pytest.raises(ValueError):
        KeptTable(str(tmp_path), spark.createDataFrame([], "key long, seq long, gone int").schema, "key", ["seq"], "false")
