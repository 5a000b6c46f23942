"""Exact dedup by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes.  Distinct blocks are sorted
and numbered; a document becomes a list of integer names.  Adjacent names are
then paired, distinct pairs are sorted and numbered, and so on: after
``log2(blocks)`` rounds every document has one name, and two documents have the
same (rounds, name) if and only if their texts are identical.

Scale: the only shuffle that carries text is that of the distinct blocks, with
map-side combining, so a text that a third of all rows share is sent once by
each map task.  The sort key of a block is (xxhash64, rank among the distinct
blocks of that hash); the rank separates blocks whose hashes collide, so names
never do.  All later tables hold integers only, halve from round to round, and
are written to the shared folder.  The joins on names leave skewed keys to
Spark's adaptive skew join.

Defined results: null text counts as empty; an empty text has one empty block;
a null ``doc_id`` sorts below every other; of rows that agree in text and
``doc_id`` exactly one is kept; other columns of any name are ignored; a very long
text is a long list of blocks, and nothing else; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, rows_without

#: More colliding hashes than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_COLLISIONS = 100_000


def _blocks(content: Column, block_bytes: int) -> Column:
    count = F.greatest(F.ceil(F.length(content) / F.lit(block_bytes)), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(content, i * block_bytes + 1, F.lit(block_bytes))
    )


def _numbered(ws: Workspace, keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct keys with their places in sort order as integer names.

    A key's place is the number of keys in the partitions before its own, plus its
    place inside; so it depends on the set of keys only, not on how they were dealt.
    """
    placed = ws.save(keys.distinct().orderBy(*columns).withColumn("place", F.monotonically_increasing_id()), label)
    part, before, offsets = F.shiftright("place", 33), 0, []
    for k, n in sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect())):  # a row for each partition
        offsets.append((k, before))
        before += n
    table = placed.sparkSession.createDataFrame(offsets, "part long, before long")
    name = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(table), part == F.col("part")).select(*columns, name.alias("name"))
    out._lodestone_path = placed._lodestone_path
    return out


def identities(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    block_bytes: int = 4096,
    block_hash: Callable[[Column], Column] = F.xxhash64,
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_sha256, rounds, name.

    ``block_hash`` only decides the sort order and the partition of blocks; any
    function gives the same groups (tests pass one that collides).
    """
    ws = workspace or Workspace(docs.sparkSession, "exact-dedup")
    content = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), content.alias("content"))

    # The only shuffle of text: distinct blocks, combined on the map side.
    variants = ws.save(
        base.select(F.explode(_blocks(F.col("content"), block_bytes)).alias("block"))
        .select(block_hash(F.col("block")).alias("h"), "block")
        .distinct()
        .groupBy("h")
        .agg(F.count("*").alias("variants")),
        "block-hashes",
    )
    collided = variants.where("variants > 1").select("h")
    n_collided = collided.count()

    rows = base.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.sha2("content", 256).alias("sha"),
        _blocks(F.col("content"), block_bytes).alias("blocks"),
    ).select("rid", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "block"))
    h = block_hash(F.col("block"))
    first = F.col("idx") == 0
    slim = ["rid", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "n", "idx"]
    if n_collided == 0:
        keyed = ws.save(rows.select(*slim, h.alias("h"), F.lit(0).alias("r")), "blocks")
    else:
        hint = (lambda df: F.broadcast(df)) if n_collided <= MAX_BROADCAST_COLLISIONS else (lambda df: df)
        hashes = hint(collided.select(F.col("h").alias("ch")))
        # Only blocks whose hash collides keep their bytes here.
        marked = ws.save(
            rows.select(*slim, h.alias("h"), "block")
            .join(hashes, F.col("h") == F.col("ch"), "left")
            .select("rid", "doc_id", "sha", "n", "idx", "h", F.when(F.col("ch").isNotNull(), F.col("block")).alias("block")),
            "blocks-marked",
        )
        ranks = (
            marked.where("block IS NOT NULL")
            .select("h", "block")
            .distinct()
            .withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        )
        keyed = ws.save(
            marked.where("block IS NULL")
            .select("rid", "doc_id", "sha", "n", "idx", "h", F.lit(0).alias("r"))
            .unionByName(
                marked.where("block IS NOT NULL")
                .join(ranks, ["h", "block"])
                .select("rid", "doc_id", "sha", "n", "idx", "h", "r")
            ),
            "blocks",
        )

    names = _numbered(ws, keyed.select("h", "r"), ["h", "r"], "names-0")
    current = ws.save(keyed.join(names, ["h", "r"]).select("rid", "doc_id", "sha", "n", "idx", "name"), "round-0")
    ws.drop(variants, keyed, names)

    finished = [current.where("n = 1").select("rid", "doc_id", "sha", F.lit(0).alias("rounds"), "name")]
    widest = current.agg(F.max("n")).first()[0] or 1
    level = 0
    while widest > 1:
        level += 1
        even = F.col("idx") % 2 == 0
        pairs = (
            current.where("n > 1")
            .groupBy("rid", F.floor(F.col("idx") / 2).cast("int").alias("idx"))
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("sha").alias("sha"),
                F.ceil(F.first("n") / 2).cast("int").alias("n"),
                F.max(F.when(even, F.col("name"))).alias("lhs"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("rhs"),
            )
        )
        pairs = ws.save(pairs, f"pairs-{level}")
        names = _numbered(ws, pairs.select("lhs", "rhs"), ["lhs", "rhs"], f"names-{level}")
        current = ws.save(
            pairs.join(names, ["lhs", "rhs"]).select("rid", "doc_id", "sha", "n", "idx", "name"), f"round-{level}"
        )
        ws.drop(pairs, names)
        finished.append(current.where("n = 1").select("rid", "doc_id", "sha", F.lit(level).alias("rounds"), "name"))
        widest = (widest + 1) // 2
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select("rid", "doc_id", F.col("sha").alias("text_sha256"), "rounds", "name")


def exact_dedup(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = 4096, workspace: Workspace | None = None, **options
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, rounds, name; a row per row of ``docs``."""
    ws = workspace or Workspace(docs.sparkSession, "exact-dedup")
    rows = identities(docs, text_col, id_col, block_bytes, workspace=ws, **options)
    # Written, so that the join is fed by plain exchanges: a large group's side can be split.
    groups = ws.save(
        rows.groupBy("rounds", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")), "groups"
    )
    return rows.join(groups, ["rounds", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
        "rounds",
        "name",
    )


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", workspace: Workspace | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts that with the largest ``doc_id``."""
    ws = workspace or Workspace(docs.sparkSession, "exact-dedup")
    found = ws.save(exact_dedup(docs, text_col, id_col, workspace=ws, **options).select("doc_id", "text_sha256", "keep_id"), "found")
    return rows_without(docs, found.where("NOT (doc_id <=> keep_id)"), found, ws, text_col, id_col)
