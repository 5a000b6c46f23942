"""Prefix trie of conversations with sums over subtrees by heavy paths.

A node is a distinct sequence of first turns (role and text).  Its identity is a digest of
the sequence that needs no pass along a whole conversation: turns are digested, blocks of
64 turns are digested up to each turn, and the full blocks of a conversation are the turns
of the same question one level up.  So no window holds more than 64 rows, however long a
conversation is, and equal sequences get equal digests.

The heavy child of a node is the one that most conversations pass through; a path goes
down heavy children until a leaf.  Where a light (other) child is entered, the conversations
are at most half of those above, so on the way to a node there are at most log2 of all
conversations such steps: they are gathered in an array for each conversation, which says
on which path each of its nodes lies, and at which level (light steps above).

Sums over subtrees go up by levels.  The nodes of a path, in arrays of at most ``BLOCK``
places, are summed from the end, and what a light path's head has is attached to its
parent before the next level is summed; that takes as many rounds as there are levels.

Defined results: null roles and texts count as empty; turns go by turn, null first, ties by
the digest of the turn; rows that repeat are turns of their own; rows without conv_id are
one conversation, which is counted, shares no beginning, is a node's conv_id only if it has
no other, and is not listed in ``ends_sha256``; a very long text counts by its digest and
length; other columns of any name are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import ranges
from .workspace import Workspace

#: Turns whose digests one window holds, and places of a path that one window sums.
DIGESTED, BLOCK = 64, 1024
#: Fixed by the rebuilding's definition: conversations that share a beginning, turns it has at most.
SHARE, TURNS = 5, 9


def numbered_turns(conversations: DataFrame, workspace: Workspace, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key (of the conversation, not null), conv_id, place (from 0), digest, n_bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    placed = ranges.running(ranges.in_order(rows, "key", [F.asc_nulls_first("turn"), F.col("digest")], workspace), "key", {"place": F.lit(1)})
    return placed.select("key", "conv_id", (F.col("place") - 1).cast("long").alias("place"), "digest", "n_bytes")


def with_shared_beginnings(turns: DataFrame, workspace: Workspace, share: int = SHARE, most: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of rebuilt conversations.

    A conversation takes its first h turns (all, if there are fewer) from the one whose id
    is the next lower multiple of ``share``, and goes on with its own turns after the first
    h; h is a hash of its id below ``most``.  The first table is as ``turns``, the second
    has key, conv_id and size, also for conversations without a turn.
    """
    own = workspace.save(turns, "turns")
    h = F.when(F.col("conv_id").isNull(), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    sizes = workspace.save(own.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n")), "sizes")
    asked = sizes.select("key", "conv_id", "n", h.alias("h"), F.concat(F.lit("="), (F.col("conv_id") - F.col("conv_id") % share).cast("string")).alias("base"))
    given = sizes.select(F.col("key").alias("base"), F.col("n").alias("base_n"))
    known = workspace.save(asked.join(given, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0)))), "beginnings")

    heads = own.where(F.col("place") < most - 1).select(F.col("key").alias("base"), "place", "digest", "n_bytes")
    lent = known.where("shared > 0").select("key", "conv_id", "base", "shared").join(heads, "base").where(F.col("place") < F.col("shared"))
    rest = own.join(known.select("key", "h", "shared"), "key").where(F.col("place") >= F.col("h"))
    rest = rest.withColumn("place", F.col("place") - F.col("h") + F.col("shared"))
    columns = ["key", "conv_id", "place", "digest", "n_bytes"]
    size = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return lent.select(columns).unionByName(rest.select(columns)), known.select("key", "conv_id", size.alias("size"))


def _prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """key, place, digest -> the same with ``node``: the digest of the sequence up to this place."""
    block = F.floor(F.col("place") / DIGESTED).cast("long")
    inside = Window.partitionBy("key", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_block", block).withColumn("node", F.sha2(F.array_join(F.collect_list("digest").over(inside), "").cast("binary"), 256))
    if longest < DIGESTED:
        return local.drop("_block")
    full = local.where(F.col("place") % DIGESTED == DIGESTED - 1).select("key", F.col("_block").alias("place"), F.col("node").alias("digest"))
    above = _prefixes(full, longest // DIGESTED).select(F.col("key").alias("_key"), (F.col("place") + 1).alias("_next"), F.col("node").alias("_above"))
    joined = local.join(above, (F.col("key") == F.col("_key")) & (F.col("_block") == F.col("_next")), "left")
    node = F.when(F.col("_above").isNull(), F.col("node")).otherwise(F.sha2(F.concat("_above", F.lit("/"), "node").cast("binary"), 256))
    return joined.withColumn("node", node).drop("_block", "_key", "_next", "_above")


def _suffix_sums(rows: DataFrame, values: list[str], longest: int) -> DataFrame:
    """``rows`` with ``values`` summed from the end of their path to this place (path: head,
    place: pos), in blocks; what the blocks after one hold is the same question one level up."""
    inside = Window.partitionBy("head", "_block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    blocked = rows.withColumn("_block", F.floor(F.col("pos") / BLOCK).cast("long"))
    local = blocked.withColumns({v: F.sum(v).over(inside) for v in values})
    if longest < BLOCK:
        return local.drop("_block")
    whole = blocked.groupBy("head", F.col("_block").alias("pos")).agg(*[F.sum(v).alias(v) for v in values])
    after = _suffix_sums(whole, values, longest // BLOCK).select(F.col("head").alias("_head"), (F.col("pos") - 1).alias("_before"), *[F.col(v).alias(f"_{v}") for v in values])
    joined = local.join(after, (F.col("head") == F.col("_head")) & (F.col("_block") == F.col("_before")), "left")
    return joined.withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).drop("_block", "_head", "_before", *[f"_{v}" for v in values])


def _ends(members: DataFrame) -> DataFrame:
    """at, ends_sha256 for members (at, conv_id): their ids, ascending, joined by commas.

    The digest of a node's list is a single sequence by definition; it is fed as the
    sorted rows pass, so memory does not grow with the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple] = []
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for node, own in groupby(pairs, lambda x: x[0]):
                text = ",".join(str(c) for _, c in own)
                if node == last and state is not None:
                    state.update(f",{text}".encode())
                    continue
                if state is not None:
                    done.append((last, state.hexdigest()))
                last, state = node, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], ["at", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (last, state.hexdigest())], ["at", "ends_sha256"])

    rows = members.where(F.col("conv_id").isNotNull()).select("at", "conv_id")
    return rows.repartition("at").sortWithinPartitions("at", "conv_id").mapInArrow(run, "at string, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """A row per node: node (its identity), parent (null for the root), depth, conv_id (the
    smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, path (the identity of its heavy path's head), level (light steps above).

    ``turns``: key, conv_id, place, digest, n_bytes; ``sizes``: key, conv_id, size.
    """
    ws = workspace or Workspace(ship(turns.sparkSession), "trie")
    ship(turns.sparkSession)
    turns, sizes = ws.save(turns, "rebuilt"), ws.save(sizes, "members")
    longest = (turns.agg(F.max("place")).first()[0] or 0) + 1
    # A node's identity is its depth and the digest of its sequence.
    at = F.concat_ws(":", F.col("depth").cast("string"), "node")
    steps = _prefixes(turns, longest).select("key", "conv_id", (F.col("place") + 1).alias("depth"), "node", "n_bytes")
    steps = ws.save(steps.unionByName(sizes.select("key", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("node"), F.lit(0).cast("long").alias("n_bytes"))).withColumn("at", at).drop("node"), "steps")

    least = F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "key")).alias("least")
    nodes = ws.save(steps.groupBy("depth", "at").agg(F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"), least), "nodes")
    above = steps.select(F.col("key").alias("_key"), (F.col("depth") + 1).alias("_depth"), F.col("at").alias("parent"))
    linked = ws.save(nodes.join(above, (F.col("least.key") == F.col("_key")) & (F.col("depth") == F.col("_depth")), "left").drop("_key", "_depth"), "linked")
    children = ws.save(linked.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_at")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "at"))["at"].alias("heavy")), "children")
    whole = ws.save(linked.join(children, F.col("at") == F.col("_at"), "left").drop("_at").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "whole")
    over = whole.select(F.col("at").alias("_at"), F.col("least.conv_id").alias("parent_conv_id"), "heavy")
    placed = ws.save(whole.drop("heavy").join(over, F.col("parent") == F.col("_at"), "left").withColumn("light", F.col("parent").isNotNull() & (F.col("heavy") != F.col("at"))).drop("_at", "heavy"), "placed")

    # The light steps of a conversation: at most log2 of all conversations.
    entered = steps.select("key", "depth", "at").join(placed.where("light").select(F.col("at").alias("_at")), F.col("at") == F.col("_at"))
    lights = ws.save(entered.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("depth", "at"))).alias("lights")), "lights")
    passed = F.filter(F.coalesce("lights", F.array().cast("array<struct<depth:bigint,at:string>>")), lambda x: x["depth"] <= F.col("depth"))
    on_paths = placed.join(lights, F.col("least.key") == F.col("_key"), "left").withColumn("_passed", passed)
    head = F.try_element_at("_passed", F.lit(-1))
    paths = on_paths.select(
        "at", "parent", "depth", F.coalesce(head["at"], F.lit("0:")).alias("head"), (F.col("depth") - F.coalesce(head["depth"], F.lit(0))).alias("pos"), F.size("_passed").alias("level"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).cast("long").alias("saved_tokens"),
    )
    levels = ws.path("paths")
    paths.write.partitionBy("level").parquet(levels)
    paths = turns.sparkSession.read.schema(paths.schema).parquet(levels)

    values, sums, attached = ["n_leaves", "saved_tokens"], [], None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, -1, -1):
        rows = paths.where(F.col("level") == level)
        if attached is not None:
            rows = rows.join(attached, F.col("at") == F.col("_at"), "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).drop("_at", *[f"_{v}" for v in values])
        summed = ws.save(_suffix_sums(rows, values, longest + 1).select("at", "parent", "head", "pos", "level", *values), "summed")
        attached = summed.where("pos = 0 AND parent IS NOT NULL").groupBy(F.col("parent").alias("_at")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        sums.append(summed.select(F.col("at").alias("_at"), F.col("head").alias("path"), "level", *values))
    totals = sums[0]
    for one in sums[1:]:
        totals = totals.unionByName(one)

    members = steps.join(sizes.select(F.col("key").alias("_key"), "size"), (F.col("key") == F.col("_key")) & (F.col("depth") == F.col("size")))
    ends = ws.save(_ends(members), "ends").withColumnRenamed("at", "_ends_at")
    out = placed.join(totals, F.col("at") == F.col("_at")).join(ends, F.col("at") == F.col("_ends_at"), "left")
    return out.select(
        F.col("at").alias("node"), "parent", "depth", F.col("least.conv_id").alias("conv_id"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "path", "level",
    )


def conversation_trie(conversations: DataFrame, workspace: Workspace | None = None, **columns: str) -> DataFrame:
    """``prefix_trie`` of conversations as they are; ``columns`` names theirs."""
    ws = workspace or Workspace(ship(conversations.sparkSession), "trie")
    turns = ws.save(numbered_turns(conversations, ws, **columns), "turns")
    return prefix_trie(turns, turns.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("size")), ws)


def rebuilt_trie(conversations: DataFrame, share: int = SHARE, most: int = TURNS, workspace: Workspace | None = None, **columns: str) -> DataFrame:
    """``prefix_trie`` of conversations rebuilt with shared beginnings."""
    ws = workspace or Workspace(ship(conversations.sparkSession), "trie")
    return prefix_trie(*with_shared_beginnings(numbered_turns(conversations, ws, **columns), ws, share, most), ws)
