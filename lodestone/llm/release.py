"""Quarantine and cascading release of turns that depend on earlier ones.

The turns of a conversation form a forest: each has one parent among the earlier turns,
or none.  A turn is tried when it has arrived and its parent has been delivered; a turn
that is given up (dead) blocks all below it.

A subtree depends on nothing but its root, so the unit of work is a tree and not a
conversation.  Roots and depths are found by pointer doubling, in as many rounds as the
logarithm of the depth.  Trees are then dealt by hash, and a task takes them in sorted
runs: the children of a run are laid out in compressed rows (CSR), a depth-first walk
with an explicit stack gives each turn its place and the end of its subtree (its Euler
interval), and one pass in that order delivers turns.  A dead turn adds one at the start
and takes it away at the end of the interval below it; where the running sum of these
differences is over zero, turns are blocked.

A tree of more than ``most_rows`` turns is cut into bands of depth that hold no more, and
a level wider than that is dealt turn by turn; bands go in order, and the turns of one
read the outcome of their parents from the table of the band before.  So a chain of n
turns takes n / ``most_rows`` rounds; nothing else depends on a tree's size.

Places in a conversation, release numbers and the running state are counted in ranges
(``ranges``), so a conversation that holds most rows is spread over many tasks.

Defined results: null text counts as empty; turns go by turn, null first, ties by the
checksum of the text, equal rows in any order; null ids and turns are written as empty in
the hashed text, and rows without conv_id are one conversation; the state is kept
modulo 2^64 (as a signed long); other columns of any name are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import ranges
from .workspace import Workspace

#: Turns of a tree that one task holds.
MOST_ROWS = 65_536
#: Attempts, the wait after the first failed one in seconds (doubled each time).
ATTEMPTS, WAIT = 4, 20
#: Fixed by the replay's definition: seconds between arrivals, range of parents, faults and repairs.
SPACING, REACH, FAULTS, OF, REPAIR = 7, 7, 20, 101, 101
DELIVERED, DEAD, BLOCKED = 0, 1, 2


def forest(nodes: DataFrame, workspace: Workspace) -> DataFrame:
    """key, place, root, depth for nodes (key, place, parent: a place of the same key, or null).

    Pointer doubling: each round halves what is left of every path to a root; the nodes
    that have reached theirs take no part in the next.
    """
    hops = workspace.save(nodes.select("key", "place", F.coalesce("parent", "place").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNull().alias("top")), "hops")
    while hops.where(~F.col("top")).limit(1).count():
        at = hops.select(F.col("key").alias("_key"), F.col("place").alias("_place"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("top").alias("_top"))
        moved = hops.where(~F.col("top")).join(at, (F.col("key") == F.col("_key")) & (F.col("up") == F.col("_place")))
        moved = moved.select("key", "place", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_top").alias("top"))
        ahead = workspace.save(hops.where("top").unionByName(moved), "hops")
        workspace.drop(hops)
        hops = ahead
    return hops.select("key", "place", F.col("up").alias("root"), "depth")


def _walk(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in depth-first order and, by place in it, the end of each one's subtree.

    ``parent`` has the node's parent, or -1; children go in the order of their numbers.
    """
    n = len(parent)
    children = np.argsort(parent, kind="stable")[np.count_nonzero(parent < 0) :].tolist()
    first = np.concatenate(([0], np.cumsum(np.bincount(parent[parent >= 0], minlength=n)))).tolist()
    order, ends, stack = np.empty(n, np.int64), np.empty(n, np.int64), []
    at = 0
    for root in np.flatnonzero(parent < 0).tolist():
        stack.append(root)
        while stack:
            node = stack.pop()
            order[at] = node
            at += 1
            stack.extend(reversed(children[first[node] : first[node + 1]]))
    # A subtree is an interval of the order; its size is found from the back.
    size, where = [1] * n, order.tolist()
    up = parent.tolist()
    for node in reversed(where):
        if up[node] >= 0:
            size[up[node]] += size[node]
    ends[:] = np.arange(n) + np.array(size, np.int64)[order]
    return order, ends


def deliver(parent: np.ndarray, arrival: np.ndarray, faulty: np.ndarray, repair: np.ndarray, unlucky: np.ndarray, given: np.ndarray, blocked: np.ndarray, attempts: int = ATTEMPTS, wait: int = WAIT) -> tuple[np.ndarray, ...]:
    """status, attempts, first and last second of each node of a forest.

    ``unlucky`` has a bit for each attempt that fails even after the repair; roots start
    at ``given`` (the delivery of a parent in an earlier band) if later than their
    arrival, and ``blocked`` ones with all below them aren't tried.
    """
    n = len(parent)
    order, ends = _walk(parent)
    status, tries = np.full(n, BLOCKED, np.int8), np.zeros(n, np.int32)
    begun, last, differ, below = np.zeros(n, np.int64), np.zeros(n, np.int64), [0] * (n + 1), 0
    up, starts, faults, repairs, bad, stop, start = (x.tolist() for x in (parent, np.maximum(arrival, given), faulty, repair, unlucky, blocked, ends))
    for place, node in enumerate(order.tolist()):
        if stop[node]:
            differ[place] += 1
            differ[start[place]] -= 1
        below += differ[place]
        if below:
            continue
        at = starts[node] if up[node] < 0 else max(starts[node], int(last[up[node]]))
        begun[node] = at
        for k in range(attempts):
            tries[node], last[node] = k + 1, at
            if not faults[node] or (at >= repairs[node] and not bad[node] >> k & 1):
                status[node] = DELIVERED
                break
            at += wait << k
        else:
            status[node] = DEAD
            if place + 1 < start[place]:
                differ[place + 1] += 1
                differ[start[place]] -= 1
    return status, tries, begun, last


_IN = ("key", "root", "salt", "place", "parent", "arrival", "faulty", "repair", "unlucky", "given", "stopped")
_OUT = "key string, place long, status byte, attempts int, first_at long, last_at long"


def _new(table: pa.Table) -> np.ndarray:
    """Whether a row is the first of its piece."""
    changed = np.ones(table.num_rows, bool)
    columns = [table[c].to_numpy(zero_copy_only=False) for c in ("key", "root", "salt")]
    changed[1:] = np.logical_or.reduce([np.asarray(c[1:] != c[:-1], bool) for c in columns])
    return changed


def _tried(pieces: DataFrame, attempts: int, wait: int) -> DataFrame:
    """Outcomes of pieces of trees (key, root, salt), which are dealt and sorted here."""
    pieces = pieces.select(*_IN).repartition("key", "root", "salt").sortWithinPartitions("key", "root", "salt", "place")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in (b for b in batches if b.num_rows):
            table = pa.Table.from_batches([*held, batch])
            # The last piece may go on in the next batch.
            starts = np.flatnonzero(_new(table))
            if starts[-1]:
                yield table.slice(0, starts[-1]).combine_chunks()
            held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in forests(batches):
            x = {name: table[name].to_numpy(zero_copy_only=False) for name in _IN}
            tree = np.cumsum(_new(table)) - 1
            span = int(x["place"].max()) + 2
            codes = tree * span + x["place"]
            # Parents in this piece; the others' outcomes are given.
            parent = np.searchsorted(codes, tree * span + x["parent"])
            parent = np.where((x["parent"] >= 0) & (codes[np.minimum(parent, len(codes) - 1)] == tree * span + x["parent"]), parent, -1)
            status, tries, begun, last = deliver(parent, x["arrival"], x["faulty"], x["repair"], x["unlucky"], x["given"], x["stopped"], attempts, wait)
            tried = status != BLOCKED
            yield pa.RecordBatch.from_arrays(
                [table["key"].combine_chunks(), table["place"].combine_chunks(), pa.array(status), pa.array(tries), pa.array(begun, mask=~tried), pa.array(last, mask=~tried)],
                ["key", "place", "status", "attempts", "first_at", "last_at"],
            )

    return pieces.mapInArrow(run, _OUT)


def outcomes(nodes: DataFrame, workspace: Workspace | None = None, attempts: int = ATTEMPTS, wait: int = WAIT, most_rows: int = MOST_ROWS) -> DataFrame:
    """key, place, status (0 delivered, 1 dead, 2 blocked), attempts, first_at, last_at.

    ``nodes``: key (string), place and parent (long; a smaller place of the key, or
    null), arrival and repair (long, seconds), faulty (boolean), unlucky (long; bit a - 1
    is set if attempt a fails after the repair, too); none but parent is null.
    """
    ws = workspace or Workspace(ship(nodes.sparkSession), "release")
    ship(nodes.sparkSession)
    known = ws.save(nodes.select("key", "place", "parent", "arrival", "faulty", "repair", "unlucky"), "nodes")
    rooted = forest(known, ws)
    widths = rooted.groupBy("key", "root", "depth").count()
    large = ws.save(widths.groupBy("key", "root").agg(F.sum("count").alias("n"), F.max("count").alias("width")).where(F.col("n") > most_rows).select(F.col("key").alias("_key"), F.col("root").alias("_root"), "width"), "large-trees")
    trees = rooted.select(F.col("key").alias("_k"), F.col("place").alias("_p"), "root", "depth")
    joined = known.join(trees, (F.col("key") == F.col("_k")) & (F.col("place") == F.col("_p"))).drop("_k", "_p")
    if not large.limit(1).count():
        given = joined.withColumns({"parent": F.coalesce("parent", F.lit(-1)), "given": F.lit(-1).cast("long"), "stopped": F.lit(False), "salt": F.lit(0).cast("long")})
        return _tried(given, attempts, wait)

    # Large trees are few enough rows a table, but not bounded: a join, not a broadcast.
    band = F.when(F.col("width").isNull(), 0).otherwise(F.floor(F.col("depth") / F.greatest(F.lit(1), F.floor(F.lit(most_rows) / F.col("width")))))
    wide = F.when(F.col("width") > most_rows, F.col("place")).otherwise(0).cast("long")
    cut = joined.join(large, (F.col("key") == F.col("_key")) & (F.col("root") == F.col("_root")), "left").withColumns({"band": band.cast("long"), "salt": wide})
    cut = ws.save(cut.drop("_key", "_root", "width"), "bands")
    found: list[DataFrame] = []
    for k in range((cut.agg(F.max("band")).first()[0] or 0) + 1):
        rows = cut.where(F.col("band") == k)
        if k:
            above = found[-1].select(F.col("key").alias("_key"), F.col("place").alias("_place"), "status", "last_at")
            rows = rows.join(above, (F.col("key") == F.col("_key")) & (F.col("parent") == F.col("_place")), "left")
            rows = rows.withColumns({"given": F.coalesce(F.when(F.col("status") == DELIVERED, F.col("last_at")), F.lit(-1)), "stopped": F.coalesce(F.col("status") != DELIVERED, F.lit(False))})
        else:
            rows = rows.withColumns({"given": F.lit(-1).cast("long"), "stopped": F.lit(False)})
        found.append(ws.save(_tried(rows.withColumn("parent", F.coalesce("parent", F.lit(-1))), attempts, wait), "band"))
    return reduce(DataFrame.unionByName, found)


def _drawn(k: int) -> Column:
    """The replay's hash k of a turn."""
    text = F.concat_ws(":", F.lit(str(k)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn")])
    return F.crc32(text.cast("binary"))


def replay(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", workspace: Workspace | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """conv_id, turn, place, parent (a place, or null), arrival, status, attempts, first_at,
    last_at, release_no, state; a row per row of ``conversations``.

    Arrivals, parents, faults and repairs are drawn from hashes of (conv_id, turn).
    Delivered turns are numbered by the second of delivery, then by turn; the state is
    the sum of number times checksum of the text up to and with this release.
    """
    ws = workspace or Workspace(ship(conversations.sparkSession), "release")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.crc32(body).alias("crc"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    placed = ranges.running(ranges.in_order(rows, "key", [F.asc_nulls_first("turn"), F.col("crc")], ws), "key", {"place": F.lit(1)}).drop("_part", "_at")
    placed = placed.withColumn("place", (F.col("place") - 1).cast("long"))
    back = _drawn(0) % REACH
    arrival = F.col("place") * SPACING
    unlucky = sum((F.when(_drawn(k + 3) % 3 == 0, 1 << k).otherwise(0) for k in range(ATTEMPTS)), F.lit(0))
    turns = ws.save(
        placed.withColumns(
            {
                "parent": F.when((back > 0) & (back <= F.col("place")), F.col("place") - back),
                "arrival": arrival,
                "faulty": _drawn(1) % OF < FAULTS,
                "repair": arrival + _drawn(2) % REPAIR,
                "unlucky": unlucky.cast("long"),
            }
        ),
        "turns",
    )
    tried = outcomes(turns, ws, most_rows=most_rows).select(F.col("key").alias("_key"), F.col("place").alias("_place"), "status", "attempts", "first_at", "last_at")
    known = ws.save(
        turns.select("key", "conv_id", "turn", "crc", "place", "parent", "arrival").join(tried, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place"))).drop("_key", "_place"),
        "outcomes",
    )
    ordered = ranges.in_order(known.where(F.col("status") == DELIVERED), "key", [F.col("last_at"), F.asc_nulls_first("turn"), F.col("place")], ws)
    numbered = ws.save(ranges.running(ordered, "key", {"release_no": F.lit(1)}), "numbered")
    released = ranges.running(numbered, "key", {"state": F.col("release_no") * F.col("crc")})
    released = released.withColumns({"release_no": F.col("release_no").cast("long"), "state": _wrapped(F.col("state"))}).drop("_part", "_at")
    rest = known.where(F.col("status") != DELIVERED).withColumns({"release_no": F.lit(None).cast("long"), "state": F.lit(None).cast("long")})
    name = F.when(F.col("status") == DELIVERED, "delivered").when(F.col("status") == DEAD, "dead").otherwise("blocked")
    return released.unionByName(rest).withColumn("status", name).drop("key", "crc")


def _wrapped(total: Column) -> Column:
    """A whole number modulo 2^64 as a signed long."""
    span = F.lit(str(1 << 64)).cast(ranges.SUM)
    low = F.pmod(total, span)
    return F.when(low >= F.lit(str(1 << 63)).cast(ranges.SUM), low - span).otherwise(low).cast("long")
