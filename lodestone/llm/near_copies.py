"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Sixty-four bits of a SimHash differ by some ten bits at that similarity, beyond the reach
of the four-bit grid of ``simhash``, so candidates are found by shingles themselves and
compared exactly.

Sketch: the ``SKETCH`` smallest hashes of a text's set.  Of two texts with similarity 0.8,
89 % of either set is in the other, and so is that share of either sketch, give or take
chance; a pair counts as a candidate if the sketches have ``NEED`` of the smaller one in
common.  At similarity 0.8 a pair misses that with a chance of some 1 in 10,000, whatever
the size of the table; above, with less.

Search: a shingle is common if more than ``LIST`` sketches have it, else rare.  All pairs
that share a rare shingle are listed (at most ``LIST`` a shingle) and their rare shingles
in common counted.  A text with more rare shingles than a candidate may leave unshared
shares one with each of its candidates, so nothing is missed for it.  The others are a
crowd: copies of one text, or pages that are mostly their template.  They are searched
again among themselves by sketches of ``CROWD_SKETCH``, which pages that have but a
template in common leave.  What is still a crowd then is first compared with anchors (for
each common shingle the most typical texts that have it; the ``ANCHORS`` that share most),
which joins a group of copies of any size by a few links a member.  The rest is
exact: for each shingle of the crowd's texts that a candidate would have to share, texts in
different groups so far are compared by their sketches, those outside its largest group
with all.  So there are no rounds, groups of copies are not compared within, and pairs that
are compared (not those that come out) are many only where more than ``LIST`` pages share
over three quarters of their shingles without being alike at 0.8.

Equal sets are one node before the search; links become groups by star contractions.

Defined results: null text counts as empty; texts of fewer words than a shingle have their
whole sequence as one, texts without words are all alike; the row with the smallest id
(null last), then the smallest hash of its text, stays; rows that agree in both are one;
very long texts are hashed whole; extra columns are ignored or kept as they are; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .components import connected_components
from .workspace import Workspace, bounded, rows_without, slices

SEED = 42
#: Hashes of a sketch, and the share of the smaller sketch that a candidate has in common.
SKETCH, NEED = 48, 0.72
CROWD_SKETCH, CROWD_NEED = 256, 0.80
#: Sketches that may have a rare shingle; anchors that a text of a crowd is compared with.
LIST, ANCHORS = 8, 4


def shingle_set(data: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text (A-Z lower-cased)."""
    words = data.lower().split()
    if not words:
        return np.zeros(1, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        hashes = [digest(joined[a:b], SEED) for a, b in zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64)).view(np.int64)


def _texts(docs: DataFrame, text_col: str) -> tuple[Column, Column]:
    content = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return content, F.sha2(content, 256)


def sketches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, most: int = SKETCH) -> DataFrame:
    """doc_id, text_sha256, set_sha256, n (size of the set), sketch; a row per row of ``docs``."""
    ship(docs.sparkSession)
    content, sha = _texts(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), sha.alias("text_sha256"), content.alias("content"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("text_sha256 string, set_sha256 string, n long, sketch array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(2)]
            columns = [pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:most] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], schema.names)

    return rows.mapInArrow(run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, ws: Workspace, text_col: str, shingle: int, most: int | None = None) -> DataFrame:
    """node, n, sketch: the (``most`` smallest) hashes of the sets of ``nodes`` (node, text_sha256), from the texts."""
    content, sha = _texts(docs, text_col)
    wanted = bounded(ws.save(nodes.select("node", F.col("text_sha256").alias("_sha")), "wanted"))
    rows = docs.select(sha.alias("_own"), content.alias("content")).join(wanted, F.col("_own") == F.col("_sha")).select("node", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:most] for s in sets], pa.list_(pa.int64()))], ["node", "n", "sketch"])

    # A text may be there twice; its rows meet on the map side.
    return ws.save(rows.mapInArrow(run, "node long, n long, sketch array<long>").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")


def _search(table: DataFrame, ws: Workspace, most: int, need: float, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates a, b by rare shingles; the crowd (node); the common shingles (token, in_n)."""
    tokens = table.select("node", F.explode("sketch").alias("token"))
    common = ws.save(tokens.groupBy("token").agg(F.count("*").alias("in_n")).where(F.col("in_n") > LIST), "common")
    marked = tokens.join(bounded(common.select(F.col("token").alias("_token"))), F.col("token") == F.col("_token"), "left")
    size = F.least(F.col("n"), F.lit(most))
    own = table.select(F.col("node").alias("_node"), "n", size.alias("s"))
    # Hashes of a text that a candidate of its may lack: a partner has at least 0.8 of its
    # size, and of a set that is its own sketch at least 0.8 are in common.
    spare = F.when(F.col("n") <= most, F.col("s") - least * F.col("n")).otherwise(F.col("s") - need * F.least(F.lit(float(most)), least * F.col("n"))) + 1e-9
    counted = ws.save(marked.groupBy("node").agg(F.count("_token").alias("c")).join(own, F.col("node") == F.col("_node")).drop("_node").withColumn("spare", spare), "counted")
    rare = marked.where(F.col("_token").isNull()).select("token", "node")
    left, right = rare.select("token", F.col("node").alias("a")), rare.select(F.col("token").alias("_token"), F.col("node").alias("b"))
    shared = left.hint("merge").join(right, (F.col("token") == F.col("_token")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("r"))
    side = lambda x: counted.select(F.col("node").alias(f"_{x}"), F.col("c").alias(f"c_{x}"), F.col("s").alias(f"s_{x}"))
    pairs = shared.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    pairs = pairs.where(F.col("r") + F.least("c_a", "c_b") >= need * F.least("s_a", "s_b")).select("a", "b")
    return ws.save(pairs, "pairs"), counted.where(F.col("s") - F.col("c") <= F.col("spare")).select("node", "s", "spare"), common


def _anchored(crowd: DataFrame, common: DataFrame, ws: Workspace) -> DataFrame:
    """Candidates a, b: the texts of a crowd (node, sketch) with those of their anchors that
    share most shingles with them.

    The most typical texts, whose shingles most others have, are the middle of a group of
    copies that were each changed in their own way, and like far more of them than two
    members are like each other.
    """
    known = common.select(F.col("token").alias("_token"), "in_n")
    tokens = crowd.select("node", F.explode("sketch").alias("token")).join(known, F.col("token") == F.col("_token")).drop("_token")
    typical = ws.save(tokens.groupBy("node").agg(F.struct(F.sum("in_n").alias("in_n"), F.col("node")).alias("typical")), "typical")
    ranked = tokens.select("token", "node").join(typical.select(F.col("node").alias("_node"), "typical"), F.col("node") == F.col("_node"))
    half = F.xxhash64("node").bitwiseAND(1) == 0
    best = [F.max("typical"), F.max(F.when(half, F.col("typical"))), F.max(F.when(~half, F.col("typical")))]
    ends = ws.save(ranked.groupBy(F.col("token").alias("_token")).agg(F.array_distinct(F.array_compact(F.array(*[b["node"] for b in best], F.min("node")))).alias("ends")), "anchors")
    met = tokens.join(ends, F.col("token") == F.col("_token")).select("node", F.explode("ends").alias("anchor")).where("node != anchor")
    chosen = met.groupBy("node", "anchor").count().withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "anchor")))
    return chosen.where(F.col("place") <= ANCHORS).select(F.least("node", "anchor").alias("a"), F.greatest("node", "anchor").alias("b")).distinct()


def _rest(crowd: DataFrame, common: DataFrame, groups: DataFrame, ws: Workspace, most: int, need: float, least: float) -> DataFrame:
    """Candidates a, b of a crowd (node, n, s, sketch, spare) whose texts are in different groups so far.

    The shingles of a text go in the order of the sketches that have them, then of their
    hashes; two candidates share one of those that come before the number they may lack.
    """
    tokens = crowd.select("node", "n", "s", "spare", F.explode("sketch").alias("token")).join(common.select(F.col("token").alias("_token"), "in_n"), F.col("token") == F.col("_token"), "left")
    order = Window.partitionBy("node").orderBy(F.coalesce("in_n", F.lit(0)), "token")
    placed = tokens.withColumn("place", F.row_number().over(order)).where((F.col("place") <= F.floor("spare") + 1) & F.col("in_n").isNotNull())
    # What is left of the sketch from here on, this hash included.
    early = placed.select("token", "node", "n", "s", (F.col("s") - F.col("place") + 1).alias("left"))
    root = groups.select(F.col("node").alias("_node"), "root")
    entries = ws.save(early.join(root, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node"), "entries")
    sizes = entries.groupBy("token", "root").count()
    mixed = ws.save(sizes.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("count", "root"))["root"].alias("most"), F.count("*").alias("n_roots")).where("n_roots > 1").select("_token", "most"), "mixed")
    # Half of each hash: collisions only add to what is in common.
    marks = crowd.select(F.col("node").alias("_node"), F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("marks"))
    inside = entries.join(mixed, F.col("token") == F.col("_token")).drop("_token").join(marks, F.col("node") == F.col("_node")).drop("_node")
    few, all_ = inside.where("root != most").alias("x"), inside.alias("y")
    # Of two that both are outside the largest group, one direction is enough.  Sizes must
    # allow the similarity, and so must what both have from their first common hash on.
    c = F.col
    fits = (c("x.root") != c("y.root")) & ((c("y.root") == c("y.most")) | (c("x.node") < c("y.node"))) & (c("x.n") >= least * c("y.n")) & (c("y.n") >= least * c("x.n"))
    # Sets that are their own sketches are compared exactly.
    enough = F.when(F.greatest("x.n", "y.n") <= most, least / (1 + least) * (c("x.n") + c("y.n")) - 1e-9).otherwise(need * F.least("x.s", "y.s"))
    fits = fits & (F.least("x.left", "y.left") >= enough) & (F.size(F.array_intersect("x.marks", "y.marks")) >= enough)
    met = few.hint("merge").join(all_, (c("x.token") == c("y.token")) & fits)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose whole sets (node, sketch) are as similar as ``least``."""
    one = sets.select(F.col("node").alias("_a"), F.col("sketch").alias("x"))
    two = sets.select(F.col("node").alias("_b"), F.col("sketch").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    return joined.where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, least: float = 0.8, workspace: Workspace | None = None, table: DataFrame | None = None,
    close: DataFrame | None = None,
) -> DataFrame:
    """doc_id, text_sha256, keep_id, keep_sha256: the rows to drop, each with the row of its
    group that stays.  Groups are what links of a similarity of ``least`` or more connect.

    The sketches are made for 0.8; a higher ``least`` is met as well, a lower one isn't.
    ``table`` has the ``sketches``, if they are there already.  ``close`` has pairs of texts
    (the hashes text_a, text_b) that another search found; they are candidates as well.
    """
    ws = workspace or Workspace(ship(docs.sparkSession), "near-duplicates")
    table = ws.save(sketches(docs, text_col, id_col, shingle), "sketches") if table is None else table
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256")
    by_set = table.groupBy("set_sha256").agg(F.min(row).alias("low"), F.max(row).alias("high"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = ws.save(by_set.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("node", F.col("low.text_sha256").alias("text_sha256"))

    pairs, crowd, _ = _search(nodes.select("node", "n", "sketch"), ws, SKETCH, NEED, least)
    crowd = ws.save(crowd.select(F.col("node").alias("_node")), "crowd")
    dense = None
    if crowd.limit(1).count():
        closer = _sets(docs, named.join(crowd, F.col("node") == F.col("_node"), "left_semi"), ws, text_col, shingle, CROWD_SKETCH)
        more, dense, common = _search(closer, ws, CROWD_SKETCH, CROWD_NEED, least)
        dense = ws.save(closer.join(dense.select(F.col("node").alias("_node"), "s", "spare"), F.col("node") == F.col("_node")).drop("_node"), "dense")
        pairs = pairs.union(more).union(_anchored(dense, common, ws))
    if close is not None:
        of_text = ws.save(table.select("text_sha256", "set_sha256").distinct().join(nodes.select(F.col("set_sha256").alias("_set"), "node"), F.col("set_sha256") == F.col("_set")).select("text_sha256", "node"), "of-texts")
        side = lambda x: of_text.select(F.col("text_sha256").alias(f"_{x}"), F.col("node").alias(f"node_{x}"))
        met = close.join(side("a"), F.col("text_a") == F.col("_a")).join(side("b"), F.col("text_b") == F.col("_b")).where("node_a != node_b")
        pairs = pairs.union(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
    candidates = ws.save(pairs.distinct(), "candidates")
    met = candidates.select(F.col("a").alias("_node")).union(candidates.select("b")).distinct()
    sets = _sets(docs, named.join(met, F.col("node") == F.col("_node"), "left_semi"), ws, text_col, shingle)
    found = ws.save(_verified(candidates, sets, least), "links")
    groups = ws.save(connected_components(found, ws), "groups")
    rest = None if dense is None else ws.save(_rest(dense, common, groups, ws, CROWD_SKETCH, CROWD_NEED, least), "rest")
    if rest is not None and rest.limit(1).count():
        met = rest.select(F.col("a").alias("_node")).union(rest.select("b")).distinct()
        sets = _sets(docs, named.join(met, F.col("node") == F.col("_node"), "left_semi"), ws, text_col, shingle)
        groups = ws.save(connected_components(ws.save(found.union(_verified(rest, sets, least)), "links"), ws), "groups")

    several = nodes.where("low != high").select("node")
    roots = groups.unionByName(several.join(groups.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_anti").select("node", F.col("node").alias("root")))
    placed = ws.save(nodes.select("node", "set_sha256", "low").join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node")).select("root", "set_sha256", "low"), "placed")
    keep = ws.save(placed.groupBy("root").agg(F.min("low").alias("keep")).select(F.col("root").alias("_root"), "keep"), "kept")
    of_set = ws.save(placed.join(keep, F.col("root") == F.col("_root")).select(F.col("set_sha256").alias("_set"), "keep"), "of-sets")
    rows = table.select("doc_id", "text_sha256", "set_sha256").join(bounded(of_set), F.col("set_sha256") == F.col("_set"))
    return rows.where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_sha256") == F.col("keep.text_sha256")))).select("doc_id", "text_sha256", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_sha256").alias("keep_sha256"))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", workspace: Workspace | None = None, **options) -> DataFrame:
    """``docs`` without its ``near_duplicates``.

    Rows are told apart by id and text, so ids may be null or repeat.  Of rows that
    agree in both, one stays.
    """
    ws = workspace or Workspace(ship(docs.sparkSession), "near-duplicates")
    table = ws.save(sketches(docs, text_col, id_col, options.get("shingle", 5)), "sketches")
    gone = near_duplicates(docs, text_col, id_col, workspace=ws, table=table, **options)
    return rows_without(docs, gone, table, ws, text_col, id_col)
