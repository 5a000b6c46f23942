"""SimHash near-dedup through a segment-popcount embedding.

Fingerprint: the text is lower-cased (A-Z only), cut into words at ASCII white
space, and every shingle of ``shingle`` words is hashed by XXH64 with seed 42;
a bit of the fingerprint is set if more than half of the hashes have it.

Search: the 64 bits form 32 segments of two bits.  The embedding is the vector
of bit counts per segment; its Manhattan distance never exceeds the Hamming
distance.  The counts are kept in unary inside one long, so that the Manhattan
distance is ``bit_count(e1 ^ e2)``.  The 32 dimensions form a grid of eight
groups.  Vectors within Manhattan distance ``d <= 4`` differ in at most four
groups, so they share the cell of at least one choice of four groups: 70 cells
a fingerprint.  The join on cells keeps a pair at the first cell it shares only,
tests the Manhattan lower bound, then the Hamming distance, all inside the join
condition.

Cells that hold more than ``max_cell`` fingerprints are taken out of the join.
Their members are first linked to three members of the cell, if within four bits, which
makes one component of a cluster of near copies.  Only where a cell has several
components, its members are linked exactly by another route: x and y are within four bits
if and only if some z is within two bits of both, so all members that reach the
same z are linked to the smallest of them.  So links are a constant number for each
member, however large a group is.

The stage that drops near-duplicates at a similarity of 0.8 (``drop_near_duplicates``)
checks the links of fingerprints (``close_texts``) by the texts' shingles; as that
similarity is beyond four bits, it also searches by the shingles (``near_copies``).

Equal fingerprints are one node before any join; components come from star
contractions; no pairs, links or components are collected.

Defined results: null text counts as empty; texts without words have
fingerprint 0 and link like any other; null ids never become a component id
unless a component has no other; repeated rows and rows that share an id each get
a row; very long texts are counted in parts; an empty table gives an empty one;
other columns of any name are ignored, or returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import near_copies
from .components import connected_components
from .near_copies import near_duplicates
from .workspace import Workspace, rows_of_keys, slices

__all__ = ["close_texts", "drop_near_duplicates", "drop_near_fingerprints", "fingerprint", "fingerprints", "links", "near_duplicates", "simhash_near_dedup"]

#: Fixed by the fingerprint's definition.
SEED = 42
GROUPS, GROUP_BITS = 8, 8
LOW_BITS = 0x5555555555555555
MAX_CELL = 256
#: Hashes that are counted at a time, which bounds memory for very long texts.
_COUNT_AT_ONCE = 65_536


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = data.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return _majority(hashes)


def _majority(hashes: list[int]) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _COUNT_AT_ONCE):
        part = np.array(hashes[k : k + _COUNT_AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """doc_id, text_sha256, fp (the fingerprint's bits as a signed long); a row per row of ``docs``."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    content = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(content, 256).alias("text_sha256"), content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [_signed(fingerprint(x.as_py(), shingle)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], ["doc_id", "text_sha256", "fp"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", id_type), T.StructField("text_sha256", T.StringType()), T.StructField("fp", T.LongType())]))


def _embedding(fp: Column) -> Column:
    """Bit counts of two-bit segments, in unary."""
    upper, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return fp.bitwiseOR(upper).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(low), 1))


def _masks(max_distance: int) -> list[int]:
    """A mask for each choice of groups that must agree."""
    return [
        sum(((1 << GROUP_BITS) - 1) << (GROUP_BITS * g) for g in chosen)
        for chosen in combinations(range(GROUPS), GROUPS - max_distance)
    ]


def _first_shared(differ: Column, mask: Column) -> Column:
    """Whether ``mask`` is made of the first groups on which two embeddings agree:
    no agreeing group below the mask's highest group lies outside the mask."""
    wrong = F.lit(False)
    for g in range(GROUPS - 1):
        group = _signed(((1 << GROUP_BITS) - 1) << (GROUP_BITS * g))
        same = differ.bitwiseAND(F.lit(group)) == 0
        outside = mask.bitwiseAND(F.lit(group)) == 0
        above = F.shiftrightunsigned(mask, GROUP_BITS * (g + 1)) != 0
        wrong = wrong | (same & outside & above)
    return ~wrong


def links(nodes: DataFrame, workspace: Workspace, max_distance: int = 4, max_cell: int = MAX_CELL) -> DataFrame:
    """Links a, b between distinct fingerprints (column ``fp``) that connect just
    those that chains of links of ``max_distance`` bits or fewer connect.

    In cells of at most ``max_cell`` every link is listed, so a member has fewer than that;
    in crowded ones a constant number for each member (``_crowd_links``).
    """
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(max_distance)])
    cells = (
        nodes.select("fp", _embedding(F.col("fp")).alias("e"))
        .select("fp", "e", F.explode(masks).alias("mask"))
        .select(F.xxhash64("mask", F.col("e").bitwiseAND(F.col("mask"))).alias("cell"), "mask", "fp")
    )
    crowded = workspace.save(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > max_cell), "crowded-cells")
    open_cells, more = cells, None
    if crowded.limit(1).count():
        open_cells = cells.join(crowded.select("cell"), "cell", "left_anti")
        more = _crowd_links(workspace.save(cells.join(crowded.select("cell"), "cell", "left_semi").select("cell", "fp"), "crowd"), max_distance, workspace)

    left = open_cells.select(F.col("cell"), F.col("mask"), F.col("fp").alias("a"))
    right = open_cells.select(F.col("cell").alias("cell2"), F.col("mask").alias("mask2"), F.col("fp").alias("b"))
    differ = _embedding(F.col("a")).bitwiseXOR(_embedding(F.col("b")))
    found = left.hint("merge").join(  # sizes are estimated without the explode
        right,
        (F.col("cell") == F.col("cell2"))
        & (F.col("mask") == F.col("mask2"))
        & (F.col("a") < F.col("b"))
        & (differ.bitwiseAND(F.col("mask")) == 0)
        & (F.bit_count(differ) <= max_distance)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
        & _first_shared(differ, F.col("mask")),
    ).select("a", "b")
    return found if more is None else found.unionByName(more)


def _crowd_links(crowd: DataFrame, max_distance: int, workspace: Workspace) -> DataFrame:
    """Links that connect the members of crowded cells (cell, fp) as all of theirs would.

    Each member is compared with three of its cell (the least, the greatest and one by
    hash), which connects a cluster of near copies.  Where a cell's members are not all in
    one component then, they go by stars.
    """
    ends = workspace.save(crowd.groupBy(F.col("cell").alias("_cell")).agg(F.array_distinct(F.array(F.min("fp"), F.max("fp"), F.min_by("fp", F.xxhash64("fp")))).alias("ends")), "ends-of-cells")
    near = F.filter("ends", lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= max_distance))
    met = crowd.hint("merge").join(ends, F.col("cell") == F.col("_cell")).select("fp", F.explode(near).alias("end"))
    anchored = workspace.save(met.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct(), "anchored")
    roots = workspace.save(connected_components(anchored, workspace).withColumnRenamed("node", "_fp"), "crowd-roots")
    placed = crowd.join(roots, F.col("fp") == F.col("_fp"), "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = workspace.save(placed.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("cell"), "mixed-cells")
    left = workspace.save(crowd.join(mixed, "cell", "left_semi").select("fp").distinct(), "crowded")
    return anchored.unionByName(_stars(left, max_distance, workspace)) if left.limit(1).count() else anchored


def _stars(members: DataFrame, max_distance: int, workspace: Workspace) -> DataFrame:
    """Links between members through their common neighbours at half the distance.

    For an even distance, ``x`` and ``y`` are that close if and only if some
    ``z`` is within half of it of both.
    """
    if max_distance % 2:
        raise ValueError("crowded cells need an even distance")
    near = members.select("fp", F.col("fp").alias("z"))
    out = near
    for _ in range(max_distance // 2):
        flips = F.expr("transform(sequence(0, 63), i -> z ^ shiftleft(1L, i))")
        near = near.select("fp", F.explode(flips).alias("z")).distinct()
        out = out.unionByName(near)
    out = out.distinct()
    centre = workspace.save(out.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "centres")
    return out.join(centre, "z").where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def simhash_near_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle: int = 4,
    max_distance: int = 4,
    max_cell: int = MAX_CELL,
    workspace: Workspace | None = None,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, component_size, text_sha256,
    keep_sha256 (hash of the text that stays with component_id); a row per row of ``docs``."""
    ws = workspace or Workspace(docs.sparkSession, "simhash")
    table = ws.save(fingerprints(docs, text_col, id_col, shingle), "fingerprints")
    # Rows in the order of their ids, null last, then of their texts' hashes.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256"))
    nodes = ws.save(table.groupBy("fp").agg(first.alias("low"), F.count("*").alias("size")), "nodes")
    roots = ws.save(
        connected_components(ws.save(links(nodes.select("fp"), ws, max_distance, max_cell), "links"), ws), "roots"
    )
    labelled = ws.save(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "size", F.coalesce("root", "fp").alias("root")), "labelled"
    )
    # Written, like every aggregate that its own rows are joined to.
    component = ws.save(labelled.groupBy("root").agg(F.min("low").alias("keep"), F.sum("size").alias("component_size")), "by-root")
    by_fp = ws.save(labelled.join(component, "root").select("fp", "keep", "component_size"), "components")
    return table.join(by_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("keep.doc_id").alias("component_id"),
        "component_size",
        "text_sha256",
        F.col("keep.text_sha256").alias("keep_sha256"),
    )


def drop_near_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each component of ``simhash_near_dedup`` stays: that with the smallest
    id, null last."""
    found = simhash_near_dedup(docs, text_col, id_col, **options)
    keep = found.select(F.struct(F.col("component_id").alias("doc_id"), F.col("keep_sha256").alias("text_sha256")).alias("_keep")).distinct()
    return rows_of_keys(docs, keep, text_col, id_col)


def close_texts(docs: DataFrame, workspace: Workspace, text_col: str = "text", id_col: str = "doc_id", max_distance: int = 4) -> DataFrame:
    """text_a, text_b: hashes of different texts whose fingerprints are linked (``links``);
    texts of one fingerprint are each linked to the one with the least hash."""
    texts = workspace.save(fingerprints(docs, text_col, id_col).select("text_sha256", "fp"), "fingerprints")
    nodes = workspace.save(texts.groupBy("fp").agg(F.min("text_sha256").alias("text")), "nodes")
    found = workspace.save(links(nodes.select("fp"), workspace, max_distance), "links")
    side = lambda x: nodes.select(F.col("fp").alias(f"_{x}"), F.col("text").alias(f"text_{x}"))
    near = found.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).select("text_a", "text_b")
    same = texts.join(side("a"), F.col("fp") == F.col("_a")).where("text_sha256 != text_a").select("text_a", F.col("text_sha256").alias("text_b")).distinct()
    return workspace.save(near.unionByName(same), "close-texts")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", workspace: Workspace | None = None, **options) -> DataFrame:
    """``docs`` without the near-duplicates that ``near_copies`` confirms: among the texts
    that fingerprints link, and among those that its own search finds beyond four bits."""
    ws = workspace or Workspace(ship(docs.sparkSession), "near-duplicates")
    return near_copies.drop_near_duplicates(docs, text_col, id_col, ws, close=close_texts(docs, ws, text_col, id_col), **options)
