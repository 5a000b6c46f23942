"""Benchmark decontamination by word windows.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and
non-ASCII characters.  The windows of the benchmark (``window`` consecutive
words of an item; a shorter item is one window) form a hash set that goes to
every executor; a scan of the documents marks every word inside an occurrence.

The benchmark is a stated query set: it is read in blocks of ``block_bytes``
bytes of text, whose indexes take some six times as much in a worker.  Each is
built once, on the driver, and a worker holds one at a time; each block is one
more scan of the same batches, and the marks of all blocks are united.  Documents
are never shuffled, so repeated passages, hot sources and copies don't matter.

Rolling hashes over the words' 64-bit hashes select candidates, which are
compared byte for byte.

Defined results: null texts have no words and stay as they are; null items and
items without words have no windows; a null ``item_id`` marks words but isn't
listed; repeated items are listed once; repeated rows each get a report, very
long texts are scanned whole, and an empty table on either side is no case of its
own; a clash with the report's column gives that one underscores in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .workspace import fresh, slices

WINDOW = 10
BLOCK_BYTES = 16 << 20

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _windows(hashes: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each width with the hashes of all windows of that many words, narrow ones first."""
    out = np.zeros(len(hashes), np.uint64)
    for width in range(1, min(max(widths, default=0), len(hashes)) + 1):
        out = out[: len(hashes) - width + 1] * _PRIME + hashes[width - 1 :]
        if width in widths:
            yield width, out


class WindowIndex:
    """Hash set of the windows of a block of items, in flat arrays.

    Some 35 bytes a word: the folded text with the bounds of its words, the item of
    each word, and for each width the sorted hashes of windows with their places.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        split = [(i, w) for i, data in items if (w := words_of(data))]
        self.ids = [i for i, _ in split]
        sizes = np.array([len(w) for _, w in split], np.int64)
        words = [w for _, own in split for w in own]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.text, self.ends = b" ".join(words), ends - 1
        self.starts = np.concatenate(([0], ends[:-1]))[: len(words)]
        self.item_of = np.repeat(np.arange(len(split), dtype=np.int32), sizes)
        hashes, first = _hashes(words), np.concatenate(([0], np.cumsum(sizes)[:-1]))[: len(sizes)]
        del words, split
        left = np.repeat(first + sizes, sizes) - np.arange(len(hashes))  # words from here to the item's end
        widths = np.minimum(sizes, window)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, rolled in _windows(hashes, sorted(set(widths.tolist()))):
            places = np.flatnonzero((np.repeat(widths, sizes) == width) & (left >= width))
            order = np.argsort(rolled[places], kind="stable")
            keys, places = rolled[places][order], places[order].astype(np.int32)
            seen = np.zeros(1 << min(26, max(10, int(8 * len(keys)).bit_length())), bool)
            seen[keys >> np.uint64(64 - int(len(seen)).bit_length() + 1)] = True
            self.tables[width] = keys, places, seen

    @property
    def nbytes(self) -> int:
        """What the index takes in memory."""
        return len(self.text) + sum(x.nbytes for x in (self.starts, self.ends, self.item_of, *(y for t in self.tables.values() for y in t)))

    def scan(self, words: list[bytes], hit: np.ndarray, items: set, hashes: np.ndarray) -> None:
        """Adds the marks of all occurrences to ``hit`` and ``items``; windows whose
        hashes agree are compared byte by byte."""
        for width, rolled in _windows(hashes, list(self.tables)):
            keys, places, seen = self.tables[width]
            maybe = np.flatnonzero(seen[rolled >> np.uint64(64 - int(len(seen)).bit_length() + 1)])
            low, high = (np.searchsorted(keys, rolled[maybe], side) for side in ("left", "right"))
            for k, a, b in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == b:
                    continue
                own = b" ".join(words[k : k + width])
                same = [p for p in places[a:b].tolist() if self.text[self.starts[p] : self.ends[p + width - 1]] == own]
                if same:
                    hit[k : k + width] = True
                    items.update(self.item_of[p] for p in same)


def _spans(data: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Byte spans of runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    if not len(edges):
        return []
    at = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _used_once(shared: Broadcast) -> WindowIndex:
    """An index that the worker doesn't keep."""
    value = shared.value
    shared.__dict__.pop("_value", None)
    return value


def _blocks_of(benchmark: DataFrame, text_col: str, id_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items with words, in blocks of at most ``block_bytes`` (or one item)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    block, held = [], 0
    for row in rows.orderBy("i", "t").toLocalIterator():
        data = row.t.encode()
        if block and held + len(data) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.i, data))
        held += len(data)
    if block:
        yield block


def decontamination_report(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    report_col: str = "contamination",
    pass_columns: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its ``pass_columns``) with a struct column ``report_col``:
    n_words, n_hit, item_ids (sorted as strings) and the byte spans of hit words."""
    spark = ship(docs.sparkSession)
    # Each index is built once, and the driver holds one at a time.
    blocks = [spark.sparkContext.broadcast(WindowIndex(b, window)) for b in _blocks_of(benchmark, item_text_col, item_id_col, block_bytes)]
    content = fresh(docs.columns, "content")
    report_col = fresh(docs.columns, report_col)
    passed = docs.columns if pass_columns is None else pass_columns
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in passed), T.StructField(report_col, REPORT)])
    names = [f.name for f in schema.fields]
    arrow_report = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = blocks[0].value if len(blocks) == 1 else None
        # With several blocks the slices are larger, so that an index is loaded for many texts.
        for batch in slices(batches) if len(blocks) <= 1 else slices(batches, 4096, 32 << 20):
            data = [x.as_py() or b"" for x in batch.column(batch.num_columns - 1)]
            words = [words_of(x) for x in data]
            hashes = [_hashes(w) if blocks else None for w in words]
            hits = [np.zeros(len(w), bool) for w in words]
            items: list[set] = [set() for _ in words]
            for block in blocks:
                index = alone or _used_once(block)
                for w, h, found, v in zip(words, hits, items, hashes, strict=True):
                    own: set[int] = set()
                    index.scan(w, h, own, v)
                    found.update(index.ids[i] for i in own)
            report = [
                {"n_words": len(w), "n_hit": int(h.sum()), "item_ids": sorted(x for x in i if x is not None), "spans": _spans(d, h)}
                for d, w, h, i in zip(data, words, hits, items, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(report, arrow_report)], names)

    body = docs.select(*[F.col(f"`{c}`") for c in names[:-1]], F.col(text_col).cast("string").cast("binary").alias(content))
    return body.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """``docs`` without contamination, with the same columns.

    mode "documents" drops contaminated documents, "spans" cuts the hit words.
    """
    name = fresh(docs.columns, "contamination")
    report = decontamination_report(docs, benchmark, text_col=text_col, report_col=name, **options)
    if mode == "documents":
        return report.where(F.col(name)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    # The pieces of the text between the spans, joined.
    data, spans = F.col(text_col).cast("binary"), F.col(name)["spans"]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(data).cast("long")))
    pieces = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.substring(data, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"),
    )
    cut = F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(F.col(text_col).cast("string"))
    return report.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
