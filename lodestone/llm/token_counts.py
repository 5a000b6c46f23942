"""Token counts at every prefix by prefix dynamic programming.

For a tokenizer of the ``tokenizers`` library whose model is a BPE with word
ends and whose pre-tokenizer drops white space, the count of a text is the sum
of the counts of its words, and every word's count comes from the table of
``PrefixBpe``.  A document gets the running count after each of its words
(``ends``: byte offsets, ``counts``), so that the count at any prefix, the
longest prefix within a budget and a truncation are look-ups; a prefix that ends
inside a word reads that word's own table.

Words are met again and again; a worker keeps the counts of a bounded number of
them.  Texts are read whole; nothing is shuffled or collected.

Defined results: null text counts as empty, which has no tokens; strings of
special tokens inside texts count as the library does by default, one token; rows
that repeat each get a row, an empty table gives none, very long texts are counted
whole, and columns of any name beside id and text are ignored (``truncate`` keeps them).
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .prefix_bpe import Memo, PrefixBpe
from .workspace import fresh, slices


def _byte_alphabet() -> list[str]:
    """The usual printable stand-ins for bytes: printable Latin-1 stays, the rest follows from U+0100."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in stay else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Counts for one tokenizer file."""

    #: Words of these characters are cut here; others go through the library's
    #: own normaliser and pre-tokenizer first.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ıĲ-ſ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["post_processor"] is not None:
            raise ValueError("a BPE with word ends is needed")
        merges = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.bpe = PrefixBpe(set(model["vocab"]), lambda a, b: merges.get((a, b)), model["end_of_word_suffix"])
        self.library = Tokenizer.from_file(path)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.alphabet = _byte_alphabet()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The file's own pattern, with the classes that the plain characters can fall in.
        letter, digit, space = "a-zß-öø-ÿā-ıĳ-ſ", "0-9", r"\s"
        self.words = re.compile(pattern.replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{digit}]").replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]"))
        self.memo, self.word_memo = Memo(), Memo()

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk, in the byte alphabet."""
        if self.PLAIN.fullmatch(chunk):
            return ["".join([self.alphabet[b] for b in w.encode()]) for w in self.words.findall(chunk.lower())]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def _word(self, word: str) -> int:
        try:
            return self.word_memo[word]
        except KeyError:
            n = self.bpe.count(word)
            self.word_memo.put(word, n)
            return n

    def chunk(self, data: bytes) -> int:
        """Tokens of a run of bytes without ASCII white space."""
        try:
            return self.memo[data]
        except KeyError:
            text, n = data.decode("utf-8", "replace"), 0
            if self.special and (found := self.special.findall(text)):
                n = len(found)
                parts = self.special.split(text)
            else:
                parts = [text]
            n += sum(self._word(w) for part in parts if part for w in self.pieces(part))
            self.memo.put(data, n)
            return n

    def prefix_table(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the ends of chunks, and the running counts there."""
        chunks = data.split()
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = list(map(self.memo.get, chunks))
        if None in found:
            found = [self.chunk(c) if n is None else n for c, n in zip(chunks, found, strict=True)]
        counts = np.cumsum(np.array(found, np.int64))
        raw = np.frombuffer(data, np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
        return ends, counts

    def count_at(self, data: bytes, ends: np.ndarray, counts: np.ndarray, at: int) -> int:
        """Tokens of ``data[:at]`` (a boundary of characters), from the stored table."""
        k = bisect_right(ends, at)
        done = int(counts[k - 1]) if k else 0
        rest = data[int(ends[k - 1]) if k else 0 : at].split()
        return done + (self.chunk(rest[0]) if rest else 0)

    def within(self, ends: np.ndarray, counts: np.ndarray, budget: int) -> int:
        """Bytes of the longest prefix of whole words within ``budget`` tokens."""
        k = bisect_right(counts, budget)
        return int(ends[k - 1]) if k else 0


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def prefix_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", tables: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, with ``tables``, the arrays ``ends`` and ``counts``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("content"))
    ship(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    if tables:
        fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("ends", "counts")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        for batch in slices(batches):
            n_bytes, n_tokens, ends, counts = [], [], [], []
            for x in batch.column(1):
                data = x.as_py()
                e, c = own.prefix_table(data)
                n_bytes.append(len(data))
                n_tokens.append(int(c[-1]) if len(c) else 0)
                if tables:
                    ends.append(e)
                    counts.append(c)
            out = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            if tables:
                out += [pa.array(x, pa.list_(pa.int64())) for x in (ends, counts)]
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, T.StructType(fields))


def truncate(docs: DataFrame, tokenizer_path: str, budget: int, text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of whole words within ``budget`` tokens."""
    ship(docs.sparkSession)
    content, names = fresh(docs.columns, "content"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        for batch in slices(batches):
            cut = [None if (d := x.as_py()) is None else d[: own.within(*own.prefix_table(d), budget)].decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array(cut, pa.string()) if c == text_col else batch.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    body = docs.select("*", F.col(text_col).cast("string").cast("binary").alias(content))
    return body.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]))
