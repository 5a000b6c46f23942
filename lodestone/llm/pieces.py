"""SentencePiece encoding and decoding through a relational lattice.

Texts are cut into words where no piece of the model can reach across: between
other characters and a following run of spaces, between letters and other
characters, and around a character that no piece has.  Words are counted over
all texts, and the most frequent ones are segmented once, relationally:
substrings as long as the longest piece are exploded, equi-joined to the piece
table, edges are grouped by word, and a higher-order ``aggregate`` folds the
best path (``relational_viterbi``).

The order of paths depends on the kind of the model:

* unigram tables: the sum of the pieces' scores;
* BPE models: a path stands for the merges that make its pieces, each a (rank,
  position); greedy merging takes the least one at each step, so its result is the
  path whose sorted merges come first in lexicographic order, the longer list
  before its own beginning.  Uniting two paths with the same rest doesn't change
  their order, so the fold by position is exact.  It holds if a piece ranks after
  the merges inside it, and every path is checked again pair by pair
  (``PrefixBpe.paired``); a word that fails stays out of the dictionary.

The dictionary of ``dictionary_words`` words at most goes to the workers, which
look words up and put the ids of a text together; documents are not shuffled.
The words beyond that bound, and those longer than ``LATTICE_WORD`` characters,
are segmented in the worker by ``PrefixBpe``, position by position as well.  Every text is read whole, and no result depends on the bound.

Defined results: null text encodes to null and decodes to null; an empty text
has no pieces; U+2581 decodes to a space, as in the library; repeated rows each
get a row; an empty table gives no row; columns that clash with a new one keep
their name, the new one gets underscores in front.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .prefix_bpe import PrefixBpe
from .workspace import Workspace, fresh, slices

MARK, SPACE = "▁", " "
#: Words that a dictionary holds at most, and characters of a word in it: its size is bounded.
DICTIONARY_WORDS, LATTICE_WORD = 500_000, 64
#: Words beyond the dictionary that a worker remembers.
REMEMBERED_WORDS = 60_000
#: Words that a task counts before it hands on what it has.
_COUNT_AT_ONCE = 200_000


class PieceModel:
    """Pieces of one BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        if any(" " in p for p in self.pieces):
            raise ValueError("pieces with plain spaces are not supported")
        # Words hold plain spaces, which makes most of them strings of one byte a character.
        self.pieces = [p.replace(MARK, SPACE) for p in self.pieces]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        score = {self.pieces[i]: -sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with inner spaces are not supported")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if sp.is_byte(i)}
        self.score = score
        self.bpe = PrefixBpe(set(self.ids), lambda a, b: score.get(a + b))
        self.text = [b"" if sp.is_control(i) else bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.words = re.compile(self._pattern())
        self.own: dict[str, bytes] = {}  # when there is no dictionary
        self.added: list[str] = []
        for probe in ("", " ", "a", "  two  spaces ", "line\nfeed\tand\rtab", "é中\U0001f600 \x00"):
            if self.encode([probe])[0].tolist() != sp.encode(probe):
                raise ValueError(f"the model's normaliser is not supported: {probe!r}")

    def _pattern(self) -> str:
        """Words: spaces with letters, or with other characters.  Letters that a
        piece holds beside another character count as other characters."""
        barrier = "\n" if not any("\n" in p for p in self.ids) else ""
        mixed, letter = set(), r"[^\W\d_]"
        while True:
            own = re.compile(letter)
            sides = {pair for p in self.ids for pair in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]) if bool(own.match(pair[0])) != bool(own.match(pair[1]))}
            if not sides:
                break
            mixed |= {c for pair in sides for c in pair if own.match(c)}
            if len(mixed) > 64:
                return f"{barrier}|{SPACE}*[^{SPACE}{barrier}]+|{SPACE}+" if barrier else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
            letter = r"[^\W\d_" + "".join(map(re.escape, sorted(mixed))) + "]"
        other = f"(?:(?!{letter})[^{SPACE}{barrier}])"
        return (f"{barrier}|" if barrier else "") + f"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+"

    def piece_table(self) -> list[tuple[str, int, list[int]]]:
        """piece, id and the merges that make it: rank and offset in one integer."""
        ranks = {r: k for k, r in enumerate(sorted(set(self.score.values())))}
        table = []
        for piece, i in self.ids.items():
            made = self.bpe.merges(piece)
            if made is not None:
                table.append((piece, i, sorted((ranks[r] << 31) + at for r, at in made)))
        return table

    def split(self, text: str) -> list[str]:
        """The words of a text, in which U+2581 is a space; the first one starts with a space."""
        return self.words.findall(SPACE + text.replace(MARK, SPACE)) if text else []

    def packed(self, word: str, path: list[int]) -> bytes | None:
        """Ids of a path from the lattice, where a negative number stands for a
        character without a piece; None if it isn't what merging makes of the word."""
        tokens = ["" if i < 0 else self.pieces[i] for i in path]
        chars = [chr(-1 - i) if i < 0 else t for i, t in zip(path, tokens, strict=True)]
        if "".join(chars) != word or not all(map(self.bpe.paired, ["", *tokens], [*tokens, ""])):
            return None
        ids: list[int] = []
        for i, c in zip(path, chars, strict=True):
            ids += [i] if i >= 0 else [self.bytes[x] for x in c.encode()]
        return np.array(ids, "<i4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words that are in order, without the lattice."""
        out = {}
        for word, spans in zip(words, self.bpe.encode_sorted(words), strict=True):
            ids: list[int] = []
            for a, b in spans:
                piece = word[a:b]
                if piece in self.ids:
                    ids.append(self.ids[piece])
                else:
                    ids += [self.bytes[x] for x in piece.encode("utf-8", "surrogatepass")]
            out[word] = np.array(ids, "<i4").tobytes()
        return out

    def encode(self, texts: list[str], dictionary: dict[str, bytes] | None = None) -> list[np.ndarray]:
        """Ids of each text.  The words that ``dictionary`` lacks are met together, in order,
        and stay in it until there are too many of them."""
        split, known = [self.split(t) for t in texts], self.own if dictionary is None else dictionary
        new = self._words(sorted(set().union(*split).difference(known)))
        known.update(new)
        self.added += new
        whole = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]
        if len(self.added) > REMEMBERED_WORDS:
            for word in self.added:
                known.pop(word, None)
            self.added.clear()
        return whole

    def decode(self, ids: list[int]) -> str:
        """The text; the space that encoding puts in front is taken off again."""
        data = b"".join(map(self.text.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _ids_array(rows: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([0 if r is None else len(r) for r in rows])))
    values = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, "<i4")])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=pa.array([r is None for r in rows], pa.bool_()))


def count_words(docs: DataFrame, model_path: str, text_col: str = "text", longest: int = LATTICE_WORD) -> DataFrame:
    """word, n over all whole texts; words of more than ``longest`` characters are left out."""
    ship(docs.sparkSession)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = piece_model(model_path), Counter()
        for batch in slices(batches, 256, 2 << 20):
            for x in batch.column(0):
                counts.update(model.split(x.as_py() or ""))
                if len(counts) > _COUNT_AT_ONCE:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.where(F.length("word") <= longest).groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, model_path: str, text_col: str = "text", most: int = DICTIONARY_WORDS, workspace: Workspace | None = None) -> dict[str, bytes]:
    """The ids (packed) of the ``most`` most frequent words at most, by the lattice.

    Frequencies are compared in steps of a sixteenth of a power of two, and the
    words of a step are taken all or not at all.
    """
    spark = ship(docs.sparkSession)
    ws = workspace or Workspace(spark, "pieces")
    step = F.floor(F.log2("n") * 16).cast("int")
    counted = ws.save(count_words(docs, model_path, text_col).withColumn("step", step), "words")
    least, held = 0, 0
    for row in sorted(counted.groupBy("step").count().collect(), key=lambda r: -r.step):  # at most 1,024 steps
        held += row["count"]
        if held > most:
            least = row.step + 1
            break
    table = spark.createDataFrame(piece_model(model_path).piece_table(), "piece string, id int, merges array<bigint>")
    paths = relational_merges(counted.where(F.col("step") >= least).select("word"), table, distinct=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches, 4096):
            words = batch.column(0).to_pylist()
            made = [model.packed(w, p) for w, p in zip(words, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(made, pa.binary())], ["word", "ids"])

    checked = paths.mapInArrow(run, "word string, ids binary").where("ids IS NOT NULL").toArrow()
    ws.drop(counted)
    return dict(zip(checked.column(0).to_pylist(), checked.column(1).to_pylist(), strict=True))


def encode(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    ids_col: str = "piece_ids",
    decoded_col: str | None = None,
    pass_columns: list[str] | None = None,
    dictionary_words: int = DICTIONARY_WORDS,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` (or its ``pass_columns``) with the array of piece ids of the whole
    text and, if ``decoded_col`` is given, the text that these ids decode to."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(dictionary(docs, model_path, text_col, dictionary_words, workspace))
    passed = docs.columns if pass_columns is None else pass_columns
    ids_col = fresh(passed, ids_col)
    text = fresh([*docs.columns, ids_col], "piece_text")
    fields = [*(f for f in docs.schema.fields if f.name in passed), T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col is not None:
        fields.append(T.StructField(fresh([*passed, ids_col], decoded_col), T.StringType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = piece_model(model_path), shared.value
        for batch in slices(batches, 256, 2 << 20):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            encoded = iter(model.encode([t for t in texts if t is not None], known))
            rows = [None if t is None else next(encoded) for t in texts]
            columns = [*batch.columns[:-1], _ids_array(rows)]
            if decoded_col is not None:
                columns.append(pa.array([None if r is None else model.decode(r.tolist()) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    body = docs.select(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in passed], F.col(text_col).cast("string").alias(text))
    return body.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the piece ids."""
    ship(rows.sparkSession)
    out_col = fresh(rows.columns, out_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])
    names, at = schema.names, rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches):
            texts = [None if (ids := x.as_py()) is None else model.decode(ids) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, schema)


def _lattice(words: DataFrame, pieces: DataFrame, values: list[str], distinct: bool) -> tuple[DataFrame, int]:
    """word, edges: the substrings that are pieces, and all single characters, as
    (end, width, ``values`` of the piece), in the order of ends, narrow ones first;
    and the length of the longest piece.

    Rows stay where ``distinct`` has put their word; the piece table, a vocabulary
    of fixed size, goes to them.
    """
    clean = words.select("word").where("word IS NOT NULL AND word != ''")
    clean = clean if distinct else clean.distinct()
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    starts = clean.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    spans = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("width"))
    cut = spans.select("word", "at", "width", F.substring("word", F.col("at"), F.col("width")).alias("piece"))
    scored = cut.join(F.broadcast(pieces.withColumn("known", F.lit(True))), "piece", "left").where("known OR width = 1")
    edge = F.struct((F.col("at") + F.col("width") - 1).alias("end"), "width", *values)
    return scored.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges")), longest


def _best_path(lattice: DataFrame, longest: int, zero: str, joined: str, better: str, number: str) -> DataFrame:
    """word, best: for every position the width and the number of the last edge of
    the best path to it.

    Scores are kept for the positions that an edge can still start at.  The first
    edge to a position is the one of width 1; a later one takes its place if
    ``better``.  In the SQL, ``f`` is the position that an edge ``e`` starts at,
    and ``c`` the score of the path over it.
    """
    last = f"named_struct('score', c, 'width', e.width, 'number', {number})"
    done = "concat(s.done, array(named_struct('width', element_at(s.recent, -1).width, 'number', element_at(s.recent, -1).number)))"
    cut = f"greatest(size(s.recent) - {longest}, 0)"
    fold = f"""aggregate(edges,
      named_struct('base', 0, 'recent', array(named_struct('score', {zero}, 'width', 0, 'number', 0)), 'done', cast(array() as array<struct<width: int, number: int>>)),
      (s, e) -> transform(array(transform(array(s.recent[e.end - e.width - s.base]), f -> {joined})[0]), c -> CASE
        WHEN e.width = 1 THEN named_struct('base', s.base + {cut}, 'recent', concat(slice(s.recent, {cut} + 1, {longest}), array({last})), 'done', {done})
        WHEN {better} THEN named_struct('base', s.base, 'recent', concat(slice(s.recent, 1, size(s.recent) - 1), array({last})), 'done', s.done)
        ELSE s END)[0],
      s -> slice({done}, 2, size(s.done)))"""
    return lattice.select("word", F.expr(fold).alias("best"))


def _walk_back(best: DataFrame, entry: str, kind: str) -> DataFrame:
    """word, path: ``entry`` for each edge of the best path."""
    walk = f"""aggregate(sequence(1, size(best)), named_struct('at', size(best), 'path', cast(array() as array<{kind}>)),
      (s, k) -> IF(s.at = 0, s, named_struct('at', s.at - best[s.at - 1].width, 'path', concat(array({entry}), s.path))), s -> s.path)"""
    return best.select("word", F.expr(walk).alias("path"))


def relational_viterbi(words: DataFrame, pieces: DataFrame, unknown: float = -20.0) -> DataFrame:
    """word, path (array of pieces) of the best-scoring segmentation of distinct words.

    ``words`` has a column ``word``; ``pieces`` has ``piece`` and ``score`` (a
    vocabulary of fixed size).  A character without a piece is an edge of score
    ``unknown``.  Of equal scores the shorter last piece wins.  Null and empty
    words give no row; a word that repeats gives one.
    """
    table = pieces.select("piece", F.col("score").cast("double").alias("score"))
    lattice, longest = _lattice(words, table, ["score"], distinct=False)
    best = _best_path(lattice, longest, "0D", f"f.score + coalesce(e.score, {unknown}D)", "c > element_at(s.recent, -1).score", "0")
    return _walk_back(best, "substring(word, s.at - best[s.at - 1].width + 1, best[s.at - 1].width)", "string")


def relational_merges(words: DataFrame, pieces: DataFrame, distinct: bool = False) -> DataFrame:
    """word, path (array of ids) that greedy merging makes of distinct words.

    ``pieces`` is the ``PieceModel.piece_table``: piece, id, merges.  A path's score
    is its merges in sorted order with the greatest number behind them, so that the
    longer of two lists that begin alike comes first.  A character without a piece
    is a number below 0 (its code point).  Null and empty words give no row.
    """
    lattice, longest = _lattice(words, pieces, ["id", "merges"], distinct)
    joined = "IF(e.width = 1, f.score, sort_array(concat(f.score, transform(e.merges, m -> m + (e.end - e.width)))))"
    best = _best_path(lattice, longest, f"array({(1 << 63) - 1}L)", joined, "c < element_at(s.recent, -1).score", "coalesce(e.id, -1 - ascii(substring(word, e.end, 1)))")
    return _walk_back(best, "best[s.at - 1].number", "int")
