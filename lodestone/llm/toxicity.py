"""Toxicity by a classifier chain.

Linear models predict the categories one after the other; each sees the
document's features and the probabilities of the categories before it.  A later
model is trained with out-of-fold predictions of the earlier ones, so that it
learns from probabilities as good as those it will meet.

Features are words, their beginnings of four to eight characters and their
character 4-grams, each worth ``log2(1 + occurrences)``.  Training reads a bounded
sample of labelled ids: at most ``max_positive`` and ``max_negative`` of them,
those with the least hashes, one row each.  For each category those features are
kept whose means over the sample's two kinds of rows lie farthest apart, in units
of their deviation; Spark sums their moments, and only the kept features of
sampled rows reach the driver, which fits the models by accelerated gradient
steps.  Scoring is one narrow pass over the whole texts.

Defined results: null text counts as empty; an empty text gets the intercepts'
probabilities; without labelled rows of both kinds a category's probability is
its smoothed frequency; rows that repeat each get a score, but train once; an id
with several labels has every category that one of them has; columns of ``docs``
and ``labels`` may share any names, since only ids, texts and the categories'
values meet; an empty table gives no row; ties between features go by name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .prefix_bpe import Memo
from .workspace import Workspace, fresh, slices

MAX_POSITIVE, MAX_NEGATIVE, MAX_FEATURES = 2_000, 4_000, 1_024
FOLDS, THRESHOLD = 4, 0.5
#: Words that a worker remembers, twice at most.
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word in angle brackets, its beginnings and its character 4-grams."""
    return [f"<{word}>", *(f"<{word[:n]}" for n in range(4, min(len(word), 8) + 1)), *{word[k : k + 4] for k in range(len(word) - 3)}]


def text_features(text: str) -> Counter:
    """How often each feature occurs."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for f in word_features(word):
            out[f] += n
    return out


#: A row: indexes of features, and their values.
Sparse = tuple[np.ndarray, np.ndarray]


@dataclass
class Linear:
    """A logistic model over sparse features and dense extra columns."""

    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def margin(self, rows: list[Sparse], extra: np.ndarray) -> np.ndarray:
        sums = np.array([self.weights[i] @ x for i, x in rows])
        return sums + extra @ self.extra + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: list[Sparse], extra: np.ndarray, y: np.ndarray, size: int, l2: float = 1e-3, steps: int = 120, rate: float = 0.1) -> Linear:
    """Full-batch Adam; deterministic."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return Linear(np.zeros(size), np.zeros(extra.shape[1]), float(np.log(share / (1 - share))))
    at = np.concatenate([np.full(len(i), k) for k, (i, _) in enumerate(rows)]).astype(np.int64)
    what, worth = (np.concatenate([r[k] for r in rows]) for k in range(2))
    p = np.zeros(size + extra.shape[1] + 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        margin = np.bincount(at, p[what] * worth, n) + extra @ p[size:-1] + p[-1]
        error = (_sigmoid(margin) - y) / n
        gradient = np.concatenate([np.bincount(what, error[at] * worth, size), extra.T @ error, [error.sum()]])
        gradient[:-1] += l2 * p[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear(p[:size], p[size:-1], float(p[-1]))


@dataclass
class ChainModel:
    """Categories in the order of the chain, with their models."""

    categories: list[str]
    features: list[str]
    models: list[Linear] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.index = {f: k for k, f in enumerate(self.features)}

    @classmethod
    def fit(cls, categories: list[str], features: list[str], rows: list[Sparse], labels: np.ndarray, folds: np.ndarray) -> ChainModel:
        chain = cls(categories, features)
        earlier = np.zeros((len(rows), 0))
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            out_of_fold = np.zeros(len(rows))
            for fold in range(FOLDS):
                inside, outside = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
                model = fit_linear([rows[i] for i in inside], earlier[inside], y[inside], len(features))
                out_of_fold[outside] = _sigmoid(model.margin([rows[i] for i in outside], earlier[outside]))
            chain.models.append(fit_linear(rows, earlier, y, len(features)))
            earlier = np.column_stack([earlier, out_of_fold])
        return chain

    def rows_of(self, texts: list[str], memo: Memo) -> list[Sparse]:
        """The kept features of each whole text."""
        index, out = self.index, []
        for text in texts:
            counts: dict[int, int] = {}
            for word, n in Counter(_WORD.findall(text.lower())).items():
                known = memo.get(word)
                if known is None:
                    known = tuple(index[f] for f in word_features(word) if f in index)
                    memo.put(word, known)
                for f in known:
                    counts[f] = counts.get(f, 0) + n
            ids = np.array(sorted(counts), np.int64)
            out.append((ids, np.log2(1.0 + np.array([counts[i] for i in ids.tolist()], float))))
        return out

    def probabilities(self, rows: list[Sparse]) -> np.ndarray:
        earlier = np.zeros((len(rows), 0))
        for model in self.models:
            earlier = np.column_stack([earlier, _sigmoid(model.margin(rows, earlier))])
        return earlier


def _arrow_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, rows, sum of values, sum of squares, and the sum of values in each
    category's rows; the batches hold a text and a flag for each category."""
    for batch in slices(batches, 64):
        flags = [c.to_pylist() for c in batch.columns[1:]]
        moments: dict[str, list[float]] = {}
        for text, inside in zip(batch.column(0).to_pylist(), zip(*flags), strict=True):
            for f, n in text_features(text).items():
                own, x = moments.setdefault(f, [0.0] * (3 + len(flags))), math.log2(1 + n)
                own[0] += 1
                own[1] += x
                own[2] += x * x
                for k, flag in enumerate(inside, 3):
                    own[k] += x * flag
        values = [pa.array([m[k] for m in moments.values()], pa.float64()) for k in range(3 + len(flags))]
        yield pa.RecordBatch.from_arrays([pa.array(list(moments), pa.string()), *values], ["feature", "n", "s", "q", *(f"a{k}" for k in range(len(flags)))])


def _sample(docs: DataFrame, labels: DataFrame, flags: list[Column], target: Column, text_col: str, id_col: str, max_positive: int, max_negative: int) -> DataFrame:
    """id, text, c0, c1 ...: one row for each sampled id, so ``max_positive`` and
    ``max_negative`` bound the rows however often an id repeats on either side."""
    true = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    marked = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), true(target).alias("positive"), *[true(c).cast("int").alias(f"c{k}") for k, c in enumerate(flags)])
    marked = marked.groupBy("id").agg(*[F.max(c).alias(c) for c in marked.columns[1:]])
    # Only hashes that some four times as many rows as needed pass are ranked.
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    sizes = dict(map(tuple, marked.groupBy("positive").count().collect()))

    def least(positive: bool, most: int) -> DataFrame:
        share = min(1.0, 4 * most / max(1, sizes.get(positive, 0)))
        return marked.where((F.col("positive") == positive) & (h <= int((1 << 40) * share))).orderBy(h, "id").limit(most)

    # At most max_positive + max_negative small rows.
    picked = F.broadcast(least(True, max_positive).unionByName(least(False, max_negative)))
    joined = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id")
    return joined.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *[F.max(f"c{k}").alias(f"c{k}") for k in range(len(flags))])


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    target: Column,
    text_col: str = "text",
    id_col: str = "doc_id",
    max_positive: int = MAX_POSITIVE,
    max_negative: int = MAX_NEGATIVE,
    max_features: int = MAX_FEATURES,
    workspace: Workspace | None = None,
) -> ChainModel:
    """Fit a chain.  ``target`` tells positive rows in sampling; it and the
    ``categories``, in the order of the chain, are boolean columns over ``labels``.
    The categories share the ``max_features`` features evenly."""
    ws = workspace or Workspace(ship(docs.sparkSession), "toxicity")
    names, flags = list(categories), [f"c{k}" for k in range(len(categories))]
    sample = ws.save(_sample(docs, labels, list(categories.values()), target, text_col, id_col, max_positive, max_negative), "sample")
    totals = sample.agg(F.count("*"), *[F.sum(c) for c in flags]).first()
    n, sizes = totals[0], [x or 0 for x in totals[1:]]
    sums = ["n", "s", "q", *(f"a{k}" for k in range(len(names)))]
    moments = sample.select("text", *flags).mapInArrow(_arrow_moments, "feature string, " + ", ".join(f"{c} double" for c in sums))
    moments = ws.save(moments.groupBy("feature").agg(*[F.sum(c).alias(c) for c in sums]).where("n >= 3"), "moments")
    mean = F.col("s") / F.lit(max(n, 1))
    spread = F.col("q") / F.lit(max(n, 1)) - mean * mean + F.lit(1.0 / (n + 1))
    kept: set[str] = set()
    for k, size in enumerate(sizes):
        gap = F.col(f"a{k}") / F.lit(max(size, 1)) - (F.col("s") - F.col(f"a{k}")) / F.lit(max(n - size, 1))
        best = moments.select("feature", F.round(gap * gap / spread, 9).alias("score")).orderBy(F.desc("score"), "feature").limit(max_features // len(sizes))
        kept |= {r.feature for r in best.collect()}
    features = sorted(kept)

    columns = ["ids", "worth", "key", *flags]
    empty = ChainModel(names, features)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(REMEMBERED)
        for batch in slices(batches):
            rows = empty.rows_of(batch.column(0).to_pylist(), memo)
            ids, worth = (pa.array([r[k].tolist() for r in rows], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float64())))
            yield pa.RecordBatch.from_arrays([ids, worth, *batch.columns[1:]], columns)

    indexed = sample.select("text", F.xxhash64("id").alias("key"), *flags).mapInArrow(index, f"ids array<int>, worth array<double>, key long, {', '.join(f'{c} int' for c in flags)}")
    data = sorted(indexed.collect(), key=lambda r: (r.key, r.ids))
    rows = [(np.array(r.ids, np.int64), np.array(r.worth, float)) for r in data]
    truth = np.array([[r[c] for c in flags] for r in data]).reshape(len(data), len(names))
    return ChainModel.fit(names, features, rows, truth, np.array([r.key % FOLDS for r in data]))


def score(docs: DataFrame, model: ChainModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of probabilities, one field for each category."""
    ship(docs.sparkSession)
    out_col = fresh(docs.columns, out_col)
    text = fresh([*docs.columns, out_col], "toxicity_text")
    struct = T.StructType([T.StructField(c, T.DoubleType()) for c in model.categories])
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, struct)])
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, memo = shared.value, Memo(REMEMBERED)
        for batch in slices(batches):
            p = chain.probabilities(chain.rows_of(batch.column(batch.num_columns - 1).to_pylist(), memo))
            out = pa.StructArray.from_arrays([pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])], names=chain.categories)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names)

    body = docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    return body.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ChainModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows whose last category is at least as likely as ``threshold``."""
    out_col = fresh(docs.columns, "toxicity")
    return score(docs, model, text_col, out_col).where(F.col(out_col)[model.categories[-1]] < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
