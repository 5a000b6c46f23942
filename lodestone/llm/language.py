"""Language of pages by Bayesian fusion of evidence.

* text: likelihoods of character trigrams, from counts over a bounded sample of
  documents with known language, tempered by the length of the text;
* declared markup language: P(declared | language), from grouped counts of
  declarations against what the texts say, over all pages;
* address: a prior P(language | host), smoothed towards the registered domain,
  that towards the address suffix, that towards all pages.  Each level is a
  grouped aggregate of the texts' own posteriors over all pages; a page's own
  share is taken off before it meets the prior.

The first pass is narrow and writes a small table (no html); the levels combine
on the map side, so a host with a third of all pages costs one row per task, and
pages meet their host's sums in a join that adaptive execution splits.

Defined results: null or empty html has even likelihoods; a page without a
declaration has no declaration evidence; a null url is the empty host; ties go
to the language that sorts first; without labelled documents the language is null
and the probability 0; repeated pages each get a row, and very long ones are read
whole; an empty table gives no row; other columns of any name are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .prefix_bpe import Memo
from .workspace import Workspace, slices

#: Defaults of the bounds that ``train`` takes for each language.
SAMPLE_PER_LANGUAGE, TRIGRAMS = 400, 4_000
#: Trigrams count as this many independent observations at most.
TEMPER = 40.0
SMOOTHING = 5.0

_SKIP = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})")
_META = re.compile(r"(?is)<meta\b[^>]*?content-language[\"']?[^>]*?content\s*=\s*[\"']?([a-z]{2,8})")


def text_of(page: str) -> str:
    return html_entities.unescape(_TAG.sub(" ", _SKIP.sub(" ", page)))


def declared_of(page: str) -> str | None:
    found = _LANG.search(page) or _META.search(page)
    return found[1].lower() if found else None


def address_of(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain (its last two labels) and suffix."""
    try:
        host = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        host = ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def _trigrams(word: str) -> list[str]:
    word = f" {word} "
    return [word[k : k + 3] for k in range(len(word) - 2)]


class TrigramModel:
    """Log likelihoods of words, by language."""

    def __init__(self, languages: list[str], counts: dict[str, list[float]], totals: list[float]):
        self.languages = languages
        size = len(counts) + 1
        total = np.array(totals) + 0.5 * size
        self.known = {g: np.log((np.array(c) + 0.5) / total) for g, c in counts.items()}
        self.rare = np.log(0.5 / total)
        self.memo = Memo()

    def word(self, word: str) -> np.ndarray:
        got = self.memo.get(word)
        if got is None:
            got = sum((self.known.get(g, self.rare) for g in _trigrams(word)), np.zeros(len(self.languages)))
            self.memo.put(word, got)
        return got

    def likelihood(self, text: str) -> np.ndarray:
        """Tempered log likelihoods; the best is 0."""
        if not self.languages:
            return np.zeros(0)
        words = Counter(_WORD.findall(text.lower()))
        if not words:
            return np.zeros(len(self.languages))
        total = np.array(list(map(self.word, words))).T @ np.array(list(words.values()), float)
        grams = sum(n * len(w) for w, n in words.items())
        total *= min(1.0, TEMPER / grams)
        return total - total.max()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096, 32 << 20):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, Counter())
            for word, n in Counter(_WORD.findall(text.lower())).items():
                for g in _trigrams(word):
                    own[g] += n
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, trigrams: int = TRIGRAMS) -> TrigramModel:
    """Counts over the ``per_language`` documents of each language with the least hashes.

    Every labelled language is a class.  Each brings its ``trigrams`` most frequent
    ones; a kept trigram is counted in all languages, and a language's total covers
    all its trigrams, kept or not.

    Ranking stays small however many tasks read the table: hashes are counted in
    steps of a quarter of a power of two, and only those up to the step in which a
    language has enough rows are ranked.  Equal rows share a step, and a language
    whose rows are few is ranked whole, so none goes without its sample.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)).alias("h"))
    step = F.ceil(F.log2(F.col("h") + 1) * 4).cast("int")
    least: dict[str, tuple[int, int]] = {}
    for r in sorted(rows.groupBy("lang", step.alias("step")).count().collect()):  # at most 161 rows a language
        last, held = least.get(r.lang, (0, 0))
        if held < per_language:
            least[r.lang] = (r.step, held + r["count"])
    if not least:
        return TrigramModel([], {}, [])
    bounds = docs.sparkSession.createDataFrame([(x, last) for x, (last, _) in least.items()], "lang string, last int")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = rows.join(F.broadcast(bounds), "lang").where(step <= F.col("last")).withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")
    ws = Workspace(docs.sparkSession, "trigrams")
    counts = ws.save(sample.mapInArrow(_count_trigrams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    languages = sorted(least)
    at = {x: k for k, x in enumerate(languages)}
    totals = [0.0] * len(languages)
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[at[r.lang]] = float(r.n)
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("top", top).where(F.col("top") <= trigrams).select("gram").distinct()
    table: dict[str, list[float]] = {}
    for r in counts.join(kept, "gram", "left_semi").collect():
        table.setdefault(r.gram, [0.0] * len(languages))[at[r.lang]] = float(r.n)
    ws.drop(counts)
    return TrigramModel(languages, table, totals)


def _softmax(logs: Column) -> Column:
    exps = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], n: int, label: str) -> DataFrame:
    summed = rows.groupBy(*keys).agg(*[F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(n)])
    return summed.select(*keys, F.array(*[f"s{k}" for k in range(n)]).alias(label))


def identify(pages: DataFrame, model: TrigramModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", workspace: Workspace | None = None) -> DataFrame:
    """page_id, lang, probability, declared, host; a row per row of ``pages``."""
    ws = workspace or Workspace(ship(pages.sparkSession), "language")
    n = len(model.languages)
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.known, model.rare))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TrigramModel.__new__(TrigramModel)
        (own.languages, own.known, own.rare), own.memo = shared.value, Memo()
        for batch in slices(batches):
            logs, declared, parts = [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                logs.append(own.likelihood(text_of(page)).tolist())
                declared.append(declared_of(page))
                parts.append(address_of(url))
            columns = [pa.array([p[k] for p in parts], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "logs"])

    body = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    read = body.mapInArrow(run, f"page_id {id_type}, host string, domain string, suffix string, declared string, logs array<double>")
    rows = ws.save(read.withColumn("soft", _softmax(F.col("logs"))), "texts")

    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), "declared", "host")

    # Sums of soft counts by level; every level holds one row per key.
    total = rows.agg(*[F.coalesce(F.sum(F.col("soft")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)]).first()
    everywhere = F.array(*[F.lit(float(x)) for x in total])
    out = rows
    for level in ("suffix", "domain", "host"):
        # Written, so that the join is fed by plain exchanges, which can be split.
        out = out.join(ws.save(_sums(rows, [level], n, f"of_{level}"), level), level)
    said = ws.save(_sums(rows.where("declared IS NOT NULL"), ["declared"], n, "of_declared").withColumnRenamed("declared", "said"), "declared")
    out = out.join(said, F.col("declared") == F.col("said"), "left")
    kinds = rows.where("declared IS NOT NULL").select("declared").distinct().count()
    with_declared = rows.where("declared IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("soft")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)]).first()

    def smoothed(counts: Column, prior: Column) -> Column:
        """(own counts without this page + SMOOTHING * prior) / (their sum + SMOOTHING)"""
        rest = F.zip_with(counts, F.col("soft"), lambda c, s: F.greatest(c - s, F.lit(0.0)))
        whole = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(rest, prior, lambda c, p: (c + SMOOTHING * p) / (whole + SMOOTHING))

    even = F.array(*[F.lit(1.0 / n)] * n)
    prior = smoothed(everywhere, even)
    for level in ("suffix", "domain", "host"):
        out = out.withColumn(f"p_{level}", smoothed(F.col(f"of_{level}"), prior))
        prior = F.col(f"p_{level}")
    seen = F.array(*[F.lit(float(x)) for x in with_declared])
    given = F.zip_with(
        F.zip_with(F.col("of_declared"), F.col("soft"), lambda c, s: F.greatest(c - s, F.lit(0.0)) + SMOOTHING / max(kinds, 1)),
        F.zip_with(seen, F.col("soft"), lambda c, s: F.greatest(c - s, F.lit(0.0)) + SMOOTHING),
        lambda a, b: F.log(a / b),
    )
    evidence = F.zip_with(
        F.zip_with(F.col("logs"), prior, lambda a, b: a + F.log(b)), F.coalesce(given, F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b
    )
    names = F.array(*[F.lit(x) for x in model.languages])
    posterior = out.select("page_id", "declared", "host", _softmax(evidence).alias("p"))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return posterior.select("page_id", F.element_at(names, best).alias("lang"), F.array_max("p").alias("probability"), "declared", "host")
