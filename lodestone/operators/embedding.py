"""Embeddings: providers called in batches over Arrow, and replies of services."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Texts that one call of a provider gets.
BATCH = 15

Provider = Callable[[list[str]], list[list[float]]]


def hashed_provider(dimension: int = 64) -> Provider:
    """A deterministic provider that needs no model: signed word counts by hash."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


class Providers:
    """Makers of providers by name, with defaults by kind of model."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable[..., Provider]] = {"hashed": hashed_provider}

    def register(self, name: str, maker: Callable[..., Provider]) -> None:
        self.makers[name] = maker

    def names(self) -> list[str]:
        return sorted(self.makers)

    def create(self, name: str, **options) -> Provider:
        """A provider; an unknown name is an error that says what there is."""
        if name not in self.makers:
            raise KeyError(f"unknown provider {name!r}; there are {', '.join(self.names())}")
        return self.makers[name](**options)


def embed(rows: DataFrame, provider: Provider, text_col: str = "content", out_col: str = "embedding", batch: int = BATCH, prefix: str = "") -> DataFrame:
    """``rows`` with the vectors of their texts; a reply of the wrong length is an error."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found: list[list[float]] = []
            for k in range(0, len(texts), batch):
                some = [prefix + (t or "") for t in texts[k : k + batch]]
                reply = provider(some)
                if len(reply) != len(some):
                    raise ValueError("the provider returned another number of vectors")
                found += reply
            yield pd.Series(found, dtype=object)

    return rows.withColumn(out_col, vectors(F.col(text_col)))


def parse_reply(body: Column) -> Column:
    """Vectors of a service's JSON, ``data[].embedding``; empty for another shape."""
    parsed = F.from_json(body, "struct<data: array<struct<embedding: array<float>>>>")
    return F.coalesce(F.transform(parsed["data"], lambda d: d["embedding"]), F.array().cast("array<array<float>>"))
