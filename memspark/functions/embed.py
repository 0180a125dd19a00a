"""Embedders as pluggable functions. The one here hashes words; it needs no model and no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"[^\W_]+")


def hash_embedder(dim: int = 32) -> Embedder:
    """Unit vectors: each word adds its sign at its place; texts without words are all zero."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if (h >> 40) & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return embed


def embed_column(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column, in Arrow batches; the embedder is used once per batch."""
    fn = embedder or hash_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(fn(s.fillna("").tolist())))

    return run(text)


def mean_vector(chunks: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, vector: the element-wise mean of the chunks' vectors, not normalised. Sums are partial aggregates."""
    at = chunks.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"].cast("float")).alias(vector))


def backfill(store: DataFrame, column: str, text: Column, embedder: Embedder | None = None) -> DataFrame:
    """The store with missing or all-zero vectors of ``column`` made from ``text``; others stay as they are."""
    empty = F.col(column).isNull() | ~F.exists(column, lambda x: x != 0)
    have = store.where(~empty)
    need = store.where(empty)
    return have.unionByName(need.withColumn(column, embed_column(text, embedder)).select(*store.columns))
