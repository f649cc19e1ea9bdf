"""Embeddings: a hashing embedder by default, any function of texts otherwise, and a cache by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of signed token hashes: deterministic, and near for texts that share words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for token in _TOKEN.findall(text.lower()):
                h = xxhash.xxh3_64_intdigest(token)
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text: str = "content", out: str = "embedding", make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder, batch: int = 256) -> DataFrame:
    """Adds ``out``. ``make`` opens the model once for each task."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            made = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch]).astype(np.float32)]
            yield pd.Series([v.tolist() for v in made], index=part.index)

    return df.withColumn(out, vectors(F.col(text)))


def embed_cached(df: DataFrame, cache: DataFrame, text: str = "content", out: str = "embedding", **options) -> tuple[DataFrame, DataFrame]:
    """(df with ``out``, new cache rows (key, embedding)): only contents that the cache lacks are embedded."""
    keyed = df.withColumn("key_", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    known = cache.select(F.col("key").alias("key_"), F.col("embedding").alias(out))
    missing = keyed.join(known, "key_", "left_anti").groupBy("key_").agg(F.min(text).alias(text))
    fresh = embed(missing, text, out, **options).select("key_", out)
    return keyed.join(known.unionByName(fresh), "key_", "left").drop("key_"), fresh.select(F.col("key_").alias("key"), F.col(out).alias("embedding"))


def checked_dimension(df: DataFrame, dimensions: int, column: str = "embedding") -> DataFrame:
    """Fails on the first vector of another length."""
    wrong = F.col(column).isNotNull() & (F.size(column) != dimensions)
    return df.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit("vector of length "), F.size(column).cast("string")))).otherwise(F.col(column)))
