"""Bounded samples of documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts longer than this share of a sample's bytes come last.
LONG = 16


def turn(size: int) -> list[Column]:
    """The order in which rows of ``bytes_`` come into a sample of ``size`` bytes, before any other order.

    Texts longer than ``size`` / LONG come after all others and from the shortest on, so that a long one takes the place of no
    other, and those that can't fit by themselves come last of all.
    """
    return [F.when(F.col("bytes_") > size // LONG, F.col("bytes_")).otherwise(0)]


def fitting(facts: DataFrame, size: int, rows: int, order: list) -> DataFrame:
    """Those rows of ``facts`` (a bounded table with ``bytes_``) that are the first ``rows`` and have ``size`` bytes together."""
    so_far = Window.orderBy(*turn(size), *order).rowsBetween(Window.unboundedPreceding, 0)
    fits = facts.withColumns({"sum_": F.sum("bytes_").over(so_far), "place_": F.count(F.lit(1)).over(so_far)})
    return fits.where((F.col("sum_") <= size) & (F.col("place_") <= rows)).drop("sum_", "place_")


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, size: int) -> DataFrame:
    """(key_, label_, text_) of labelled documents: those with the least hashes of their ids, at most ``rows`` of them, of at
    most ``size`` bytes together, long texts last (``turn``). Texts come whole; null texts are empty; an id that is null joins
    nothing."""
    chosen = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key_"), F.col(label).cast("int").alias("label_"))
    chosen = chosen.orderBy(F.xxhash64("key_"), "key_", "label_").limit(rows)
    text_ = F.coalesce(F.col(text), F.lit("")).alias("text_")
    found = documents.select(F.col(key).alias("k_"), text_).join(F.broadcast(chosen), F.col("k_") == F.col("key_"))
    # only ids and lengths of the chosen rows meet in one task
    sizes = found.select("key_", "label_", F.octet_length("text_").alias("bytes_"), F.xxhash64("text_").alias("hash_"))
    fits = fitting(sizes, size, rows, [F.xxhash64("key_"), "key_", "label_", "bytes_", "hash_"]).distinct()
    fits = fits.select(F.col("key_").alias("k2_"), F.col("label_").alias("l2_"), F.col("bytes_").alias("b2_"), F.col("hash_").alias("h2_"))
    same = (F.col("key_") == F.col("k2_")) & (F.col("label_") == F.col("l2_")) & (F.octet_length("text_") == F.col("b2_")) & (F.xxhash64("text_") == F.col("h2_"))
    return found.join(F.broadcast(fits), same).select("key_", "label_", "text_")
