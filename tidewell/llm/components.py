"""Connected components by alternating large and small stars; every node gets its component's smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for the ends of ``edges`` (a, b). Each round is written to the shared folder, so nothing is recomputed.

    Nodes of very many neighbours are safe: their minimum is pre-aggregated, and the join that hands it out is one that
    adaptive execution splits.
    """
    now = stored(_ordered(edges.select("a", "b")), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("id")))


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller id, once each."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links larger neighbours of each node to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
    met = both.where("v > u").join(least, F.col("u") == F.col("u2"))
    return _ordered(met.select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "a2")
    met = edges.join(least, F.col("a") == F.col("a2"))
    return _ordered(met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("a2").alias("a"), F.col("m").alias("b"))))
