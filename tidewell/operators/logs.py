"""Log analytics: feedback, strengthening, reorganising, pruning, retention, patterns and dashboards.

Inputs are DataFrames of documents, accesses, pairs, edges and events; every operator takes the evaluation time.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.config import CoRetrieval, Lifecycle, PruneRules
from tidewell.functions.scalar import days_between, source_of


def _at(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp")


# ---- feedback


def search_hits(results: DataFrame, query: str, as_of: datetime) -> DataFrame:
    """An access row for each result (doc_id, score) of a search."""
    return results.select("doc_id", F.lit("search_hit").alias("access_type"), F.lit(query).alias("query"), "score", _at(as_of).alias("ts"))


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Pair rows with the smaller id first; pairs of one document go."""
    return pairs.where("doc_id_a != doc_id_b").withColumns({"doc_id_a": F.least("doc_id_a", "doc_id_b"), "doc_id_b": F.greatest("doc_id_a", "doc_id_b")})


def feedback_pairs(hits: DataFrame, batch: list[str], order: list[str], first: int = 5) -> DataFrame:
    """Pairs of the first documents of each batch of hits, at most first * (first - 1) / 2 a batch."""
    rank = F.row_number().over(Window.partitionBy(*batch).orderBy(*order))
    top = hits.withColumn("rank_", rank).where(F.col("rank_") <= first)
    lists = top.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("rank_", "doc_id"))).alias("top_"))
    a = lists.select(*batch, F.posexplode("top_").alias("i_", "a_"), "top_")
    b = a.select(*batch, "a_", F.explode(F.slice("top_", F.col("i_") + 2, F.lit(first))).alias("b_"))
    return canonical_pairs(b.select(*batch, F.col("a_.doc_id").alias("doc_id_a"), F.col("b_.doc_id").alias("doc_id_b")))


def with_accesses(docs: DataFrame, access: DataFrame) -> DataFrame:
    """Adds the accesses' number and latest time to access_count and last_accessed."""
    found = access.groupBy("doc_id").agg(F.count("*").alias("n_"), F.max("ts").alias("last_"))
    joined = docs.join(found, "doc_id", "left")
    return joined.withColumns(
        {"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("n_", F.lit(0)), "last_accessed": F.greatest("last_accessed", "last_")}
    ).drop("n_", "last_")


def since(log: DataFrame, cutoff: datetime | None, inclusive: bool = True) -> DataFrame:
    """The rows of a log from a cutoff on; all without one."""
    if cutoff is None:
        return log
    return log.where(F.col("ts") >= _at(cutoff)) if inclusive else log.where(F.col("ts") > _at(cutoff))


# ---- strengthening


def strengthen_boost(docs: DataFrame, access: DataFrame, rule: Lifecycle = Lifecycle()) -> DataFrame:
    """Documents that were accessed, with hits, avg_score and new_excitability: more hits raise it, poor scores lower it."""
    found = access.groupBy("doc_id").agg(F.count("*").alias("hits"), F.avg("score").alias("avg_score"))
    joined = docs.select("doc_id", "excitability").join(found, "doc_id").withColumn("avg_score", F.coalesce("avg_score", F.lit(1.0)))
    extinct = F.col("avg_score") < rule.extinction_score
    lower = F.greatest(F.lit(rule.floor), F.col("excitability") - rule.extinction_penalty)
    boost = F.least(F.lit(rule.boost_cap), F.lit(rule.boost_scale) * F.log2(F.col("hits") + 1))
    raised = F.least(F.lit(rule.ceiling), F.col("excitability") + boost)
    return joined.withColumns({"extinct": extinct, "new_excitability": F.when(extinct, lower).otherwise(raised)})


def strengthen_decay(docs: DataFrame, access: DataFrame, as_of: datetime, rule: Lifecycle = Lifecycle()) -> DataFrame:
    """Documents untouched in the window and idle beyond the grace time, with days and new_excitability, where it changes.

    The longer a document's record of accesses, the slower it fades.
    """
    grace = _at(as_of - timedelta(days=rule.grace_days))
    idle = docs.where((F.col("last_accessed").isNull() | (F.col("last_accessed") < grace)) & (F.col("indexed_at").isNull() | (F.col("indexed_at") < grace)))
    idle = idle.join(access.select("doc_id").distinct(), "doc_id", "left_anti")
    touched = F.coalesce("last_accessed", "indexed_at", "created", _at(as_of))
    idle = idle.withColumn("days", days_between(_at(as_of), touched)).where(F.col("days") >= rule.grace_days)
    stability = F.lit(rule.stability_days) * (1 + F.log1p(F.coalesce("access_count", F.lit(0)).cast("double")))
    faded = F.greatest(F.lit(rule.floor), F.col("excitability") * F.exp(-F.col("days") / stability))
    return idle.withColumn("new_excitability", faded).where("new_excitability != excitability").select("doc_id", "excitability", "days", "new_excitability")


# ---- reorganising


def co_retrieved_counts(pairs: DataFrame, rule: CoRetrieval = CoRetrieval()) -> DataFrame:
    counted = pairs.groupBy("doc_id_a", "doc_id_b").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= rule.threshold)


def edge_id(a: Column, b: Column) -> Column:
    """The same for both directions."""
    return F.sha2(F.concat_ws("::", F.least(a, b), F.greatest(a, b)), 256)


def reinforce(pairs: DataFrame, edges: DataFrame, rule: CoRetrieval = CoRetrieval()) -> DataFrame:
    """co_retrieved edges that pairs strengthen or make: source_id, target_id, n, old_weight, weight, confidence, is_new."""
    counted = co_retrieved_counts(pairs, rule)
    held = edges.where("type = 'co_retrieved'").select(
        F.least("source_id", "target_id").alias("a_"), F.greatest("source_id", "target_id").alias("b_"), F.col("weight").alias("old_weight"), F.col("confidence").alias("c_")
    )
    joined = counted.join(held, (counted["doc_id_a"] == held["a_"]) & (counted["doc_id_b"] == held["b_"]), "left")
    gain = F.col("n") / rule.per_weight
    return joined.select(
        edge_id(F.col("doc_id_a"), F.col("doc_id_b")).alias("id"),
        F.col("doc_id_a").alias("source_id"),
        F.col("doc_id_b").alias("target_id"),
        "n",
        "old_weight",
        F.least(F.lit(1.0), F.coalesce("old_weight", F.lit(0.0)) + gain).alias("weight"),
        F.coalesce("c_", F.lit(rule.confidence)).alias("confidence"),
        F.col("old_weight").isNull().alias("is_new"),
    )


def fade_edges(edges: DataFrame, pairs: DataFrame, as_of: datetime, rule: CoRetrieval = CoRetrieval()) -> DataFrame:
    """Live co_retrieved edges without a recent pair: weak ones end (removed), others lose weight (new_weight)."""
    recent = pairs.where(F.col("ts") >= _at(as_of - timedelta(days=rule.stale_days))).select(F.least("doc_id_a", "doc_id_b").alias("a_"), F.greatest("doc_id_a", "doc_id_b").alias("b_")).distinct()
    live = edges.where((F.col("type") == "co_retrieved") & (F.col("valid_to").isNull() | (F.col("valid_to") > _at(as_of))))
    stale = live.join(recent, (F.least("source_id", "target_id") == recent["a_"]) & (F.greatest("source_id", "target_id") == recent["b_"]), "left_anti")
    removed = F.col("weight") < rule.remove_below
    return stale.select("id", "source_id", "target_id", "weight", removed.alias("removed"), F.when(~removed, F.col("weight") * rule.decay).alias("new_weight"))


# ---- pruning


def prune_stale(docs: DataFrame, priorities: DataFrame | None, as_of: datetime, rule: PruneRules = PruneRules()) -> DataFrame:
    """Never accessed, old and unexciting documents: removed if their source has low priority, else flagged."""
    age = F.floor(days_between(_at(as_of), F.coalesce("last_accessed", "indexed_at", "created", _at(as_of)))).cast("long")
    stale = docs.withColumn("age_days", age).where((F.col("excitability") < rule.stale_below) & (F.col("access_count") == 0) & (F.col("age_days") > rule.stale_days))
    stale = stale.withColumn("source", source_of(F.col("doc_id")))
    if priorities is None:
        return stale.select("doc_id", "source", "excitability", "age_days", F.lit("flag").alias("action"))
    joined = stale.join(F.broadcast(priorities.select("source", "priority")), "source", "left")
    action = F.when(F.col("priority") == "low", "remove").otherwise("flag")
    return joined.select("doc_id", "source", "excitability", "age_days", action.alias("action"))


def prune_misaligned(docs: DataFrame, access: DataFrame, rule: PruneRules = PruneRules()) -> DataFrame:
    """Documents that searches find often and score poorly."""
    hits = access.where("access_type = 'search_hit'").groupBy("doc_id").agg(F.count("*").alias("hits"), F.avg("score").alias("avg_score"))
    hits = hits.where((F.col("hits") >= rule.misaligned_hits) & (F.col("avg_score") < rule.misaligned_below))
    joined = hits.join(docs.select("doc_id", "excitability", "access_count"), "doc_id", "left")
    return joined.select(
        "doc_id", source_of(F.col("doc_id")).alias("source"), "hits", "avg_score", F.coalesce("excitability", F.lit(0.5)).alias("excitability"), F.coalesce("access_count", "hits").alias("access_count")
    )


def retain(log: DataFrame, as_of: datetime, rule: PruneRules = PruneRules()) -> DataFrame:
    """The rows of a log that retention keeps."""
    return log.where(F.col("ts") >= _at(as_of - timedelta(days=rule.retention_days)))


# ---- patterns


def confidence(n: Column) -> Column:
    return n / (n + 3.0)


def frequency_patterns(events: DataFrame, least: int = 3) -> DataFrame:
    found = events.where("event_type = 'search' and target_id is not null").groupBy(F.col("target_id").alias("name")).agg(F.count("*").alias("n"))
    return _pattern(found.where(F.col("n") >= least), "frequency")


def gap_patterns(events: DataFrame, least: int = 3) -> DataFrame:
    """Queries that find nothing again and again."""
    none = F.get_json_object("metadata", "$.results_count").cast("long") == 0
    found = events.where((F.col("event_type") == "search_complete") & F.col("query").isNotNull() & none)
    return _pattern(found.groupBy(F.col("query").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least), "gap")


def temporal_patterns(events: DataFrame, least: int = 2) -> DataFrame:
    name = F.concat(F.date_format("ts", "EEEE"), F.lit(":"), F.col("query"))
    found = events.where("query is not null").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return _pattern(found.where(F.col("n") >= least), "temporal")


def _pattern(found: DataFrame, kind: str) -> DataFrame:
    return found.select(F.lit(kind).alias("pattern"), "name", "n", confidence(F.col("n")).alias("confidence"))


def all_patterns(events: DataFrame) -> DataFrame:
    return frequency_patterns(events).unionByName(gap_patterns(events)).unionByName(temporal_patterns(events))


# ---- dashboards


def corpus_stats(docs: DataFrame) -> DataFrame:
    e = F.col("excitability")
    return docs.agg(
        F.count("*").alias("documents"),
        F.count_if(e > 0.6).alias("hot"),
        F.count_if(e < 0.15).alias("cold"),
        F.count_if(F.col("access_count") > 0).alias("accessed"),
        F.coalesce(F.avg(e), F.lit(0.5)).alias("avg_excitability"),
        F.coalesce(F.min(e), F.lit(0.5)).alias("min_excitability"),
        F.coalesce(F.max(e), F.lit(0.5)).alias("max_excitability"),
    )


def top_queries(access: DataFrame, n: int = 5) -> DataFrame:
    found = access.where("query is not null and query != ''").groupBy("query").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "query").limit(n)


def health_alerts(docs: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """Alerts (alert): no run yet, the last one long ago, or a flat distribution of excitability."""
    last = runs.where("finished_at is not null").agg(F.max("finished_at").alias("last"))
    hours = days_between(_at(as_of), F.col("last")) * 24
    by_run = last.select(F.when(F.col("last").isNull(), "never consolidated").when(hours > 12, "consolidation overdue").alias("alert"))
    spread = docs.agg(F.count("*").alias("n"), (F.max("excitability") - F.min("excitability")).alias("range"))
    flat = spread.select(F.when((F.col("n") > 100) & (F.col("range") < 0.01), "flat excitability").alias("alert"))
    return by_run.unionByName(flat).where("alert is not null")


def by_excitability(docs: DataFrame, n: int = 10, top: bool = True) -> DataFrame:
    order = F.desc("excitability") if top else F.asc("excitability")
    return docs.select("doc_id", "excitability", "access_count").orderBy(order, "doc_id").limit(n)


def excitability_histogram(docs: DataFrame) -> DataFrame:
    bucket = F.least(F.lit(4), F.floor(F.col("excitability") * 5 + F.lit(1e-9))).cast("long")
    return docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def at_risk(docs: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    stale = F.coalesce(F.floor(days_between(_at(as_of), F.col("last_accessed"))).cast("long"), F.lit(999).cast("long"))
    found = docs.where("access_count > 0 and excitability < 0.45")
    return found.select("doc_id", "excitability", "access_count", stale.alias("days_stale")).orderBy("excitability", "doc_id").limit(n)


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.where("duration is not null").orderBy(F.desc("id")).limit(n)


def last_run(runs: DataFrame) -> datetime | None:
    return runs.where("finished_at is not null").agg(F.max("finished_at")).first()[0]
