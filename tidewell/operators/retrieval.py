"""Retrieval layers, fusion, boosts, diversity and the layered search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from functools import reduce
from time import perf_counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.config import SearchOptions
from tidewell.functions.porter import stem, stems
from tidewell.functions.scalar import cosine, days_between, let
from tidewell.operators import graph
from tidewell.sources.scratch import settled

BM25_K1, BM25_B = 1.2, 0.75
# Words that expansion leaves out.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need must "
    "in on at to for of with by from as into through during before after above below and but or nor not so yet both either "
    "this that these those it its they them he she we you i me my our your his her which who whom what where when how why "
    "all each every any some no more most other"
).split()


# ---- vectors


def knn(docs: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """The k documents of the largest cosine (key, score), ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = docs.select(key, cosine(F.col(vector), q).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


# ---- keywords


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", query.lower())))


def _stem_prefix(word: Column, size: int) -> Column:
    return F.translate(F.substring(word, 1, size), "y", "i")


def _with_counts(docs: DataFrame, terms: list[str], fields: Sequence[str], key: str, porter: bool) -> DataFrame:
    """(key, dl, tf): the length of each document and how often it has each term. Tokens are made once.

    Stems differ from their words behind the second letter only (but for y and i), so words that begin like none of the
    terms are left out before any is stemmed.
    """
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    if not porter:
        asked = F.array(*[F.lit(t) for t in terms])
        within = lambda t: F.filter(t, lambda x: F.array_contains(asked, x))
    else:
        sizes = {min(2, len(t)) for t in terms}
        starts = {n: F.array(*[F.lit(t[:n].replace("y", "i")) for t in terms if min(2, len(t)) == n]) for n in sizes}
        alike = lambda x: reduce(lambda a, b: a | b, [F.array_contains(starts[n], _stem_prefix(x, n)) for n in sorted(sizes)])
        within = lambda t: F.filter(t, alike)
    made = let(tokens(text), lambda t: F.struct(F.size(t).alias("dl"), within(t).alias("hits")))
    counted = docs.select(key, made.alias("made_")).select(key, F.col("made_.dl").alias("dl"), F.col("made_.hits").alias("hits"))
    if porter:
        counted = counted.withColumn("hits", stems("hits"))
    times = lambda term: F.size(F.filter("hits", lambda t: t == F.lit(term)))
    return counted.select(key, "dl", F.array(*[times(t) for t in terms]).alias("tf"))


def _bm25_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def bm25(docs: DataFrame, query: str, k: int, content: str | Sequence[str] = "content", key: str = "doc_id", porter: bool = False) -> DataFrame:
    """The k best documents (key, score) by BM25 over one or more fields.

    One scan counts the query's terms, so neither tokens nor postings are shuffled; what it found (a few numbers a document)
    is settled, and the corpus statistics and the scores read that.
    """
    terms = query_terms(query)
    if porter:
        terms = list(dict.fromkeys(stem(t) for t in terms))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = settled(_with_counts(docs, terms, [content] if isinstance(content, str) else content, key, porter))
    seen = F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]).alias("df")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), seen)
    joined = counted.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    part = lambda i: _bm25_score(F.get("tf", F.lit(i)), F.get("df", F.lit(i)), F.col("dl"), F.col("n"), F.col("avgdl"))
    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    return joined.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Buckets of terms in stored postings; a query reads only those of its terms.
TERM_BUCKETS = 64


def term_bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def postings(docs: DataFrame, fields: Sequence[str] = ("doc_id", "content", "file_path"), key: str = "doc_id", porter: bool = True) -> DataFrame:
    """(term, doc_id, tf, dl, bucket): an inverted index of documents. Distinct words are stemmed, not each occurrence."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields if c in docs.columns])
    made = docs.select(key, tokens(text).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    counted = made.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    if porter:
        words = counted.select("term").distinct().select("term", F.get(stems(F.array("term")), F.lit(0)).alias("stem"))
        counted = counted.join(words, "term").groupBy(key, "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return counted.select("term", F.col(key).alias("doc_id"), F.col("tf").cast("long"), F.col("dl").cast("long"), term_bucket(F.col("term")).alias("bucket"))


def bm25_index(index: DataFrame, n: int, avgdl: float, query: str, k: int, porter: bool = True) -> DataFrame:
    """The k best documents (doc_id, score) by BM25 from stored postings of a corpus of n documents."""
    terms = query_terms(query)
    terms = list(dict.fromkeys(stem(t) for t in terms)) if porter else terms
    if not terms or not n:
        return index.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    buckets = sorted({zlib.crc32(t.encode()) % TERM_BUCKETS for t in terms})
    met = index.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    scored = met.join(F.broadcast(df), "term").withColumn("part", _bm25_score(F.col("tf"), F.col("df"), F.col("dl"), F.lit(float(n)), F.lit(float(avgdl))))
    return scored.groupBy("doc_id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


#: Ranges of documents, by their hash, into which the postings of a term are cut.
RANGES = 1 << 16


def posting_blocks(index: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(term, range, n, most_tf, least_dl, held): postings (term, doc_id, tf, dl) of a term and a range of documents in one row.

    A document's range follows from its hash, so one range holds all its terms, and a frequent term is many rows.
    """
    ranged = index if "range" in index.columns else index.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
    held = F.array_sort(F.collect_list(F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))))
    return ranged.groupBy("term", "range").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").cast("int").alias("most_tf"), F.min("dl").cast("int").alias("least_dl"), held.alias("held"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """In order of terms and ranges, in small row groups, whose least and greatest values then tell what a search can leave out."""
    ordered = blocks.repartitionByRange("term", "range").sortWithinPartitions("term", "range")
    ordered.write.option("parquet.block.size", 4 << 20).parquet(path)


def write_document_blocks(docs: DataFrame, path: str, content: str = "content", key: str = "doc_id", ranges: int = RANGES) -> tuple[int, float | None]:
    """``posting_blocks`` of documents, not stemmed, written to ``path``; and how many documents there are, and their mean length.

    Documents are dealt by range before they are cut into words, so words and postings are counted where they are and only texts
    are shuffled; every file is in order of terms and ranges.
    """
    counted = Observation()
    dealt = docs.select(F.col(key).alias("doc_id"), F.coalesce(content, F.lit("")).alias("text_"), F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int").alias("range")).repartition("range")
    made = dealt.select("range", "doc_id", tokens(F.col("text_")).alias("t")).withColumn("dl", F.size("t")).observe(counted, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    words = made.select("range", "doc_id", "dl", F.explode("t").alias("term")).groupBy("range", "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    posting_blocks(words, ranges).sortWithinPartitions("term", "range").write.option("parquet.block.size", 4 << 20).parquet(path)
    return counted.get["n"], counted.get["mean"]


def bm25_blocks(blocks: DataFrame, n: int, avgdl: float, query: str, k: int, porter: bool = True, told: dict | None = None) -> DataFrame:
    """The k best documents (doc_id, score) by BM25 from ``posting_blocks`` of a corpus of n documents, exactly.

    The largest count and the least length of a block bound the scores in it, and the bounds of a range's blocks add up. First
    the ``k`` ranges of the largest bounds are scored, which hold k documents at least; then only those ranges whose bound
    reaches the k-th best score are read. ``told`` gets the numbers of ranges and of those that were read.
    """
    terms = query_terms(query)
    terms = list(dict.fromkeys(stem(t) for t in terms)) if porter else terms
    if not terms or not n:
        return blocks.select(F.lit(None).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    met = blocks.where(F.col("term").isin(terms))
    # numbers of the blocks only; postings stay unread
    sketch = settled(met.select("term", "range", "n", "most_tf", "least_dl"))
    df = {r["term"]: r["df"] for r in sketch.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    known = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(df[t])), df, F.when(F.lit(False), F.lit(0))) if df else F.lit(0)
    score_of = lambda tf, dl: _bm25_score(tf, known, dl, F.lit(float(n)), F.lit(float(avgdl)))
    bounds = sketch.groupBy("range").agg(F.sum(score_of(F.col("most_tf"), F.col("least_dl"))).alias("bound"))

    def scored(some: DataFrame) -> DataFrame:
        each = some.select("term", F.explode("held").alias("p")).withColumn("part", score_of(F.col("p.tf"), F.col("p.dl")))
        return each.groupBy(F.col("p.doc_id").alias("doc_id")).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)

    first = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(k).collect()]
    best = [r["score"] for r in scored(met.where(F.col("range").isin(first))).collect()]
    floor = min(best) if len(best) >= k else 0.0
    reach = bounds.where(F.col("bound") >= floor - 1e-9).select("range")
    few = [r["range"] for r in reach.limit(MOST_RANGES + 1).collect()]
    if told is not None:
        told |= {"ranges": bounds.count(), "read": reach.count()}
    # a list of ranges is pushed down to the scan; a longer one is joined
    return scored(met.where(F.col("range").isin(few)) if len(few) <= MOST_RANGES else met.join(reach, "range", "left_semi"))


#: Ranges that a scan is given as a list at most.
MOST_RANGES = 1000


def keyword_layer_score(rank: Column) -> Column:
    """The score that a full-text rank gets in fusion."""
    return F.when(rank == 0, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + rank / 50)))


def expansion_terms(docs: DataFrame, query: str, n: int = 3, content: str = "content") -> DataFrame:
    """The n most frequent words of the documents given (the best vector hit) that the query lacks: (term, n)."""
    word = F.explode(F.split(F.lower(content), r"\s+"))
    clean = docs.select(word.alias("w")).select(F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("term"))
    kept = clean.where((F.octet_length("term") > 3) & ~F.col("term").isin(STOP_WORDS))
    counted = kept.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)
    return counted.where(~F.contains(F.lit(query.lower()), F.col("term")))


# ---- metadata


def tag_retrieval(words: Sequence[str], tags: DataFrame, each: int = 10, score: float = 0.7) -> DataFrame:
    """(word, doc_id, score): up to ``each`` documents a word of which a tag contains the word."""
    return _contained(words, tags.select("doc_id", F.col("tag").alias("held")), each, score)


def xref_retrieval(words: Sequence[str], xrefs: DataFrame, each: int = 10, score: float = 0.6) -> DataFrame:
    return _contained(words, xrefs.select("doc_id", F.col("ref_target").alias("held")), each, score)


def _contained(words: Sequence[str], held: DataFrame, each: int, score: float) -> DataFrame:
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w.lower()).alias("w")) for i, w in enumerate(words)]), lambda x: F.contains(F.lower("held"), x["w"]))
    found = held.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", F.col("hit.i").alias("position"), F.col("hit.w").alias("word")).distinct()
    rank = F.row_number().over(Window.partitionBy("position").orderBy("doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= each).select("position", "word", "doc_id", "rank", F.lit(score).alias("score"))


def metadata_layer(query: str, tags: DataFrame, xrefs: DataFrame) -> DataFrame:
    """(doc_id, score, rank): tag hits before reference hits, word by word; the first hit of a document counts."""
    words = [w for w in query.split() if len(w.encode()) >= 3]
    both = tag_retrieval(words, tags).withColumn("kind", F.lit(0)).unionByName(xref_retrieval(words, xrefs).withColumn("kind", F.lit(1)))
    first = both.groupBy("doc_id").agg(F.min(F.struct("position", "kind", "rank", "score")).alias("hit"))
    rank = F.row_number().over(Window.partitionBy().orderBy("hit.position", "hit.kind", "hit.rank"))
    return first.select("doc_id", F.col("hit.score").alias("score"), rank.cast("long").alias("rank"))


# ---- fusion


def ranked(hits: DataFrame, list_id: int, content: str | None = None) -> DataFrame:
    """A ranked list (list_id, rank, doc_id, content, score) from a bounded table of hits."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id"))
    body = F.col(content) if content else F.lit(None).cast("string")
    return hits.select(F.lit(list_id).alias("list_id"), rank.cast("long").alias("rank"), "doc_id", body.alias("content"), "score")


def rrf(lists: DataFrame, k: int = 60, most: int = 1000) -> DataFrame:
    """(doc_id, rrf_score, content, best_score): reciprocal ranks summed; the payload is that of the best raw score."""
    k = k or 60
    sizes = lists.agg(F.count("*").alias("total_"), F.count_distinct("list_id").alias("lists_"))
    cut = lists.crossJoin(F.broadcast(sizes)).where((F.col("total_") <= most) | (F.col("rank") <= F.floor(F.lit(most) / F.col("lists_"))))
    named = cut.withColumn("doc_id", F.when(F.coalesce("doc_id", F.lit("")) == "", F.concat(F.lit("hash_"), F.sha2(F.coalesce("content", F.lit("")), 256))).otherwise(F.col("doc_id")))
    best = F.struct("score", (-F.col("list_id")).alias("l"), (-F.col("rank")).alias("r"))
    fused = named.groupBy("doc_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("s"), F.max_by(F.struct("content", "score"), best).alias("p"))
    return fused.select("doc_id", F.round("s", 4).alias("rrf_score"), F.col("p.content").alias("content"), F.col("p.score").alias("best_score"), F.col("s").alias("exact_score"))


def excitability_boost(fused: DataFrame, docs: DataFrame, as_of: datetime, score: str = "rrf_score") -> DataFrame:
    """Scores times 0.9 + 0.2 * effective excitability; documents that aren't known count as 0.5."""
    now = F.lit(as_of).cast("timestamp")
    days_access = F.coalesce(days_between(now, F.col("last_accessed")), F.lit(0.0))
    days_index = F.coalesce(days_between(now, F.col("indexed_at")), F.lit(30.0))
    freshness = 0.05 * F.least(F.lit(0.7), F.log(1 + 1 / (days_index + 1)))
    effective = F.least(F.lit(1.0), F.coalesce("excitability", F.lit(0.5)) * F.greatest(F.lit(0.7), F.exp(-days_access / 60)) + freshness)
    known = docs.select("doc_id", effective.alias("effective_"))
    joined = fused.join(known, "doc_id", "left").withColumn("effective", F.coalesce("effective_", F.lit(0.5))).drop("effective_")
    return joined.withColumn("boosted", F.col(score) * (0.9 + 0.2 * F.col("effective")))


def graph_boost(fused: DataFrame, edges: DataFrame, as_of: datetime, limit: int, score: str = "boosted", options: SearchOptions = SearchOptions(), docs: DataFrame | None = None) -> DataFrame:
    """Spreads a share of the best documents' scores over their co_retrieved edges; new documents fill up to 2 * limit.

    With ``docs`` (doc_id) only neighbours that are documents come in new.
    """
    live = graph.both_ways(graph.live(edges.where("type = 'co_retrieved'"), as_of)).where("node != other")
    parents = fused.orderBy(F.desc(score), "doc_id").limit(options.boost_parents).select(F.col("doc_id").alias("node"), F.col(score).alias("parent"))
    given = live.join(F.broadcast(parents), "node")
    gain = F.col("parent") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))) * options.boost_factor
    gained = given.groupBy(F.col("other").alias("doc_id")).agg(F.sum(gain).alias("gain"))
    if docs is not None:
        gained = gained.join(docs.select("doc_id").unionByName(fused.select("doc_id")).distinct(), "doc_id", "left_semi")
    held = fused.select("doc_id", F.col(score).alias("old"))
    joined = held.join(gained, "doc_id", "full_outer")
    room = F.greatest(F.lit(0), F.lit(2 * limit) - F.count("old").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy(F.col("old").isNull()).orderBy(F.desc("gain"), "doc_id"))
    joined = joined.withColumns({"room": room, "place": place}).where(F.col("old").isNotNull() | (F.col("place") <= F.col("room")))
    return joined.select("doc_id", (F.coalesce("old", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("spread"), F.col("old").isNull().alias("is_new"))


def mmr(candidates: DataFrame, limit: int, score: str = "score", balance: float = 0.7, group: str | None = None) -> DataFrame:
    """Greedy choice of relevant and diverse rows: (group?, doc_id, position, relevance). Candidates are a few dozen a query.

    If there are no more than ``limit``, nothing has to be chosen and they stay in order of score.
    """
    kind = candidates.schema["doc_id"].dataType.simpleString()
    gkind = candidates.schema[group].dataType.simpleString() if group else None

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, "doc_id"], ascending=[False, True]).reset_index(drop=True)
        s = rows[score].to_numpy(dtype=float)
        relevance = (s - s.min()) / max(s.max() - s.min(), 1e-9)
        vectors = [np.asarray(v, dtype=float) if v is not None else None for v in rows["embedding"]]
        chosen: list[int] = list(range(len(rows))) if len(rows) <= limit else []
        nearest = np.zeros(len(rows))
        while len(chosen) < min(limit, len(rows)):
            value = balance * relevance - (1 - balance) * nearest
            value[chosen] = -np.inf
            best = int(np.argmax(value))
            chosen.append(best)
            for i, v in enumerate(vectors):
                u = vectors[best]
                if u is not None and v is not None and len(u) == len(v):
                    norm = np.linalg.norm(u) * np.linalg.norm(v)
                    nearest[i] = max(nearest[i], float(u @ v / norm) if norm else 0.0)
        out = pd.DataFrame({"doc_id": rows["doc_id"].iloc[chosen].to_numpy(), "position": range(len(chosen)), "relevance": relevance[chosen]})
        if group:
            out.insert(0, group, rows[group].iloc[0])
        return out

    schema = (f"{group} {gkind}, " if group else "") + f"doc_id {kind}, position long, relevance double"
    keyed = candidates.groupBy(group) if group else candidates.withColumn("all_", F.lit(1)).groupBy("all_")
    return keyed.applyInPandas(choose, schema)


def rerank(query: str, hits: DataFrame, limit: int, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None, content: str = "content") -> DataFrame:
    """Orders hits by a scorer of (query, excerpt) pairs; without one the order stays."""
    from tidewell.operators.text import excerpt

    if scorer is None:
        return hits.orderBy(F.desc("score"), "doc_id").limit(limit)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            logits = np.array(scorer([(query, t or "") for t in batch]), dtype=float)
            yield pd.Series(1 / (1 + np.exp(-logits)))

    return hits.withColumn("score", scored(excerpt(F.col(content)))).orderBy(F.desc("score"), "doc_id").limit(limit)


# ---- the layered search


def expanded_query(query: str, near: DataFrame, least: float = 0.02, n: int = 3) -> str:
    """The query with the terms of the best vector hit of ``near`` (doc_id, content, score), if it scores above ``least``."""
    best = near.orderBy(F.desc("score"), "doc_id").limit(1).where(F.col("score") > least)
    return " ".join([query, *[r["term"] for r in expansion_terms(best, query, n).collect()]])


def hybrid_search(
    query: str,
    vector: Sequence[float],
    docs: DataFrame,
    vectors: DataFrame,
    tags: DataFrame,
    xrefs: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    as_of: datetime,
    options: SearchOptions = SearchOptions(),
    scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None,
    keywords: Callable[[str, int], DataFrame] | None = None,
    nearest: Callable[[Sequence[float], int], DataFrame] | None = None,
    stats: list[tuple[str, float, int]] | None = None,
) -> DataFrame:
    """(doc_id, position, score): vector, keyword, graph and metadata layers fused, boosted, spread and made diverse.

    The keyword layer asks for the query's stems and those of the best vector hit's terms, in id, content and path; it searches
    ``keywords`` (stored postings, as a function of query and size) or, without them, scans; so does the vector layer with
    ``nearest`` (an index, as a function of vector and size). A ``scorer`` reranks the chosen
    rows. Each layer's name, milliseconds and number of candidates go into ``stats``.
    """
    began = perf_counter()

    def counted(name: str, hits: DataFrame) -> DataFrame:
        nonlocal began
        # counted by the job that settles the layer
        seen = Observation(name)
        held = settled(hits.observe(seen, F.count(F.lit(1)).alias("rows")))
        if stats is not None:
            stats.append((name, 1000 * (perf_counter() - began), seen.get["rows"]))
        began = perf_counter()
        return held

    wide = options.limit * options.candidates
    lists, asked = [], query
    if options.vector:
        best = nearest(vector, wide) if nearest else knn(vectors, vector, wide)
        near = counted("vector", ranked(best.join(docs.select("doc_id", "content"), "doc_id"), 0, "content"))
        asked = expanded_query(query, near)
        lists.append(near)
    if options.keyword:
        fields = [c for c in ("doc_id", "content", "file_path") if c in docs.columns]
        best = keywords(asked, wide) if keywords else bm25(docs, asked, wide, fields, porter=True)
        hits = ranked(best.join(docs.select("doc_id", "content"), "doc_id"), 1, "content")
        lists.append(counted("keyword", hits.withColumn("score", keyword_layer_score(-F.col("score")))))
    if options.graph:
        lists.append(counted("graph", ranked(graph.graph_search(query, nodes, edges, as_of), 2, "content")))
    meta = metadata_layer(query, tags, xrefs)
    lists.append(counted("metadata", meta.select(F.lit(3).alias("list_id"), "rank", "doc_id", F.lit(None).cast("string").alias("content"), "score")))
    fused = rrf(reduce(DataFrame.unionByName, lists), options.rrf_k)
    # a few dozen rows that several branches below read
    boosted = settled(excitability_boost(fused, docs, as_of))
    spread = settled(graph_boost(boosted, edges, as_of, options.limit, options=options, docs=docs))
    pool = spread.join(vectors.select("doc_id", "embedding"), "doc_id", "left")
    chosen = mmr(pool, options.limit, "spread", options.mmr_lambda)
    out = chosen.join(spread.select("doc_id", F.col("spread").alias("score")), "doc_id").select("doc_id", "position", "score")
    if not options.rerank or scorer is None:
        return out
    bodies = boosted.select("doc_id", F.col("content").alias("fused_")).join(docs.select("doc_id", F.col("content").alias("held_")), "doc_id", "full_outer")
    texts = out.join(bodies, "doc_id", "left").select("doc_id", F.coalesce("fused_", "held_").alias("content"), "score")
    judged = settled(rerank(query, texts, options.limit, scorer))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id")) - 1
    return judged.select("doc_id", place.cast("long").alias("position"), "score")
