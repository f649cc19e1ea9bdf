"""The engine: one store of documents, graph, logs and memories, and everything one does with it.

Methods give DataFrames where they give rows. Time is an argument everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import cached_property
from time import perf_counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Options
from tidewell.functions.embed import checked_dimension, embed_cached, hashing_embedder
from tidewell.operators import graph, logs, memory, retrieval, text
from tidewell.operators.vectors import VectorIndex
from tidewell.sources import files
from tidewell.sources.catalog import Catalog
from tidewell.sources.config import PRIORITIES, Source
from tidewell.sources.scratch import settled

PHASES = ("reindex", "strengthen", "reorganize", "prune")


class NotFound(KeyError):
    """No such memory, node or document."""


class Engine:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options(), embedder=hashing_embedder, scorer=None):
        self.spark, self.options, self.embedder, self.scorer = spark, options, embedder, scorer
        self.store = Catalog(spark, path)

    def _rows(self, schema: str, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # ---- ingest

    def index(self, docs: DataFrame, now: datetime) -> DataFrame:
        """Adds or replaces documents (doc_id, content, file_path?, metadata?); their lifecycle stays. Tags and links follow."""
        docs = settled(docs)
        vectors, fresh = embed_cached(docs, self.store.read("embedding_cache"), make=self.embedder)
        if not fresh.isEmpty():
            self.store.append("embedding_cache", fresh)
        self.store.append("embedding_uses", docs.select(F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("key"), F.lit(now).alias("used")).distinct())
        self._trim_cache()
        made = checked_dimension(vectors, self.dimensions).withColumns({"indexed_at": F.lit(now), "created": F.lit(now), "excitability": F.lit(0.5), "access_count": F.lit(0).cast("long")})
        ids = docs.select("doc_id")
        index = settled(retrieval.postings(docs))
        lengths = index.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        tags = docs.select("doc_id", F.explode(text.tags(F.col("content"))).alias("tag"))
        links = docs.select("doc_id", F.lit("link").alias("ref_type"), F.explode(text.wiki_links(F.col("content"))).alias("ref_target"))
        for table, rows in (("document_tags", tags), ("cross_refs", links), ("postings", index), ("document_lengths", lengths)):
            self.store.replace(table, ids, "doc_id", rows)
        self._keep_vectors(made.select("doc_id", "embedding"))
        # the documents last: if a run breaks off before, the next one finds them unchanged and does all of this again
        return self.store.upsert("documents", made, "doc_id", keep=("created", "excitability", "access_count", "last_accessed"))

    def _trim_cache(self) -> None:
        """Keeps the embeddings that were used last, as many as the options say, once there are more."""
        held, most = self.store.read("embedding_cache"), self.options.cached_embeddings
        if held.count() <= most:
            return
        (held, at), (uses, uses_at) = self.store.at("embedding_cache"), self.store.at("embedding_uses")
        last = uses.groupBy("key").agg(F.max("used").alias("used"))
        kept = settled(held.select("key").distinct().join(last, "key", "left").orderBy(F.desc_nulls_last("used"), "key").limit(most))
        self.store.write("embedding_cache", held.join(kept, "key", "left_semi").dropDuplicates(["key"]), at)
        self.store.write("embedding_uses", kept, uses_at)

    @property
    def vectors(self) -> VectorIndex:
        """The documents' vectors by cell, beside the store's tables; ``rebuild_vectors`` makes it anew."""
        return VectorIndex(self.spark, f"{self.store.path}/{self.store._text('_vectors') or 'vectors_0'}")

    def _keep_vectors(self, rows: DataFrame) -> None:
        index = self.vectors
        if index.exists():
            index.add(rows)
        else:
            VectorIndex.build(rows, index.path)

    def rebuild_vectors(self) -> None:
        """New cells for the vectors as they are, in a new folder, which searches read from then on."""
        name = f"vectors_{uuid.uuid4().hex}"
        VectorIndex.build(self.store.read("documents").select("doc_id", "embedding"), f"{self.store.path}/{name}")
        self.store._put("_vectors", name)

    @cached_property
    def dimensions(self) -> int:
        return len(self.embedder()([""])[0])

    def index_chunks(self, root: str, now: datetime, extensions: tuple[str, ...] = files.MARKDOWN) -> dict[str, int]:
        """Indexes the sections of the Markdown files that the file cache doesn't have as they are; those of a changed file go first.

        Files that aren't UTF-8 are counted as errors, and tried again by the next run. No other file is read.
        """
        disk = settled(files.listed(self.spark, root, extensions).drop("content"))
        todo = files.needs_update(self.store.read("file_cache"), disk.withColumn("cache_key", F.col("path")))
        loaded = settled(files.read_some(self.spark, root, todo, extensions=extensions).withColumnRenamed("path", "file_path"))
        todo = loaded.where("content is not null").withColumn("cache_key", F.col("file_path"))
        front = text.frontmatter(todo)
        chunks = text.chunk_markdown(todo, "file_path").withColumnRenamed("file_path", "path")
        meta = front.select(F.col("file_path").alias("path"), F.col("frontmatter").alias("metadata"), text.frontmatter_tags(F.col("frontmatter")).alias("tags"))
        made = settled(chunks.join(meta, "path").select("doc_id", "content", F.col("path").alias("file_path"), "metadata", "tags"))
        self.forget_files(todo.select("file_path"))
        self.index(made.drop("tags"), now)
        tags = made.select("doc_id", F.explode("tags").alias("tag"))
        self.store.insert_new("document_tags", tags, ["doc_id", "tag"])
        seen = todo.select("cache_key", F.col("mtime").alias("last_modified"), F.lit(root).alias("source_name"))
        self.store.upsert("file_cache", seen, "cache_key")
        read, failed = todo.count(), loaded.where("content is null").count()
        return {"files": read, "chunks": made.count(), "skipped": disk.count() - read - failed, "errors": failed}

    def forget_files(self, paths: DataFrame) -> None:
        """Removes all documents of the files (file_path)."""
        held = self.store.read("documents").join(paths.select("file_path").distinct(), "file_path", "left_semi").select("doc_id")
        held = settled(held)
        if not held.isEmpty():
            self.forget_documents(held)

    def index_path(self, root: str, now: datetime, source: str | None = None, prune: bool = True, extensions: tuple[str, ...] = files.CLI, dry_run: bool = False) -> dict[str, int]:
        """Indexes the new and changed files under a folder and drops the documents of those that are gone; a dry run counts.

        Files that can't be read as UTF-8 are counted as errors; files that are as they were aren't read.
        """
        disk = settled(files.listed(self.spark, root, extensions, 50, source).drop("content"))
        own = files.under(self.store.read("documents"), f"{source}::", "doc_id") if source else self.store.read("documents")
        held = own.where("file_path is not null").select("doc_id", F.coalesce(F.unix_micros("indexed_at") / 1e6, F.lit(0.0)).alias("indexed"))
        changes = settled(files.delta(disk, held))
        counts = files.reindex_counts(changes).first().asDict() | {"errors": 0}
        if dry_run:
            return counts
        chosen = disk.join(changes.where("state in ('new', 'changed')"), "doc_id", "left_semi")
        loaded = settled(files.read_some(self.spark, root, chosen, extensions=extensions, least_bytes=50, source=source))
        todo, failed = loaded.where("content is not null"), loaded.where("content is null").select("doc_id")
        lost = changes.join(failed, "doc_id").groupBy("state").count().collect()
        for r in lost:
            name = {"new": "added", "changed": "reindexed"}[r["state"]]
            counts |= {name: counts[name] - r["count"], "errors": counts["errors"] + r["count"]}
        self.index(todo.select("doc_id", "content", F.col("path").alias("file_path")), now)
        if counts["added"]:
            self.allocate(settled(changes.where("state = 'new'").join(failed, "doc_id", "left_anti").select("doc_id")))
        if prune and counts["pruned"]:
            self.forget_documents(changes.where("state = 'deleted'").select("doc_id"))
        return counts

    def allocate(self, ids: DataFrame) -> None:
        """Edges from new documents (doc_id) to the exciting ones among their nearest."""
        docs, o = self.store.read("documents").select("doc_id", "embedding", "excitability"), self.options.graph
        made = graph.allocation_edges(docs.join(ids, "doc_id", "left_semi"), docs, o.allocation_above, o.allocation_k)
        made = settled(made.withColumn("id", F.sha2(F.concat_ws("::", "type", "source_id", "target_id"), 256)))
        if not made.isEmpty():
            ends = made.select(F.col("source_id").alias("id")).unionByName(made.select(F.col("target_id").alias("id")))
            self.store.insert_new("nodes", ends.select("id", F.lit("document").alias("type"), F.col("id").alias("title")), "id")
            self.store.upsert("edges", made, "id")

    def forget_documents(self, ids: DataFrame) -> None:
        if self.vectors.exists():
            self.vectors.remove(ids)
        for table in ("documents", "document_tags", "cross_refs", "postings", "document_lengths"):
            self.store.delete(table, ids, "doc_id")

    def build_graph(self, now: datetime, force: bool = False) -> dict:
        """Nodes and edges from the documents: links, tags, dates, entities, topics and similarity; merged and pruned.

        What each note adds is kept as rows (graph.note_parts); only notes that are new or changed are read again, and if no
        note has changed since the last build nothing is done. ``force`` reads all. The result has the numbers of nodes and
        edges, of notes read, whether the build was skipped, and for each stage its milliseconds and rows.
        """
        o, began, stages = self.options.graph, perf_counter(), {}
        docs = self.store.read("documents")
        notes = docs.select(F.col("doc_id").alias("id"), F.lit("note").alias("type"), text.title_of(F.coalesce("file_path", "doc_id")).alias("title"), "content", "embedding")
        changes, read = self._changed_notes(docs, force)
        if changes is None:
            return graph.graph_stats(self.store.read("nodes"), self.store.read("edges")).first().asDict() | {"notes_read": 0, "skipped": True, "stages": {}}

        def stage(name: str, rows: DataFrame) -> DataFrame:
            nonlocal began
            held = settled(rows)
            stages[name] = {"ms": round(1000 * (perf_counter() - began), 1), "rows": held.count()}
            began = perf_counter()
            return held

        made = stage("parts", graph.note_parts(notes.join(changes.where("hash is not null").select(F.col("doc_id").alias("id")), "id", "left_semi")))
        self.store.replace("note_parts", changes.select("doc_id"), "doc_id", made)
        parts = self.store.read("note_parts")
        tag_nodes, explicit = graph.explicit_of(parts, notes)
        explicit = stage("explicit", explicit)
        entities = stage("entities", graph.entities_of(parts, o.entity_frequency))
        enough = o.topic_notes <= 1 or notes.limit(o.topic_notes).count() >= o.topic_notes
        topics = stage("topics", graph.topics_of(parts if enough else parts.limit(0)))
        near = stage("semantic", graph.semantic_capped(graph.semantic_edges(notes, o.semantic, o.per_node), o.per_node))
        dated = docs.select(F.col("doc_id").alias("id"), graph.date_of(F.coalesce("file_path", "doc_id"), F.col("metadata")).alias("date")).where("date is not null")
        dates = stage("temporal", graph.temporal_edges(dated, o.temporal_days, o.temporal_edges, o.per_node))

        def edges(rows: DataFrame, kind: str, target: str, weight: float, confidence: float) -> DataFrame:
            return rows.select(F.col("id").alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence")).distinct()

        every = explicit.unionByName(edges(entities, "mentions", "entity_id", 0.6, 0.8)).unionByName(edges(topics, "discusses", "topic_id", 0.7, 0.6))
        every = every.unionByName(near.select("source_id", "target_id", F.lit("similar_to").alias("type"), "weight", F.col("weight").alias("confidence")))
        every = every.unionByName(dates.select("source_id", "target_id", F.lit("temporal").alias("type"), "weight", F.lit(0.7).alias("confidence")))
        every = every.withColumn("id", F.sha2(F.concat_ws("::", "type", "source_id", "target_id"), 256))
        nodes = notes.select("id", "type", "title").unionByName(tag_nodes)
        nodes = nodes.unionByName(entities.select(F.col("entity_id").alias("id"), F.lit("entity").alias("type"), F.col("entity").alias("title")))
        nodes = nodes.unionByName(topics.select(F.col("topic_id").alias("id"), F.lit("topic").alias("type"), F.col("topic").alias("title")))
        nodes, every = graph.merge_duplicates(nodes.groupBy("id").agg(F.min("type").alias("type"), F.min("title").alias("title")), every)
        kept = stage("prune", graph.prune_greedy(every, o.min_weight, o.max_per_node))
        score = stage("centrality", graph.centrality(kept)).select("id", F.col("score").alias("importance_score"))
        told = nodes.join(score, "id", "left").join(text.note_facts(docs), "id", "left")
        facts = F.to_json(F.struct("importance_score", "word_count", "modified_time"))
        self.store.upsert("nodes", told.select("id", "type", "title", F.nullif(facts, F.lit("{}")).alias("metadata")), "id")
        self.store.upsert("edges", kept, "id")
        # the notes' marks last: a build that breaks off is done again
        self.store.replace("graph_notes", changes.select("doc_id"), "doc_id", changes.where("hash is not null").select("doc_id", "hash"))
        return graph.graph_stats(self.store.read("nodes"), self.store.read("edges")).first().asDict() | {"notes_read": read, "skipped": False, "stages": stages}

    def _changed_notes(self, docs: DataFrame, force: bool) -> tuple[DataFrame | None, int]:
        """((doc_id, hash) of the notes that are new or changed since the last build, without hash of those that are gone; how
        many are there to read), or None if there are none."""
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("content", "file_path", "metadata", "embedding")]
        now_ = docs.select("doc_id", F.md5(F.concat_ws("\u0001", *fields)).alias("hash"))
        held = self.store.read("graph_notes").select(F.col("doc_id").alias("held_id"), F.col("hash").alias("held"))
        both = now_.join(held, F.col("doc_id") == F.col("held_id"), "full_outer")
        changed = both if force else both.where(~F.col("hash").eqNullSafe(F.col("held")))
        changes = settled(changed.select(F.coalesce("doc_id", "held_id").alias("doc_id"), "hash"))
        if changes.isEmpty() and not self.store.read("nodes").isEmpty():
            return None, 0
        return changes, changes.where("hash is not null").count()

    # ---- search

    def keywords(self, query: str, k: int) -> DataFrame:
        """The k best documents by BM25 from the stored postings."""
        corpus = self.store.read("document_lengths").agg(F.count("*"), F.avg("dl")).first()
        return retrieval.bm25_index(self.store.read("postings"), corpus[0], corpus[1] or 0.0, query, k)

    def search(self, query: str, now: datetime, record: bool = False, limit: int | None = None, stats: list | None = None) -> DataFrame:
        """(doc_id, position, score, content) of the layered search; ``record`` logs the hits and the pairs found together."""
        options = self.options.search if limit is None else type(self.options.search)(**{**self.options.search.__dict__, "limit": limit})
        docs, read = self.store.read("documents"), self.store.read
        vector = np.asarray(self.embedder()([query])[0], dtype=float).tolist()
        found = retrieval.hybrid_search(query, vector, docs, docs.where("embedding is not null"), read("document_tags"), read("cross_refs"), read("nodes"), read("edges"), now, options, self.scorer, self.keywords, self.vectors.search if self.vectors.exists() else None, stats)
        found = found.join(docs.select("doc_id", "content"), "doc_id", "left").orderBy("position")
        if record:
            found = found.cache()
            self.record(query, found, now)
        return found

    def record(self, query: str, results: DataFrame, now: datetime) -> None:
        hits = logs.search_hits(results, query, now)
        self.store.append("document_access", hits)
        top = results.withColumn("batch", F.lit(0))
        self.store.append("co_retrieval", logs.feedback_pairs(top, ["batch"], ["position"]).select("doc_id_a", "doc_id_b", F.lit(query).alias("query"), F.lit(now).alias("ts")))
        # counted in a log of their own, which reads of documents add up; no document is rewritten by a search
        counted = hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        self.store.append("document_counters", counted)

    def suggest(self, anchor: str, now: datetime, limit: int = 5) -> DataFrame:
        """Documents often found together with a document, or with the best hit of a search for ``anchor``."""
        docs = self.store.read("documents")
        if docs.where(F.col("doc_id") == anchor).isEmpty():
            best = self.search(anchor, now, limit=1).first()
            anchor = best["doc_id"] if best else anchor
        return graph.suggest(self.store.read("edges"), docs, anchor, now, limit)

    def invalidate_edges(self, ids: list[str], now: datetime) -> None:
        held, at = self.store.at("edges")
        self.store.write("edges", graph.invalidate(held, self._rows("id string", [(i,) for i in ids]), now), at)

    def connections(self, title: str, now: datetime, depth: int = 2) -> DataFrame:
        nodes = self.store.read("nodes")
        if nodes.where(F.contains(F.lower("title"), F.lit(title.lower()))).isEmpty():
            raise NotFound(title)
        return graph.connections(nodes, self.store.read("edges"), title, depth, now)

    # ---- consolidation

    def consolidate(self, now: datetime, phases: tuple[str, ...] = PHASES, sources: Sequence[Source] = (), dry_run: bool = False) -> dict:
        """Runs the phases and logs the run: a row at its start, which its end replaces. A dry run only counts.

        A source or a phase that fails doesn't stop the others; what went wrong is under "errors".
        """
        began, stats, errors = perf_counter(), {}, {}
        runs = self.store.read("consolidation_log")
        cutoff, ident = logs.last_run(runs), (runs.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(ident).cast("long").alias("id"), F.lit(now).alias("started_at"))
        if not dry_run:
            self.store.append("consolidation_log", row)

        def tried(name: str, work) -> None:
            try:
                stats.update(work())
            except Exception as error:  # noqa: BLE001  whatever a source or a phase raises
                errors[name] = f"{type(error).__name__}: {error}"[:500]

        order = {p: i for i, p in enumerate(PRIORITIES)}
        if "reindex" in phases:
            for source in sorted(sources, key=lambda x: order.get(x.priority, 9)):
                tried(f"reindex {source.name}", lambda source=source: {f"reindexed {source.name}": self.index_path(source.path, now, source.name, dry_run=dry_run)["reindexed"]})
        for name, phase in (("strengthen", self._strengthen), ("reorganize", self._reorganize), ("prune", self._prune)):
            if name in phases:
                tried(name, lambda phase=phase: phase(now, cutoff, sources, dry_run))
        if not dry_run:
            counted = {k: v for k, v in stats.items() if k in ("strengthened", "decayed", "reinforced", "faded", "flagged", "removed")}
            took = perf_counter() - began
            done = row.select("*", F.lit(now + timedelta(seconds=took)).alias("finished_at"), F.lit(took).alias("duration"), *[F.lit(v).cast("long").alias(k) for k, v in counted.items()])
            self.store.upsert("consolidation_log", done, "id")
        return stats | ({"errors": errors} if errors else {})

    def _strengthen(self, now: datetime, cutoff: datetime | None, sources: Sequence[Source], dry_run: bool) -> dict[str, int]:
        held, at = self.store.at("documents")
        o, docs = self.options, settled(held)
        access = logs.since(self.store.read("document_access"), cutoff)
        boost = logs.strengthen_boost(docs, access, o.lifecycle).select("doc_id", "new_excitability")
        fade = logs.strengthen_decay(docs, access, now, o.lifecycle).select("doc_id", "new_excitability")
        stats = {"strengthened": boost.count(), "decayed": fade.count()}
        if not dry_run:
            new = docs.join(boost.unionByName(fade), "doc_id", "left").withColumn("excitability", F.coalesce("new_excitability", "excitability"))
            self.store.write("documents", new.drop("new_excitability"), at)
        return stats

    def _reorganize(self, now: datetime, cutoff: datetime | None, sources: Sequence[Source], dry_run: bool) -> dict[str, int]:
        o, pairs, (edges, at) = self.options, self.store.read("co_retrieval"), self.store.at("edges")
        made = logs.reinforce(logs.since(pairs, cutoff, inclusive=False), edges, o.co_retrieval)
        rows = settled(made.select("id", "source_id", "target_id", F.lit("co_retrieved").alias("type"), "weight", "confidence"))
        stats = {"reinforced": rows.count()}
        if not dry_run:
            ends = rows.select(F.col("source_id").alias("id")).unionByName(rows.select(F.col("target_id").alias("id")))
            self.store.insert_new("nodes", ends.select("id", F.lit("document").alias("type"), F.col("id").alias("title")), "id")
            self.store.upsert("edges", rows, "id")
            edges, at = self.store.at("edges")
        faded = logs.fade_edges(edges, pairs, now, o.co_retrieval).select(F.col("id"), "removed", "new_weight")
        stats["faded"] = faded.count()
        if not dry_run:
            joined = edges.join(faded, "id", "left").withColumns({"weight": F.coalesce("new_weight", "weight"), "valid_to": F.when(F.col("removed"), F.lit(now)).otherwise(F.col("valid_to"))})
            self.store.write("edges", joined.drop("removed", "new_weight"), at)
        return stats

    def _prune(self, now: datetime, cutoff: datetime | None, sources: Sequence[Source], dry_run: bool) -> dict[str, int]:
        o = self.options
        stale, misaligned = self.prune_candidates(now, sources)
        stale = settled(stale)
        stats = {"flagged": stale.where("action = 'flag'").count(), "removed": stale.where("action = 'remove'").count(), "misaligned": misaligned.count()}
        if dry_run:
            return stats
        if stats["removed"]:
            self.forget_documents(stale.where("action = 'remove'").select("doc_id"))
        for table in ("document_access", "co_retrieval"):
            held, at = self.store.at(table)
            self.store.write(table, logs.retain(held, now, o.prune), at)
        return stats

    def prune_candidates(self, now: datetime, sources: Sequence[Source] = ()) -> tuple[DataFrame, DataFrame]:
        """(stale documents with what is to be done, misaligned documents); sinks.prune_report writes them down."""
        priorities = self._rows("source string, priority string", [(s.name, s.priority) for s in sources])
        docs = self.store.read("documents")
        return logs.prune_stale(docs, priorities, now, self.options.prune), logs.prune_misaligned(docs, self.store.read("document_access"), self.options.prune)

    def history(self, n: int = 20) -> DataFrame:
        return logs.run_history(self.store.read("consolidation_log"), n)

    def stats(self, now: datetime) -> dict[str, DataFrame]:
        docs, access = self.store.read("documents"), self.store.read("document_access")
        return {
            "documents": logs.corpus_stats(docs),
            "queries": logs.top_queries(access),
            "alerts": logs.health_alerts(docs, self.store.read("consolidation_log"), now),
            "histogram": logs.excitability_histogram(docs),
            "at_risk": logs.at_risk(docs, now),
            "memories": memory.memory_stats(self.store.read("memories"), self.store.read("staged_memories"), self.store.read("memory_access")),
            "graph": graph.graph_stats(self.store.read("nodes"), self.store.read("edges")),
        }

    # ---- memories

    def _made(self, content: str, category: str, now: datetime, importance: float, ttl_hours: int | None, strict: bool, title: int) -> DataFrame:
        made = memory.remembered(self._rows("content string, category string, importance double", [(content, category, importance)]), now, strict, title)
        made = made.withColumn("abstract_text", F.substring("content", 1, 200))
        if ttl_hours is not None:
            made = memory.with_ttl(made, ttl_hours, now)
        return settled(memory.validate(memory.sign(made, self.store.signing_key)))

    def stage(self, content: str, category: str, now: datetime, importance: float = 0.5, ttl_hours: int | None = None, strict: bool = True, title: int = 80) -> str:
        """Checks and signs a memory and puts it up for review; its id."""
        made = self._made(content, category, now, importance, ttl_hours, strict, title)
        row = made.first()
        if row["category"] is None or row["errors"]:
            raise ValueError("; ".join(row["errors"]) or f"unknown category {category}")
        self.store.upsert("staged_memories", made.withColumns({"review_status": F.lit("pending"), "staged_at": F.lit(now)}), "id")
        return row["id"]

    def staged(self) -> DataFrame:
        return self.store.read("staged_memories").where("review_status = 'pending'").orderBy("staged_at", "id")

    def _reviewed(self, ident: str, approve: bool, notes: str | None) -> tuple[DataFrame, DataFrame, tuple]:
        """(the memory if it is approved, what stays staged, the version that was read)."""
        held, at = self.store.at("staged_memories")
        held = settled(held)
        if held.where((F.col("id") == ident) & (F.col("review_status") == "pending")).isEmpty():
            raise NotFound(ident)
        decision = self._rows("id string, approve boolean, notes string", [(ident, approve, notes)])
        promoted, left = memory.review(held, decision)
        return settled(promoted.where(F.col("id") == ident)), left, at

    def approve(self, ident: str, now: datetime, notes: str | None = None) -> None:
        """A staged memory becomes a memory and a document. It leaves the staged ones last, so a run that breaks off loses
        nothing and can be done again."""
        promoted, left, at = self._reviewed(ident, True, notes)
        self.store.upsert("memories", promoted, "id")
        self.index(memory.as_document(promoted), now)
        self.store.write("staged_memories", left, at)

    def reject(self, ident: str, notes: str | None = None) -> None:
        _, left, at = self._reviewed(ident, False, notes)
        self.store.write("staged_memories", left, at)

    def remember(self, content: str, category: str, now: datetime, importance: float = 0.5, ttl_hours: int | None = None, strict: bool = True, title: int = 80) -> str:
        """Checks, signs, stages and approves a memory and indexes it; its id. Its title is the first line, ``title`` characters."""
        ident = self.stage(content, category, now, importance, ttl_hours, strict, title)
        self.approve(ident, now)
        return ident

    def remember_all(self, batch: DataFrame, now: datetime, strict: bool = True, title: int = 80) -> DataFrame:
        """(id, title, stored, errors) of a batch of memories (content, category, importance): those without errors become memories
        and documents together. Of equal contents one is kept."""
        made = memory.remembered(batch, now, strict, title).withColumn("abstract_text", F.substring("content", 1, 200)).dropDuplicates(["id"])
        checked = settled(memory.validate(memory.sign(made, self.store.signing_key)))
        unknown = F.when(F.col("category").isNull(), F.array(F.lit("unknown category"))).otherwise(F.array().cast("array<string>"))
        told = checked.withColumn("errors", F.concat("errors", unknown)).withColumn("stored", F.size("errors") == 0)
        good = settled(told.where("stored"))
        if not good.isEmpty():
            self.store.upsert("memories", good, "id")
            self.index(memory.as_document(good), now)
        return told.select("id", "title", "stored", "errors")

    def accessed(self, ident: str, kind: str, now: datetime) -> None:
        self.store.append("memory_access", self._rows("memory_id string, access_type string, ts timestamp", [(ident, kind, now)]))

    def log_event(self, kind: str, now: datetime, target: str | None = None, query: str | None = None, metadata: str | None = None) -> None:
        self.store.append("events", self._rows("event_type string, target_id string, query string, metadata string, ts timestamp", [(kind, target, query, metadata, now)]))

    def memory(self, ident: str) -> dict:
        """A memory with the status of its signature."""
        row = self.verified().where(F.col("id") == ident).first()
        if row is None:
            raise NotFound(ident)
        return row.asDict()

    def supersede(self, ident: str, by: str) -> None:
        held, at = self.store.at("memories")
        if held.where(F.col("id").isin(ident, by)).count() < 2:
            raise NotFound(ident)
        self.store.write("memories", memory.supersede(held, self._rows("id string, superseded_by string", [(ident, by)])), at)

    def duplicates_of(self, content: str, title: str) -> DataFrame:
        """Memories whose title is nearly that of a new one (id_a "new", id_b, similarity)."""
        return memory.title_duplicates(self._rows("id string, title string, content string", [("new", title, content)]), self.store.read("memories"))

    def memories(self, n: int = 20) -> DataFrame:
        return memory.latest(self.store.read("memories"), n)

    def verified(self) -> DataFrame:
        return memory.signature_status(self.store.read("memories"), self.store.signing_key)

    def update_memory(self, ident: str, now: datetime, content: str | None = None, importance: float | None = None) -> bool:
        held = settled(self.store.read("memories").where(F.col("id") == ident))
        if held.isEmpty():
            return False
        changed = memory.update(held, self._rows("id string, content string, importance double", [(ident, content, importance)]), now)
        # only this memory is signed anew: another that was tampered with must stay so
        self.store.upsert("memories", settled(memory.sign(changed, self.store.signing_key)), "id")
        self.index(memory.as_document(self.store.read("memories").where(F.col("id") == ident)), now)
        return True

    def forget(self, ident: str) -> None:
        """Removes a memory and its document."""
        gone = self._rows("id string", [(ident,)])
        if self.store.read("memories").join(gone, "id", "left_semi").isEmpty():
            raise NotFound(ident)
        self.store.delete("memories", gone, "id")
        self.forget_documents(gone.withColumnRenamed("id", "doc_id"))

    def prune_expired(self, now: datetime) -> int:
        held = self.store.read("memories")
        gone = settled(held.join(memory.prune_expired(held, now).select("id"), "id", "left_anti").select("id"))
        self.forget_documents(gone.withColumnRenamed("id", "doc_id"))
        self.store.delete("memories", gone, "id")
        return gone.count()

    def age_memories(self, now: datetime) -> int:
        held, at = self.store.at("memories")
        aged = memory.decay_and_boost(held, self.store.read("memory_access"), now).select("id", "new_importance")
        joined = held.join(aged, "id", "left").withColumn("importance", F.coalesce("new_importance", "importance"))
        changed = aged.join(held.select("id", "importance"), "id").where("importance != new_importance").count()
        self.store.write("memories", joined.drop("new_importance"), at)
        return changed

    # ---- context

    def set_handoff(self, content: str, now: datetime, layer: str = "session") -> None:
        if len(content.encode()) > memory.MAX_HANDOFF_BYTES:
            raise ValueError("handoff too long")
        row = self._rows("key string, layer string, value string, updated timestamp", [("handoff", layer, content, now)])
        self.store.upsert("context_data", row, ["key", "layer"])

    def handoff(self) -> str | None:
        row = memory.context_lookup(self.store.read("context_data")).where("key = 'handoff' and value != ''").first()
        return row["value"] if row else None

    def clear_handoff(self, now: datetime) -> None:
        held, at = self.store.at("context_data")
        self.store.write("context_data", held.where("key != 'handoff'"), at)

    def boot_context(self, now: datetime, seen: tuple[str, ...] = ()) -> str:
        """What a session starts with: the handoff within 800 bytes, then memories within their budget."""
        out = []
        note = self.handoff()
        if note:
            cut = note if len(note.encode()) <= 800 else note.encode()[:800].decode(errors="ignore").rpartition(" ")[0]
            out.append(f"[Handoff]\n{cut}\n")
        hot = self.store.read("documents").where("excitability > 0.6").orderBy(F.desc("excitability"), "doc_id").limit(3)
        hot = hot.select(F.col("doc_id").alias("id"), F.lit("documents").alias("category"), F.col("doc_id").alias("title"), F.substring("content", 1, 200).alias("abstract_text"), F.col("excitability").alias("importance"))
        entries = self.memories(20).select("id", "category", "title", "abstract_text", "importance").unionByName(hot)
        lines = [r["line"] for r in memory.injection(entries, list(seen)).orderBy(F.desc("importance"), "id").collect()]
        if lines:
            out.append("[Relevant context from memory]\n" + "".join(lines))
        return "\n".join(out)

    def recall(self, query: str, now: datetime, limit: int = 5) -> DataFrame:
        """Search results as short snippets; not recorded."""
        return self.search(query, now, limit=limit).select("doc_id", "score", F.substring("content", 1, 200).alias("snippet"))


def next_run(last: datetime | None, now: datetime, hours: int = 6) -> datetime:
    return now if last is None else max(now, last + timedelta(hours=hours))
