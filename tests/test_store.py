"""The store's versions, and what the engine does around searches, memories, runs, files, hooks and tools."""

import hashlib
import hmac
import io
import json
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import __main__ as shell
from tidewell import hooks, tools
from tidewell.engine import Engine, NotFound
from tidewell.functions.embed import hashing_embedder
from tidewell.functions.porter import stem
from tidewell.operators import graph, logs, memory, retrieval, text
from tidewell.operators.vectors import knn_join
from tidewell.sources import config, files, sinks
from tidewell.sources.catalog import Catalog, Conflict

NOW = datetime(2024, 2, 1)
LONG = "The deployment script lives in the tools folder and needs a key to run at all."


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), embedder=lambda: hashing_embedder(32))


def test_appends_rewrite_nothing_and_old_versions_go(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "s"))
    rows = lambda i: spark.createDataFrame([(f"d{i}", "x")], "doc_id string, tag string")
    for i in range(14):
        store.append("document_tags", rows(i))
    version, parts = store._current("document_tags")
    assert version == 14 and len(parts) == 14 and store.read("document_tags").count() == 14
    store.write("document_tags", store.read("document_tags").where("doc_id != 'd0'"))
    for i in range(20, 31):
        store.append("document_tags", rows(i))
    kept = store._versions("document_tags")
    assert len(kept) == 10 and store.read("document_tags").count() == 24
    folders = {p.name for p in (tmp_path / "s" / "document_tags").iterdir() if p.name != "_versions"}
    assert folders == {p for v in kept for p in store._names(store._parts("document_tags", v))}


def test_of_two_writers_one_conflicts(spark, tmp_path):
    one, two = Catalog(spark, str(tmp_path / "s")), Catalog(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("a", "x")], "doc_id string, tag string")
    one.write("document_tags", row)
    after, parts = two._current("document_tags")
    one.append("document_tags", row)
    with pytest.raises(Conflict):
        two._commit("document_tags", after, parts)
    assert two.read("document_tags").count() == 2


def test_a_search_rewrites_no_document(spark, engine):
    engine.index(spark.createDataFrame([("a", "water the garden in spring"), ("b", "a key to the tools")], "doc_id string, content string"), NOW)
    before = engine.store._current("documents")
    for _ in range(2):
        engine.search("garden", NOW, record=True, limit=1)
    assert engine.store._current("documents") == before
    counts = {r["doc_id"]: r["access_count"] for r in engine.store.read("documents").collect()}
    assert sum(counts.values()) == 2
    engine.store.write("documents", engine.store.read("documents"))
    assert {r["doc_id"]: r["access_count"] for r in engine.store.read("documents").collect()} == counts


def test_counts_of_another_writer_stay(spark, engine):
    """Accesses that are counted while documents are rewritten are lost by no write and counted twice by no crash."""
    engine.index(spark.createDataFrame([("a", "one"), ("b", "two")], "doc_id string, content string"), NOW)
    count = lambda n: engine.store.append("document_counters", spark.createDataFrame([("a", n, NOW)], "doc_id string, n long, last timestamp"))
    held = lambda: {r["doc_id"]: r["access_count"] for r in engine.store.read("documents").collect()}
    count(2)
    docs, at = engine.store.at("documents")
    count(5)
    engine.store.write("documents", docs, at)
    assert held() == {"a": 7, "b": 0}
    # a crash after documents were written, before their counts were dropped
    docs, at = engine.store.at("documents")
    engine.store._drop_counts = lambda absorbed: None
    engine.store.write("documents", docs, at)
    del engine.store._drop_counts
    assert held() == {"a": 7, "b": 0}
    engine.index(spark.createDataFrame([("a", "one again")], "doc_id string, content string"), NOW)
    assert held() == {"a": 7, "b": 0}
    for _ in range(70):
        count(1)
    assert held() == {"a": 77, "b": 0}
    engine.store.write("documents", engine.store.read("documents"))
    assert held() == {"a": 77, "b": 0} and engine.store._current("document_counters")[1] == []


def test_a_write_follows_the_version_that_was_read(spark, tmp_path):
    one, two = Catalog(spark, str(tmp_path / "s")), Catalog(spark, str(tmp_path / "s"))
    row = lambda x: spark.createDataFrame([(x, "t")], "doc_id string, tag string")
    one.write("document_tags", row("a"))
    held, at = one.at("document_tags")
    two.upsert("document_tags", row("b"), "doc_id")
    with pytest.raises(Conflict):
        one.write("document_tags", held, at)
    assert {r["doc_id"] for r in one.read("document_tags").collect()} == {"a", "b"}


def test_masks_rewrite_nothing_and_are_merged(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id string, tag string")
    store.append("document_tags", rows(("a", "1"), ("a", "2"), ("b", "1"), (None, "n")))
    first = store._current("document_tags")[1]
    store.replace("document_tags", rows(("a", ""), ("c", "")), "doc_id", rows(("a", "3")))
    assert store._current("document_tags")[1][:1] == first
    held = lambda: sorted((str(r["doc_id"]), r["tag"]) for r in store.read("document_tags").collect())
    assert held() == [("None", "n"), ("a", "3"), ("b", "1")]
    store.delete("document_tags", rows(("b", "")), "doc_id")
    store.append("document_tags", rows(("b", "9")))
    assert held() == [("None", "n"), ("a", "3"), ("b", "9")]
    for i in range(20):
        store.upsert("document_tags", rows(("a", str(i))), "doc_id")
    assert held() == [("None", "n"), ("a", "19"), ("b", "9")] and sum(isinstance(p, dict) for p in store._current("document_tags")[1]) <= 16


def test_an_approval_that_breaks_off_can_be_done_again(engine, monkeypatch):
    ident = engine.stage(LONG, "events", NOW)
    with monkeypatch.context() as broken:
        broken.setattr(engine, "index", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            engine.approve(ident, NOW)
    assert engine.memory(ident) and engine.staged().count() == 1
    engine.approve(ident, NOW)
    assert engine.staged().count() == 0 and engine.store.read("memories").count() == 1 and engine.store.read("documents").count() == 1


def test_unchanged_files_are_not_read(spark, engine, tmp_path, monkeypatch):
    folder = tmp_path / "notes"
    (folder / "deep").mkdir(parents=True)
    for name in ("a.md", "deep/b.TXT", "c.md"):
        (folder / name).write_text(f"The garden {name} is watered in the morning, every single day of the week.")
    (folder / "bad.md").write_bytes(b"\xff\xfe" + b"not text at all" * 9)
    (folder / "tiny.md").write_text("tiny")
    (folder / "d.png").write_bytes(b"x" * 99)
    first = engine.index_path(str(folder), NOW)
    assert (first["added"], first["errors"], first["checked"]) == (3, 1, 4)
    (folder / "c.md").write_text("A changed note about the garden, long enough to be taken up by the index.")
    later = NOW.timestamp() + 10**8
    import os

    os.utime(folder / "c.md", (later, later))
    for name in ("a.md", "deep/b.TXT"):
        os.utime(folder / name, (10**9, 10**9))
    read = []
    real = files.listed
    monkeypatch.setattr(files, "listed", lambda *a, **k: (read.append(k.get("paths")), real(*a, **k))[1])
    again = engine.index_path(str(folder), NOW)
    assert (again["added"], again["reindexed"], again["errors"], again["skipped"]) == (0, 1, 1, 2)
    assert [sorted(p.rpartition("/")[2] for p in x) for x in read if x] == [["bad.md", "c.md"]]
    plan = real(spark, str(folder)).drop("content")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_search_reads_postings_and_reports_layers(spark, engine):
    docs = [("one", "gardens are watered", "p/one.md"), ("two", "watering cans", "p/two.md"), ("three", "nothing", "notes/watered.md")]
    engine.index(spark.createDataFrame(docs, "doc_id string, content string, file_path string"), NOW)
    scan = retrieval.bm25(engine.store.read("documents"), "watered", 5, ["doc_id", "content", "file_path"], porter=True)
    from_index = engine.keywords("watered", 5)
    shape = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    assert shape(scan) == shape(from_index) and set(shape(scan)) == {"one", "two", "three"}
    stats = []
    engine.search("watered", NOW, stats=stats)
    assert [name for name, *_ in stats] == ["vector", "keyword", "graph", "metadata"] and all(ms >= 0 for _, ms, _ in stats)
    assert {name: n for name, _, n in stats} == {"vector": 3, "keyword": 3, "graph": 0, "metadata": 0}
    engine.index(spark.createDataFrame([("one", "dry")], "doc_id string, content string"), NOW)
    assert set(shape(engine.keywords("watered", 5))) == {"two", "three"}
    engine.forget_documents(spark.createDataFrame([("two",)], "doc_id string"))
    assert set(shape(engine.keywords("watered", 5))) == {"three"}


def test_bm25_by_brute_force(spark):
    dice = random.Random(2)
    words = "Reading readers read errors error sting stings dying dye eyed eying sky skies at by ties added ebbing was".split()
    rows = [(f"d{i}", " ".join(dice.choice(words) for _ in range(dice.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, content string")
    for query in ("reading errors", "eyed skies dying", "ties add by"):
        asked = list(dict.fromkeys(stem(t) for t in query.split()))
        docs = {d: [stem(t) for t in re.findall(r"\w+", c.lower())] for d, c in rows}
        average = sum(map(len, docs.values())) / len(docs)
        seen = {t: sum(t in d for d in docs.values()) for t in asked}
        expected = {}
        for d, tokens in docs.items():
            for t in asked:
                tf = tokens.count(t)
                if tf:
                    idf = max(math.log((40 - seen[t] + 0.5) / (seen[t] + 0.5)), 1e-6)
                    expected[d] = expected.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / average))
        found = {r["doc_id"]: r["score"] for r in retrieval.bm25(df, query, 100, porter=True).collect()}
        assert found.keys() == expected.keys() and all(found[d] == pytest.approx(expected[d]) for d in found)


def test_batch_neighbours_by_brute_force(spark):
    dice = np.random.RandomState(3)
    vectors = {i: dice.randn(6) for i in range(70)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(99, None)], "doc_id long, embedding array<double>")
    found = knn_join(df.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id"), df, 4, block=16).collect()
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for q in range(0, 70, 5):
        expected = sorted(vectors, key=lambda i: -cosine(vectors[q], vectors[i]))[:4]
        assert [r["doc_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == expected


def test_capped_pairs_by_brute_force(spark):
    dice = np.random.RandomState(5)
    vectors = {f"n{i:02}": dice.randn(3) for i in range(40)}
    unit = {k: v / np.linalg.norm(v) for k, v in vectors.items()}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "id string, embedding array<double>")
    counts, kept = Counter(), set()
    for a in sorted(unit):
        near = sorted((b for b in unit if b != a and unit[a] @ unit[b] >= 0.5), key=lambda b: (-(unit[a] @ unit[b]), b))[:4]
        for b in near:
            pair = (min(a, b), max(a, b))
            if pair not in kept and counts[a] < 4 and counts[b] < 4:
                counts.update(pair)
                kept.add(pair)
    found = graph.semantic_capped(graph.semantic_edges(df, 0.5, 4), 4).collect()
    assert {(r["source_id"], r["target_id"]) for r in found} == kept


def test_topics_need_notes(spark):
    notes = spark.createDataFrame([("a", "river river stone"), ("b", "river river tree"), ("c", "stone stone")], "id string, content string")
    found = {(r["id"], r["topic"], r["n"]) for r in graph.topic_clusters(notes, least_notes=3).collect()}
    assert found == {("a", "river", 2), ("b", "river", 2)}
    assert graph.topic_clusters(notes.limit(2), least_notes=3).count() == 0


def test_spreading_and_diversity(spark):
    edges = spark.createDataFrame([("e", "a", "z", "co_retrieved", 1.0, None), ("f", "a", "known", "co_retrieved", 1.0, None)], "id string, source_id string, target_id string, type string, weight double, valid_to timestamp")
    fused = spark.createDataFrame([("a", 1.0)], "doc_id string, boosted double")
    found = {r["doc_id"] for r in retrieval.graph_boost(fused, edges, NOW, 5, docs=spark.createDataFrame([("known",)], "doc_id string")).collect()}
    assert found == {"a", "known"}
    rows = spark.createDataFrame([("x", 3.0, [1.0, 0.0]), ("y", 2.9, [1.0, 0.0]), ("z", 1.0, [0.0, 1.0])], "doc_id string, score double, embedding array<double>")
    order = lambda limit: [r["doc_id"] for r in retrieval.mmr(rows, limit).orderBy("position").collect()]
    assert order(3) == ["x", "y", "z"] and order(2) == ["x", "y"]


def test_only_the_changed_memory_is_signed_anew(engine):
    one, two = engine.remember(LONG, "events", NOW), engine.remember(LONG + " Twice.", "events", NOW)
    held = engine.store.read("memories")
    engine.store.write("memories", held.withColumn("content", F.when(F.col("id") == one, F.lit("tampered " * 10)).otherwise(F.col("content"))))
    engine.update_memory(two, NOW, importance=0.9)
    assert engine.memory(one)["status"] == "TAMPERED" and engine.memory(two)["status"] == "ok"
    key = engine.store.signing_key
    row = engine.memory(two)
    payload = ":".join(row[c] for c in ("id", "category", "title", "content"))
    assert row["signature"] == hmac.new(key, payload.encode(), hashlib.sha256).hexdigest()
    engine.supersede(one, two)
    assert engine.memory(one)["superseded_by"] == two and "superseded" in engine.memory(one)["tags"]
    assert engine.duplicates_of("x", LONG).count() >= 1


def test_review_of_staged_memories(engine):
    one, two = engine.stage(LONG, "events", NOW), engine.stage(LONG + " Else.", "cases", NOW, title=60)
    assert [len(r["title"]) <= 80 for r in engine.staged().collect()] == [True, True] and engine.memories().count() == 0
    engine.approve(one, NOW)
    engine.reject(two, "not needed")
    assert [r["id"] for r in engine.memories().collect()] == [one] and engine.staged().count() == 0
    assert engine.store.read("staged_memories").where("review_status = 'rejected' and reviewer_notes = 'not needed'").count() == 1
    for ident in (one, "nothing"):
        with pytest.raises(NotFound):
            engine.approve(ident, NOW)


def test_a_failing_source_does_not_stop_a_run(spark, engine, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "note.md").write_text("A note that is long enough to be indexed by the engine, surely.")
    sources = [config.Source("bad", str(tmp_path / "missing"), "high"), config.Source("good", str(tmp_path / "good"), "low")]
    counted = engine.consolidate(NOW, sources=sources, dry_run=True)
    assert engine.history().count() == 0 and engine.store.read("documents").count() == 0 and "reindex bad" in counted["errors"]
    stats = engine.consolidate(NOW, sources=sources)
    assert "reindex bad" in stats["errors"] and engine.store.read("documents").count() == 1
    row = engine.history().first()
    assert row["duration"] > 0 and row["finished_at"] > row["started_at"] == NOW and row["id"] == 1
    assert engine.consolidate(NOW + timedelta(days=1), ("strengthen",)).get("errors") is None and engine.history().count() == 2
    assert logs.last_run(engine.store.read("consolidation_log")) > NOW


def test_sections_of_changed_files(spark, engine, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    note = "---\ntags: [Deep]\n---\n# Top\n" + "intro words that are here to be long enough " * 5 + "\n## First\n" + "body of the first section " * 20 + "\n## Second\n" + "body of the second section " * 20
    (folder / "a.md").write_text(note)
    first = engine.index_chunks(str(folder), NOW)
    assert first["files"] == 1 and first["chunks"] >= 3 and engine.store.read("documents").count() == first["chunks"]
    assert engine.store.read("document_tags").where("tag = 'deep'").count() == first["chunks"]
    assert engine.index_chunks(str(folder), NOW) == {"files": 0, "chunks": 0, "skipped": 1, "errors": 0}
    import os

    (folder / "a.md").write_text(note.split("## Second")[0])
    os.utime(folder / "a.md", (10**9, 10**9))
    again = engine.index_chunks(str(folder), NOW)
    assert again["files"] == 1 and engine.store.read("documents").count() == again["chunks"] < first["chunks"]


def test_new_documents_get_edges_to_exciting_neighbours(spark, engine):
    docs = spark.createDataFrame([("old", "water the garden in spring"), ("dull", "water the garden in autumn"), ("new", "water the garden")], "doc_id string, content string")
    engine.index(docs, NOW)
    held = engine.store.read("documents")
    engine.store.write("documents", held.withColumn("excitability", F.when(F.col("doc_id") == "old", 0.9).otherwise(0.3)))
    engine.allocate(spark.createDataFrame([("new",)], "doc_id string"))
    found = engine.store.read("edges").collect()
    assert [(r["source_id"], r["target_id"], r["type"], r["confidence"]) for r in found] == [("new", "old", "similar_to", 0.8)]


def test_source_lists(tmp_path, monkeypatch):
    listed = tmp_path / "s.toml"
    listed.write_text('[[source]]\nname = "b"\npath = "/b"\npriority = "low"\n[[source]]\nname = "a"\npath = "/a"\npriority = "high"\n')
    assert [s.name for s in config.sources(str(listed))] == ["a", "b"]
    monkeypatch.setenv(config.VARIABLE, str(listed))
    assert len(config.sources()) == 2
    monkeypatch.delenv(config.VARIABLE)
    built = [config.Source("z", "/z")]
    assert config.sources(built_in=built, default=str(tmp_path / "none")) == built
    with pytest.raises(FileNotFoundError):
        config.sources(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        config.Source("x", "/x", "urgent")


def test_reports(spark):
    found = spark.createDataFrame([("a", 1, 0.51234, "one\n\ntwo"), ("b", 0, 0.9, "x")], "doc_id string, position long, score double, content string")
    assert [json.loads(r["value"]) for r in sinks.search_json(found).collect()] == [{"doc_id": "b", "score": 0.9, "preview": "x"}, {"doc_id": "a", "score": 0.5123, "preview": "one two"}]
    stale = spark.createDataFrame([(f"d{i}", "remove") for i in range(3)] + [("f", "flag")], "doc_id string, action string")
    report = sinks.prune_report(stale, stale.limit(0).select("doc_id"), most=2)
    assert "## To remove (3)\n- `d0`\n- `d1`\n- and 1 more" in report and "## Misaligned (0)\n- none" in report
    assert json.loads(sinks.run_json({"b": 1, "a": 2})) == {"a": 2, "b": 1}


def test_hooks_and_tools(spark, engine):
    engine.index(spark.createDataFrame([(f"d{i}", "garden water " + "é" * 600) for i in range(8)], "doc_id string, content string"), NOW)
    assert hooks.on_message(engine, "hey", NOW) == "" and hooks.on_start(engine, NOW) == ""
    said = hooks.on_message(engine, "garden water", NOW)
    assert said.count("\n") == 5 and len(said.encode()) <= 3000 and all(len(x) <= 200 + 8 for x in said.splitlines())
    engine.set_handoff("é" * 600, NOW)
    assert len(hooks.on_start(engine, NOW).encode()) == 800 and hooks.on_end(engine, NOW) is None

    def ask(*requests):
        inputs, outputs = io.BytesIO(), io.BytesIO()
        for r in requests:
            tools.write_message(inputs, r)
        inputs.seek(0)
        tools.serve(engine, inputs, outputs, lambda: NOW)
        outputs.seek(0)
        return [m for m in iter(lambda: tools.read_message(outputs), None)]

    tool = lambda ident, name, **arguments: {"jsonrpc": "2.0", "id": ident, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    remembered, hits, none, short, ping = ask(
        tool(1, "remember", content=LONG, category="nonsense"), tool(2, "search", query="garden", limit=500), tool(3, "nothing"), tool(4, "update", id="x", content="tiny"), {"jsonrpc": "2.0", "id": 5, "method": "ping"}
    )
    ident = json.loads(remembered["result"]["content"][0]["text"])["id"]
    assert engine.memory(ident)["category"] == "events"
    assert 1 <= len(json.loads(hits["result"]["content"][0]["text"])) <= 50 and engine.store.read("document_access").count() > 0
    assert none["error"]["code"] == -32602 and "50" in short["error"]["message"] and ping["error"]["code"] == -32601
    assert ask({"jsonrpc": "2.0", "method": "note"}, tool(6, "verify"))[0]["result"]["content"][0]["text"] == '{"ok": 1}'


def test_shell(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "garden.md").write_text("The garden is watered in the morning, every single day of the week.")
    ask = lambda *argv: (out := io.StringIO(), shell.run(["--store", str(tmp_path / "s"), *argv], spark, NOW, out))[0].getvalue()
    assert ask("init").strip() == str(tmp_path / "s")
    assert "'added': 1" in ask("index", str(folder), "--source", "n")
    assert json.loads(ask("search", "garden", "--json").splitlines()[0])["doc_id"] == "n::garden"
    ident = ask("remember", LONG).strip()
    assert ident in ask("memories") and "strengthened" in ask("consolidate", "--dry-run") and "# Prune report" in ask("consolidate", "--report")
    ask("forget", ident)
    assert ident not in ask("memories")


def test_excerpts_and_blocks(spark):
    content = "é" * 1500 + "tail"
    df = spark.createDataFrame([(content, "---\na: 1\n---\nbody"), ("short", "no --- block ---")], "a string, b string")
    rows = df.select(text.excerpt(F.col("a")).alias("a"), text.without_block(F.col("b")).alias("b")).collect()
    assert rows[0]["a"] == "é" * 500 + "\n...\n" + "é" * 498 + "tail" and rows[1]["a"] == "short"
    assert rows[0]["b"] == "body" and rows[1]["b"] == "no --- block ---"


def test_equal_titles_are_compared_once(spark):
    rows = [(f"m{i}", "The same long title for all", "x") for i in range(30)] + [("n", "The same long title for al", "x"), ("o", "Something else entirely", "x")]
    found = memory.title_duplicates(spark.createDataFrame(rows, "id string, title string, content string")).collect()
    assert len(found) == 30 * 29 // 2 + 30 and all(r["id_a"] < r["id_b"] for r in found)


def test_the_cache_keeps_what_was_used_last(spark, tmp_path):
    from tidewell.config import Options

    made = Engine(spark, str(tmp_path / "store"), Options(cached_embeddings=3), embedder=lambda: hashing_embedder(8))
    docs = lambda *words: spark.createDataFrame([(w, w) for w in words], "doc_id string, content string")
    made.index(docs("one", "two", "three"), NOW)
    made.index(docs("one"), NOW + timedelta(days=2))
    made.index(docs("four"), NOW + timedelta(days=1))
    key = lambda w: hashlib.md5(w.encode()).hexdigest()
    kept = {r["key"] for r in made.store.read("embedding_cache").collect()}
    assert len(kept) == 3 and {key("one"), key("four")} <= kept
    assert made.store.read("embedding_uses").count() == 3
    made.index(docs("two", "three"), NOW + timedelta(days=3))
    assert {key("two"), key("three")} <= {r["key"] for r in made.store.read("embedding_cache").collect()}


def test_searches_read_the_vector_index(spark, engine, monkeypatch):
    docs = [("a", "water the garden in spring"), ("b", "a key to the tools"), ("c", "paint the kitchen wall")]
    engine.index(spark.createDataFrame(docs, "doc_id string, content string"), NOW)
    engine.index(spark.createDataFrame([("b", "water for the garden"), ("d", "an oven for bread")], "doc_id string, content string"), NOW)
    held = {r["doc_id"]: r["embedding"] for r in engine.store.read("documents").collect()}
    same = lambda: {r["doc_id"]: r["embedding"] for r in engine.vectors.rows().collect()} == held
    assert len(held) == 4 and same()
    query = hashing_embedder(32)(["garden water"])[0].tolist()
    scan = [r["doc_id"] for r in retrieval.knn(engine.store.read("documents"), query, 3).collect()]
    assert [r["doc_id"] for r in engine.vectors.search(query, 3).collect()] == scan
    monkeypatch.setattr(retrieval, "knn", lambda *a, **k: (_ for _ in ()).throw(AssertionError("scanned")))
    assert "b" in {r["doc_id"] for r in engine.search("garden water", NOW).collect()}
    engine.forget_documents(spark.createDataFrame([("b",)], "doc_id string"))
    held.pop("b")
    assert same()
    engine.rebuild_vectors()
    assert same() and engine.vectors.path.rpartition("/")[2] != "vectors_0"


def test_a_batch_of_memories(spark, engine):
    rows = [(LONG + " One.", "events", 0.5), (LONG + " Two.", "event", 7.0), (LONG + " Two.", "event", 7.0), ("too short", "events", 0.5), (LONG + " Three.", "nonsense", None)]
    told = {r["id"]: r for r in engine.remember_all(spark.createDataFrame(rows, "content string, category string, importance double"), NOW).collect()}
    assert len(told) == 4 and sum(r["stored"] for r in told.values()) == 2
    assert engine.store.read("memories").count() == 2 and engine.store.read("documents").count() == 2
    assert {r["status"] for r in engine.verified().collect()} == {"ok"}
    assert any("unknown category" in r["errors"] for r in told.values())
