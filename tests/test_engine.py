from datetime import datetime, timedelta

import pytest

from tidewell.engine import Engine, NotFound
from tidewell.functions.embed import hashing_embedder
from tidewell.sources.catalog import Catalog, SchemaMismatch

NOW = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("store")), embedder=lambda: hashing_embedder(32))
    docs = [("a::1", "Rust is a systems language with a borrow checker #rust see [[Python]]"), ("a::2", "Python is a scripting language used for data #python"), ("b::3", "Gardening in spring needs water, patience and good soil")]
    made.index(spark.createDataFrame(docs, "doc_id string, content string"), NOW)
    return made


def test_search_and_feedback(engine):
    found = engine.search("python scripting", NOW, record=True, limit=2).collect()
    assert found[0]["doc_id"] == "a::2" and len(found) == 2
    assert engine.store.read("document_access").count() == 2 and engine.store.read("co_retrieval").count() == 1
    assert engine.store.read("documents").where("access_count > 0").count() == 2
    assert engine.search("zzz qqq", NOW, limit=2).count() <= 2


def test_lifecycle_columns_survive_reindexing(spark, engine):
    before = {r["doc_id"]: r["created"] for r in engine.store.read("documents").collect()}
    engine.index(spark.createDataFrame([("a::1", "Rust is still a language #new")], "doc_id string, content string"), NOW + timedelta(days=1))
    after = {r["doc_id"]: r["created"] for r in engine.store.read("documents").collect()}
    assert before == after
    assert {r["tag"] for r in engine.store.read("document_tags").where("doc_id = 'a::1'").collect()} == {"new"}


def test_consolidation(engine):
    later = NOW + timedelta(days=40)
    counted = engine.consolidate(later, dry_run=True)
    stats = engine.consolidate(later)
    assert stats["strengthened"] == counted["strengthened"] >= 1 and engine.history().count() == 1


def test_memories(engine):
    ident = engine.remember("The deployment script lives in the tools folder and needs a key.", "events", NOW, 0.7, ttl_hours=5)
    assert engine.verified().first()["status"] == "ok"
    assert engine.update_memory(ident, NOW, importance=3.0) and engine.memories().first()["importance"] == 1.0
    assert not engine.update_memory("nothing", NOW)
    with pytest.raises(ValueError, match="too short"):
        engine.remember("tiny", "events", NOW)
    with pytest.raises(ValueError, match="category"):
        engine.remember("c" * 60, "nonsense", NOW)
    assert engine.prune_expired(NOW + timedelta(hours=6)) == 1
    with pytest.raises(NotFound):
        engine.forget(ident)


def test_handoff_and_context(engine):
    engine.set_handoff("carry on with the tests", NOW)
    assert engine.handoff() == "carry on with the tests" and "carry on" in engine.boot_context(NOW)
    engine.clear_handoff(NOW)
    assert engine.handoff() is None
    with pytest.raises(ValueError):
        engine.set_handoff("x" * 5000, NOW)


def test_store_versions(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "s"))
    store._put("_meta.json", '{"schema_version": 99}')
    with pytest.raises(SchemaMismatch):
        Catalog(spark, str(tmp_path / "s"))
