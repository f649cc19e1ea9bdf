import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.functions.embed import checked_dimension, embed_cached, hashing_embedder
from tidewell.functions.porter import stem
from tidewell.operators import text
from tidewell.sources import files


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_tags_and_links(spark):
    assert one(spark, text.tags(F.col("c")), c="#A #b-c ##x a#d\n#a") == ["a", "b-c"]
    assert one(spark, text.wiki_links(F.col("c")), c="[[A]] [[shown|B]] [[ A ]] [[ ]]") == ["A", "B"]
    assert one(spark, text.sentences(F.col("c")), c="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]


def test_truncation_keeps_characters_whole(spark):
    for most in range(1, 12):
        got = one(spark, scalar.truncated(F.col("c"), most), c="aé漢b\U0001f600z")
        data = "aé漢b\U0001f600z".encode()
        assert got == data[:most].decode(errors="ignore") + ("..." if len(data) > most else "")


def test_ids(spark):
    digest = hashlib.sha256(b"a/b.md" + (3).to_bytes(8, "little")).hexdigest()[:12]
    assert one(spark, text.chunk_id(F.col("p"), F.col("i")), p="a/b.md", i=3) == f"{digest}_3"
    short = int.from_bytes(hashlib.md5(b"a/b.md").digest()[:4], "little")
    assert one(spark, text.note_id(F.col("p")), p="a/b.md") == f"note_{short:x}"


def test_markdown_sections():
    body = "# Top\nsome introduction\n## First\n" + "words " * 40 + "\n### Inner\n" + "more " * 20 + "\n## Second\nlast words"
    found = dict(text.markdown_chunks("---\nk: v\n---\n" + body))
    assert list(found) == ["intro", "First", "Inner", "Second"]
    assert found["Inner"].startswith("# Top\n\n## First\n\n### Inner") and "k: v" not in found["intro"]
    assert text.markdown_chunks("") == [] and text.markdown_chunks("tiny") == []
    long = text.markdown_chunks("A sentence of some words. " * 400)
    assert len(long) > 2 and all(len(t.encode()) <= text.CHUNK_MOST + 3 for _, t in long)


def test_variants_and_match_queries(spark):
    assert text.query_variants("CS656") == ["CS656", "cs656", "CS 656", "cs 656"]
    assert "machine learning" in text.query_variants("ML") and "ml" in text.query_variants("machine learning")
    assert "machine learning" in text.query_variants("what is machine learning?")
    assert text.query_variants(" ") == [] and len(text.query_variants("a-b_c.d e1 f 2 rag api db")) <= 12
    said = ["hello (world) -x- a", "", " -a-b- c 'd' ", "\\back |slash| \u00e9 x"]
    made = spark.createDataFrame([(q,) for q in said], "q string").select("q", text.match_expression(F.col("q")).alias("m")).collect()
    assert {r["q"]: r["m"] for r in made} == {q: text.match_query(q) for q in said}
    assert text.match_query("hello (world) -x- a") == '"hello" OR "world"' and text.match_query("") == ""


def test_frontmatter(spark):
    df = spark.createDataFrame([("---\ntags: [X, y]\n---\nbody",), ("---\n[broken\n---\nrest",), ("none",)], "content string")
    found = text.frontmatter(df).select("frontmatter", "body", text.frontmatter_tags(F.col("frontmatter")).alias("tags")).collect()
    assert (found[0]["body"], found[0]["tags"]) == ("body", ["x", "y"])
    assert (found[1]["frontmatter"], found[1]["body"]) == ("{}", "rest") and found[2]["body"] == "none"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scalar.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.8, 0, 0, 0])


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: stem(w) for w in pairs} == pairs


def test_embedding_cache(spark):
    vectors = hashing_embedder(16)(["a b", "a b", "c"])
    assert np.allclose(vectors[0], vectors[1]) and math.isclose(np.linalg.norm(vectors[2]), 1)
    docs = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "doc_id string, content string")
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    made, fresh = embed_cached(docs, empty, make=lambda: hashing_embedder(16))
    assert fresh.count() == 2 and made.where("embedding is null").count() == 0
    with pytest.raises(Exception, match="vector of length"):
        checked_dimension(made, 8).collect()


def test_scan_and_delta(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    (tmp_path / "sub" / "one.md").write_text("x" * 60)
    (tmp_path / "two.txt").write_text("short")
    (tmp_path / "three.bin").write_text("y" * 60)
    found = files.scan(spark, str(tmp_path), files.CLI, 50, "src").collect()
    assert [(r["path"], r["doc_id"]) for r in found] == [("sub/one.md", "src::sub::one")]
    disk = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.2)], "doc_id string, mtime double")
    held = spark.createDataFrame([("b", 5.0), ("c", 10.0), ("d", 1.0)], "doc_id string, indexed double")
    assert {r["doc_id"]: r["state"] for r in files.delta(disk, held).collect()} == {"a": "new", "b": "changed", "c": "same", "d": "deleted"}


def test_chunks_leave_a_worker_in_parts():
    import pandas as pd

    from tidewell.operators import text

    batch = pd.DataFrame({"doc_id": range(6), "content": ["x" * (text.CHUNK_BATCH // 2), None] * 3})
    parts = list(text._in_parts(iter([batch]), "content"))
    assert len(parts) > 1 and sorted(i for p in parts for i in p["doc_id"]) == list(range(6))
