"""Blocks of postings against the search over plain postings."""

import random

import pytest

from tidewell.operators import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    dice = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(dice.choices(words, weights, k=dice.randint(0, 60)))) for i in range(900)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, content string")
    index = retrieval.postings(docs, ["content"], porter=False).cache()
    lengths = [len((t or "").split()) for _, t in rows] + [0, 0]
    return index, len(lengths), sum(lengths) / len(lengths)


@pytest.mark.parametrize("query", ["w0 w1 w2", "w0 w300 w7", "w399", "w120 w121 w0 w1 w2 w3", "nothing", "w0 nothing"])
def test_blocks_find_the_same(spark, tmp_path, corpus, query):
    index, n, mean = corpus
    path = str(tmp_path / "blocks")
    retrieval.write_blocks(retrieval.posting_blocks(index, ranges=256), path)
    told = {}
    found = retrieval.bm25_blocks(spark.read.parquet(path), n, mean, query, 10, porter=False, told=told).collect()
    plain = retrieval.bm25_index(index, n, mean, query, 10, porter=False).collect()
    assert [(r["doc_id"], round(r["score"], 9)) for r in found] == [(r["doc_id"], round(r["score"], 9)) for r in plain]
    if query == "w0 w300 w7":
        assert told["read"] < 0.5 * told["ranges"]


def test_one_range_and_no_documents(spark, corpus):
    index, n, mean = corpus
    one = retrieval.posting_blocks(index, ranges=1)
    plain = retrieval.bm25_index(index, n, mean, "w5 w9", 7, porter=False).collect()
    assert [r["doc_id"] for r in retrieval.bm25_blocks(one, n, mean, "w5 w9", 7, porter=False).collect()] == [r["doc_id"] for r in plain]
    assert retrieval.bm25_blocks(retrieval.posting_blocks(index.limit(0)), 0, 0.0, "w5", 7).count() == 0


def test_more_tasks_than_buckets_write(spark, tmp_path, corpus):
    index, _, _ = corpus
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        retrieval.write_blocks(retrieval.posting_blocks(index), str(tmp_path / "many"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    written = [p for p in (tmp_path / "many").iterdir() if p.suffix == ".parquet"]
    assert len(written) > 64
    plan = spark.read.parquet(str(tmp_path / "many")).where("term in ('w1') and range in (3, 4)").select("n")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,w1)" in plan and "In(range, [3,4])" in plan and "held" not in plan
