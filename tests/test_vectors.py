"""Vectors in cells against plain numpy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import graph, vectors


def clustered(n, dims=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return (middles[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))).round(3)


def frame(spark, found, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(found)], "doc_id long, embedding array<float>")


def cosines(a, b):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    return unit(np.asarray(a, dtype=np.float32).astype(float)) @ unit(np.asarray(b, dtype=np.float32).astype(float)).T


def top(found, query, k, alive=None):
    scores = cosines(found, query[None])[:, 0]
    order = sorted((i for i in range(len(found)) if alive is None or i in alive), key=lambda i: (-round(scores[i], 9), i))
    return order[:k]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = clustered(1500)
    return found, vectors.VectorIndex.build(frame(spark, found), str(tmp_path_factory.mktemp("index")), cells=24)


def test_exact_search_reads_few_cells(index):
    found, held = index
    read = []
    for q in (found[3], found[700] + 0.1, -found[9], np.ones(8)):
        result = held.search(q, 10)
        assert [r["doc_id"] for r in result.collect()] == top(found, q, 10)
        read.append(len(held.reach(q, 10)))
    assert min(read) <= 6
    plan = held.search(found[3], 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_recall_of_few_cells(index):
    found, held = index
    hit = total = 0
    for i in range(0, 1500, 100):
        truth = set(top(found, found[i], 10))
        hit += len(truth & {r["doc_id"] for r in held.search(found[i], 10, probe=4).collect()})
        total += 10
    assert hit / total >= 0.9


def test_rows_are_added_replaced_and_removed(spark, tmp_path):
    found = clustered(300, seed=4)
    held = vectors.VectorIndex.build(frame(spark, found[:200]), str(tmp_path / "a"), cells=9)
    held.add(frame(spark, found[200:], 200))
    moved = found.copy()
    moved[5], moved[250] = found[17] + 0.01, -found[250]
    held.add(spark.createDataFrame([(i, [float(x) for x in moved[i]]) for i in (5, 250)], "doc_id long, embedding array<float>"))
    held.remove(spark.createDataFrame([(17,), (299,)], "doc_id long"))
    alive = set(range(300)) - {17, 299}
    for index in (held, held.compact(str(tmp_path / "b"))):
        assert index.rows().count() == 298
        for q in (moved[17], moved[250], found[250], moved[299]):
            assert [r["doc_id"] for r in index.search(q, 5).collect()] == top(moved, q, 5, alive)
    held.add(spark.createDataFrame([(17, [0.0] * 8), (400, None)], "doc_id long, embedding array<float>"))
    assert held.rows().count() == 299 and held.search(found[0], 500).count() == 299


def test_empty_index(spark, tmp_path):
    empty = frame(spark, np.zeros((0, 8)))
    held = vectors.VectorIndex.build(empty, str(tmp_path / "none"))
    assert held.search([1.0] * 8, 3).count() == 0
    held.add(frame(spark, clustered(5)))
    assert held.search([1.0] * 8, 3).count() == 3
    assert vectors.knn_join(frame(spark, clustered(3)).withColumnRenamed("doc_id", "query_id"), empty, 2).count() == 0


@pytest.mark.parametrize("cells,block", [(None, 2048), (6, 64)])
def test_join_is_exact(spark, cells, block):
    found = clustered(500, seed=8)
    found[40:60] = found[39]
    asked = clustered(40, seed=9)
    docs = frame(spark, found).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [1.0])], "doc_id long, embedding array<float>"))
    result = vectors.knn_join(frame(spark, asked).withColumnRenamed("doc_id", "query_id"), docs, 4, cells=cells, block=block).collect()
    by = {}
    for r in sorted(result, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["doc_id"])
    assert by == {i: top(found, q, 4) for i, q in enumerate(asked)}


@pytest.mark.parametrize("cells,block", [(None, 2048), (10, 50)])
def test_similar_pairs_are_all_pairs(spark, cells, block):
    found = clustered(260, seed=3)
    found[100:130] = found[99]  # one vector thirty times
    held = frame(spark, found).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8)], "doc_id long, embedding array<float>"))
    scores = cosines(found, found)
    expected = set()
    for i in range(len(found)):
        near = sorted((j for j in range(len(found)) if j != i and scores[i, j] >= 0.7), key=lambda j: (-round(scores[i, j], 9), j))
        expected |= {(i, j) for j in near[:5]}
    result = vectors.similar_pairs(held, 0.7, 5, "doc_id", cells=cells, block=block).collect()
    assert {(r["source_id"], r["target_id"]) for r in result} == expected and len(result) == len(expected)
    assert all(abs(r["weight"] - min(1.0, scores[r["source_id"], r["target_id"]])) < 1e-6 for r in result)
    merged = {(r["source_id"], r["target_id"]) for r in graph.semantic_edges(held, 0.7, 5, key="doc_id").collect()}
    assert merged == {(min(p), max(p)) for p in expected}


def test_most_cells_are_skipped(spark):
    found = clustered(800, dims=16, groups=40, seed=2)
    classes = frame(spark, found).select(F.col("doc_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    pairs, visits = vectors.similar_classes(classes, 0.8, cells=40)
    assert visits < 0.3 * 40 * len(found)
    truth = np.argwhere(np.triu(cosines(found, found) >= 0.8, 1))
    assert pairs.count() == len(truth)


def test_similar_pairs_beyond_the_nearest_are_never_written(spark):
    found = np.abs(np.random.default_rng(6).normal(size=(700, 6))) + 1  # every pair is similar
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared) for f in files)
    before = size()
    result = vectors.similar_pairs(frame(spark, found), 0.3, 3, "doc_id", cells=4).collect()
    assert len(result) == 3 * len(found)
    assert size() - before < 1_000_000  # 244,650 pairs took five times that
    scores = cosines(found, found) - 2 * np.eye(len(found))
    assert all(r["weight"] >= np.sort(scores[r["source_id"]])[-3] - 1e-9 for r in result)


def test_nearest_of_equal_directions_go_by_id(spark):
    base = clustered(40, dims=4, groups=3, seed=5)
    rows = [(f"n{(9 * i + p) * 7 % 1000:03}", i, [float(np.float32(x)) * 2.0**p for x in v]) for i, v in enumerate(base) for p in range(9)]
    assert len({r[0] for r in rows}) == len(rows)
    held = spark.createDataFrame([(a, v) for a, _, v in rows], "id string, v array<double>")
    got = {}
    for r in vectors.nearest_classes(held, 0.9, 5, cells=3, block=16).collect():
        got.setdefault(r["class"], set()).add(r["other"])
    scores = cosines(base, base)
    np.fill_diagonal(scores, 1.0)
    for a, i, _ in rows:
        order = sorted((o for o in rows if o[0] != a and scores[i, o[1]] >= 0.9), key=lambda o: (-round(scores[i, o[1]], 12), o[0]))
        assert got[a] == {o[0] for o in order[:5]}


def test_join_copies_no_query_into_every_cell(spark, monkeypatch):
    found, asked = np.random.default_rng(4).normal(size=(600, 16)).round(3), np.random.default_rng(5).normal(size=(30, 16)).round(3)
    asked[7] = 0
    docs = spark.createDataFrame([(f"d{i:03}", [float(x) for x in v]) for i, v in enumerate(found)] + [("zero", [0.0] * 16), ("other", [1.0]), ("none", None)], "doc_id string, embedding array<float>")
    queries = frame(spark, asked).unionByName(frame(spark, np.ones((1, 1)), 30)).withColumnRenamed("doc_id", "query_id")
    visits, made = [], vectors._visits
    monkeypatch.setattr(vectors, "_visits", lambda *a, **b: visits.append(made(*a, **b)) or visits[-1])
    got = {}
    for r in vectors.knn_join(queries, docs, 4, cells=12, block=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {i: [f"d{j:03}" for j in top(found, q, 4)] for i, q in enumerate(asked)} | {30: ["other", "d000", "d001", "d002"]}
    assert sum(v.count() for v in visits) < 3 * (len(asked) + 1)
