"""Queries and operators do the whole job: each is compared with a search by brute force, or on rows that a cut would lose."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidewell.config import SearchOptions
from tidewell.engine import Engine
from tidewell.functions.embed import hashing_embedder
from tidewell.operators import graph, retrieval
from tidewell.plans import registry

NOW = registry.AS_OF
EDGE = "id string, source_id string, target_id string, type string, weight double, confidence double, valid_to timestamp"
NODE = "id string, type string, title string, content string"


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"e{i:04}", a, b, "references", 0.5, 1.0, None) for i, (a, b) in enumerate(pairs)], EDGE)


@pytest.fixture
def views(spark, monkeypatch):
    """Sets the views that registered queries see."""

    def use(**frames):
        class Fixed:
            def __init__(self, session, sf_dir):
                self.spark = session

            def __call__(self, name):
                return frames[name]

        monkeypatch.setattr(registry, "Views", Fixed)

    return use


def breadth_first(pairs, start):
    """(parents, depths) of a search that takes neighbours in order."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    parent, depth, queue = {start: None}, {start: 0}, [start]
    for node in queue:
        for other in sorted(near.get(node, ())):
            if other not in parent:
                parent[other], depth[other] = node, depth[node] + 1
                queue.append(other)
    return parent, depth


@pytest.mark.parametrize("hops", [3, 6, 7])
def test_shortest_path_query_by_brute_force(spark, views, hops):
    chain = ["src0::0"] + [f"m{i}" for i in range(1, hops)] + ["zz"]
    pairs = [*zip(chain, chain[1:]), ("src0::0", "x1"), ("x1", "x2"), ("m1", "x2")]
    views(v_edges=edges_of(spark, pairs), v_nodes=spark.createDataFrame([(n, "note", n, None) for n in {x for p in pairs for x in p}], NODE))
    found = registry.queries()["shortest_path"](spark, "").collect()
    _, depth = breadth_first(pairs, "src0::0")
    assert [(r["distance"], r["path"]) for r in found] == ([(depth["zz"], ">".join(chain))] if depth["zz"] <= 6 else [])


def test_two_sided_search_by_brute_force(spark):
    dice = random.Random(8)
    pairs = [(f"n{dice.randrange(i):02}", f"n{i:02}") for i in range(1, 50)] + [(f"n{dice.randrange(50):02}", f"n{dice.randrange(50):02}") for _ in range(12)]
    edges, near = edges_of(spark, pairs), {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(a, b):
        paths = [[a]]
        while paths and not any(p[-1] == b for p in paths):
            paths = [[*p, n] for p in paths for n in near.get(p[-1], ()) if n not in p]
            paths = [p for p in paths if len(p) <= 7]
        return min((p for p in paths if p[-1] == b), default=None)

    for a, b in (("n49", "n31"), ("n00", "n44"), ("n12", "n12"), ("n03", "nowhere")):
        found = [(r["distance"], r["path"]) for r in graph.shortest_path(edges, a, b, NOW).collect()]
        path = least(a, b)
        assert found == ([(len(path) - 1, ">".join(path))] if path else [])
    # two long chains behind the start: a search from one side goes down both of them
    star = [(f"c{k}_{i}", f"c{k}_{i + 1}") for k in range(30) for i in range(4)] + [("hub", f"c{k}_0") for k in range(30)]
    told = {}
    assert graph.shortest_path(edges_of(spark, star), "hub", "c7_4", NOW, told=told).first()["distance"] == 5
    assert told["reached"] < 50


def search_tables(spark):
    docs = [("near", "orchid orchid greenhouse"), ("other", "plain words"), ("expanded", "an orchid on the shelf"), ("stemmed", "she was watering them"), ("none", "nothing to see")]
    rows = [(d, t, NOW, None, 0.5) for d, t in docs]
    return {
        "docs": spark.createDataFrame(rows, "doc_id string, content string, indexed_at timestamp, last_accessed timestamp, excitability double"),
        "vectors": spark.createDataFrame([("near", [1.0, 0.0]), ("other", [0.0, 1.0])], "doc_id string, embedding array<double>"),
        "tags": spark.createDataFrame([], "doc_id string, tag string"),
        "xrefs": spark.createDataFrame([], "doc_id string, ref_type string, ref_target string"),
        "nodes": spark.createDataFrame([], NODE),
        "edges": spark.createDataFrame([], EDGE),
    }


def test_search_by_stems_and_expansion(spark):
    tables = search_tables(spark)
    found = {r["doc_id"] for r in retrieval.hybrid_search("watered", [1.0, 0.0], as_of=NOW, **tables).collect()}
    assert {"near", "expanded", "stemmed"} <= found and "none" not in found
    # no hit is near enough to lend its terms
    far = {r["doc_id"] for r in retrieval.hybrid_search("watered", [-1.0, -1.0], as_of=NOW, **tables).collect()}
    assert "stemmed" in far and "expanded" not in far


def test_search_reranks_by_scorer(spark):
    tables = search_tables(spark)
    judge = lambda pairs: [10.0 if "watering" in text and query == "watered" else -len(text) / 10 for query, text in pairs]
    found = retrieval.hybrid_search("watered", [1.0, 0.0], as_of=NOW, scorer=judge, **tables).orderBy("position").collect()
    assert found[0]["doc_id"] == "stemmed" and [r["position"] for r in found] == list(range(len(found)))
    kept = retrieval.hybrid_search("watered", [1.0, 0.0], as_of=NOW, scorer=judge, options=SearchOptions(rerank=False), **tables).orderBy("position").collect()
    assert kept[0]["doc_id"] == "near"


def test_graph_search_two_hops_by_brute_force(spark):
    dice = random.Random(7)
    names = [f"n{i:02}" for i in range(30)]
    titles = {n: ("wanted " if i < 3 else "") + f"a rather long title of {n}" for i, n in enumerate(names)}
    kinds = list(graph.TYPE_WEIGHTS) + ["co_retrieved"]
    rows = []
    for i in range(60):
        a, b = dice.sample(names, 2)
        ended = NOW - timedelta(days=1) if i % 9 == 0 else None
        rows.append((f"e{i:02}", a, b, dice.choice(kinds), dice.randint(1, 100) / 100, 0.5 + (i % 5) / 10, ended))
    alive = [e for e in rows if e[6] is None]
    best = {n: 1.5 for n in names[:3]}
    for start in names[:3]:
        seen, ring = {start}, {start}
        for _ in range(2):
            ring = {y for e in alive for x, y in ((e[1], e[2]), (e[2], e[1])) if x in ring}
            seen |= ring
        met = sorted((-e[4], n, e[0], e) for e in alive for n in {e[1], e[2]} & (seen - {start}))
        for weight, node, _, e in met[:20]:
            lift = 1 + 0.8 * ("wanted" in titles[node])
            best[node] = max(best.get(node, 0), -weight * e[5] * graph.TYPE_WEIGHTS.get(e[3], graph.OTHER_TYPE) * lift)
    expected = sorted(((f"graph:{n}", round(x, 9)) for n, x in best.items()), key=lambda p: (-p[1], p[0]))[:20]
    found = graph.graph_search("wanted", spark.createDataFrame([(n, "note", t, None) for n, t in titles.items()], NODE), spark.createDataFrame(rows, EDGE), NOW)
    assert [(r["doc_id"], round(r["score"], 9)) for r in found.collect()] == expected


def test_graph_search_finds_nodes_two_hops_away(spark):
    nodes = spark.createDataFrame([(n, "note", t, None) for n, t in [("a", "wanted, a long enough title"), ("b", "between, a long enough title"), ("c", "behind, a long enough title"), ("d", "too far, a long enough title")]], NODE)
    found = graph.graph_search("wanted", nodes, edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")]), NOW)
    assert {r["doc_id"] for r in found.collect()} == {"graph:a", "graph:b", "graph:c"}


def test_centrality_query_searches_from_500_nodes(spark, views):
    dice = random.Random(3)
    pairs = [(f"n{dice.randrange(i):03}", f"n{i:03}") for i in range(1, 260)] + [(f"n{dice.randrange(260):03}", f"n{dice.randrange(260):03}") for _ in range(40)]
    views(v_edges=edges_of(spark, pairs))
    passes = Counter()
    for source in sorted({x for p in pairs for x in p}):
        parent, depth = breadth_first(pairs, source)
        for target in parent:
            inner = parent[target] if depth[target] >= 2 else None
            while inner is not None and inner != source:
                passes[inner] += 1
                inner = parent[inner]
    found = {r["id"]: r["passes"] for r in registry.queries()["centrality"](spark, "").collect()}
    assert len(found) == 260 and found == {n: passes[n] for n in found}


def test_temporal_edges_by_brute_force(spark):
    dice = random.Random(5)
    dates = {f"d{i}": datetime(2024, 1, 1) + timedelta(days=dice.randrange(20)) for i in range(40)}
    order = sorted(dates, key=lambda x: (dates[x], x))
    counts, kept = Counter(), []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (dates[b] - dates[a]).days <= 7 and counts[a] < 3 and counts[b] < 3:
                counts.update((a, b))
                kept.append((a, b))
    dated = spark.createDataFrame([(x, d.date()) for x, d in dates.items()], "id string, date date")
    pairs = lambda **o: {(r["source_id"], r["target_id"]) for r in graph.temporal_edges(dated, per_node=3, **o).collect()}
    assert pairs() == set(kept) and pairs(most=10) == set(kept[:10])


def test_built_graph_links_dates(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "s"), embedder=lambda: hashing_embedder(32))
    docs = [("a", "one thing", "log/2024-01-01.md", None), ("b", "another matter", "log/x.md", '{"date": "2024-01-05"}'), ("c", "much later", "log/2024-01-11.md", None), ("d", "too late", "log/2024-03-01.md", None)]
    made.index(spark.createDataFrame(docs, "doc_id string, content string, file_path string, metadata string"), NOW)
    made.build_graph(NOW)
    found = made.store.read("edges").where("type = 'temporal'").orderBy("source_id").collect()
    expected = [("a", "b", round(1 - 0.5 * 4 / 7, 6), 0.7), ("b", "c", round(1 - 0.5 * 6 / 7, 6), 0.7)]
    assert [(r["source_id"], r["target_id"], round(r["weight"], 6), r["confidence"]) for r in found] == expected


def test_text_queries_read_documents(spark, views):
    docs = [("x1", "p/en/x1", "---\ntags: [q]\n---\n# Head\nwords #fresh for [[Second Note]] and enough of them"), ("x2", "p/en/x2", "plain")]
    views(v_docs=spark.createDataFrame(docs, "doc_id string, file_path string, content string"))
    made = {name: registry.queries()[name](spark, "").collect() for name in ("doc_tags", "wiki_links", "explicit_edges", "chunk_markdown", "frontmatter")}
    assert ("x1", "fresh") in {(r["id"], r["tag"]) for r in made["doc_tags"]} and ("x1", "Second Note") in {(r["id"], r["link"]) for r in made["wiki_links"]}
    assert {("x1", "n2"), ("x1", "tag_fresh")} <= {(r["source_id"], r["target_id"]) for r in made["explicit_edges"]}
    assert "p/en/x1" in {r["path"] for r in made["frontmatter"]} and any("p/en/x1" in str(r) for r in made["chunk_markdown"])


def test_a_changed_note_gives_the_graph_of_a_full_build(spark, tmp_path):
    note = lambda i, words: (f"n{i}", f"{words} #tag{i % 3} see [[Note {i + 1}]] by Alice Smith and Python", f"log/2024-01-{i + 1:02d} Note {i}.md")
    first = [note(i, "garden water garden water spring") for i in range(6)]
    later = [note(2, "kitchen kitchen oven oven Bob Brown"), note(9, "oven oven kitchen kitchen Bob Brown")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, content string, file_path string")
    slow, fast = (Engine(spark, str(tmp_path / name), embedder=lambda: hashing_embedder(32)) for name in ("full", "step"))
    for made in (slow, fast):
        made.index(frame(first), NOW)
        begun = made.build_graph(NOW)
        assert begun["notes_read"] == 6 and not begun["skipped"] and begun["stages"]["parts"]["rows"] > 0
    assert fast.build_graph(NOW)["skipped"]
    for made in (slow, fast):
        made.index(frame(later), NOW)
        made.forget_documents(spark.createDataFrame([("n4",)], "doc_id string"))
    assert slow.build_graph(NOW, force=True)["notes_read"] == 6
    stepped = fast.build_graph(NOW)
    assert stepped["notes_read"] == 2 and set(stepped["stages"]) == {"parts", "explicit", "entities", "topics", "semantic", "temporal", "prune", "centrality"}
    shape = lambda made, table, *columns: sorted(tuple(str(x) for x in r) for r in made.store.read(table).select(*columns).collect())
    assert shape(slow, "edges", "id", "source_id", "target_id", "type", "weight") == shape(fast, "edges", "id", "source_id", "target_id", "type", "weight")
    assert shape(slow, "nodes", "id", "type", "title", "metadata") == shape(fast, "nodes", "id", "type", "title", "metadata")
    assert shape(slow, "note_parts", "doc_id", "kind", "value", "n") == shape(fast, "note_parts", "doc_id", "kind", "value", "n")
