"""Operator 11 against plain Python: trees, layers over many cells, and whole offers from lines."""

import collections
import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import pareto_layers
from tidewell.llm.pareto_layers import MEASURES, LayerTrees, PivotTree, layered_offers, layers_within, offers


def dominates(a, b):
    return all(x <= y for x, y in zip(a, b)) and a != b


def brute_layers(points):
    """Layers of a list of tuples, peeled one after the other."""
    rest, out, k = set(points), {}, 0
    while rest:
        k += 1
        first = {p for p in rest if not any(dominates(q, p) for q in rest)}
        out |= dict.fromkeys(first, k)
        rest -= first
    return out


@pytest.mark.parametrize("n,dims,high", [(1, 2, 3), (60, 2, 6), (900, 4, 7), (900, 3, 12), (700, 1, 10**6)])
def test_trees_and_layers(n, dims, high, monkeypatch):
    monkeypatch.setattr(pareto_layers, "LEAF", 16)
    rng = np.random.default_rng(n)
    points = rng.permutation(np.unique(rng.integers(0, high, (n, dims)), axis=0))
    truth = brute_layers([tuple(p) for p in points.tolist()])
    layers = layers_within(points, np.zeros(len(points), dtype=int), 5)
    assert layers.tolist() == [min(truth[tuple(p)], 6) for p in points.tolist()]
    asked = rng.integers(0, high, (300, dims))
    tree = PivotTree(points)
    assert tree.dominated(asked).tolist() == [any(dominates(tuple(p), tuple(q)) for p in points.tolist()) for q in asked.tolist()]
    deepest = LayerTrees(points, layers, 5).deepest(asked, np.zeros(300, dtype=int))
    kept = [tuple(p) for p, k in zip(points.tolist(), layers) if k <= 5]
    assert deepest.tolist() == [max([truth[p] for p in kept if dominates(p, tuple(q))], default=0) for q in asked.tolist()]


def test_incomparable_branches_are_skipped(monkeypatch):
    monkeypatch.setattr(pareto_layers, "LEAF", 8)
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 1000, (4000, 4)), axis=0)
    compared = 0
    real = pareto_layers.dominance

    def counted(a, b):
        nonlocal compared
        compared += len(a) * len(b)
        return real(a, b)

    monkeypatch.setattr(pareto_layers, "dominance", counted)
    PivotTree(points).dominated(points)
    assert compared < 0.05 * len(points) ** 2


@pytest.mark.parametrize("share,cell", [(8192, 4096), (400, 150)])
def test_layers_over_many_cells(spark, share, cell):
    rng = np.random.default_rng(5)
    rows = [(g, int(a), int(b), int(c)) for g, n in (("x", 900), ("y", 30), (None, 200)) for a, b, c in rng.integers(0, 40, (n, 3))]
    rows += rows[:50] + [("x", None, 3, 4), ("x", None, 3, None), ("only", 1, 1, 1)]
    points = spark.createDataFrame(rows, "kind string, a long, b long, c long")
    for group in ("kind", None):
        found = {(r["group_"], r["code_0"], r["code_1"], r["code_2"]): r["layer_"] for r in pareto_layers.pareto_layers(points, {"a": "min", "b": "max", "c": "min"}, group, 4, share, cell).collect()}
        code = lambda v, s: pareto_layers.BEST if v is None else s * v
        sets = collections.defaultdict(set)
        for g, a, b, c in rows:
            sets[g if group else None].add((code(a, 1), code(b, -1), code(c, 1)))
        truth = {(g, *p): k for g, held in sets.items() for p, k in brute_layers(list(held)).items() if k <= 4}
        assert found == truth


def half_up(x):
    return math.floor(100 * x + 0.5)


def brute_offers(lines, sales, items):
    sold = {i: d for i, d in sales}
    price = {i: (b, p) for i, b, p in items}
    groups = collections.defaultdict(list)
    for sale, item, vendor, q, amount, discount, shipped in lines:
        if item is not None and vendor is not None:
            groups[item, vendor].append((sale, q, amount, discount, shipped))
    out = []
    for (item, vendor), held in groups.items():
        brand, p = price.get(item, (None, None))
        p = None if p is None else half_up(p)
        whole = [(q, half_up(a), half_up(d)) for _, q, a, d, _ in held if None not in (q, a, d)]
        pieces = sum(q for q, _, _ in whole)
        paid = sum(c * (100 - d) for _, c, d in whole) // (p * pieces) if whole and p is not None and p >= 1 and pieces else None
        cuts = [half_up(d) for _, _, _, d, _ in held if d is not None]
        days = [(s.date() - sold[i].date()).days for i, _, _, _, s in held if s is not None and sold.get(i) is not None]
        most = max([q for _, q, _, _, _ in held if q is not None], default=None)
        out.append([item, vendor, brand, paid, sum(cuts) // len(cuts) if cuts else None, sum(days) // len(days) if days else None, most])
    code = lambda r: tuple(pareto_layers.BEST if v is None else (v if kind == "min" else -v) for v, kind in zip(r[3:7], MEASURES.values()))
    every = brute_layers([code(r) for r in out])
    own = {b: brute_layers([code(r) for r in out if r[2] == b]) for b in {r[2] for r in out}}
    equal = collections.Counter(code(r) for r in out)
    within = lambda k: k if k <= 12 else 0
    return [(*r, within(own[r[2]][code(r)]), within(every[code(r)]), equal[code(r)]) for r in out]


def shop(seed, n):
    rng = np.random.default_rng(seed)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(k))
    some = lambda v, p=0.05: None if rng.random() < p else v
    lines = [(some(int(rng.integers(0, 40))), some(int(rng.integers(0, 25))), some(int(rng.integers(0, 9))), some(int(rng.integers(1, 9))), some(round(float(rng.uniform(1, 90)), 2)), some(int(rng.integers(0, 11)) / 100), some(day(rng.integers(0, 3000)))) for _ in range(n)]
    lines += lines[:20]
    sales = [(i, some(day(rng.integers(0, 2500)))) for i in range(38)]
    items = [(i, some(f"B{i % 3}"), some([0.001, 0.0, 5.25][i % 3] if i % 5 == 0 else float(i + 1))) for i in range(23)]
    return lines, sales, items


def frames(spark, lines, sales, items):
    a = spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp_ntz")
    b = spark.createDataFrame(sales, "sale_id long, sold_at timestamp_ntz")
    c = spark.createDataFrame(items, "item_id long, brand string, price double")
    return a, b, c


def told(made):
    key = lambda r: [(v is None, v) for v in r]
    return sorted(map(tuple, made), key=key)


@pytest.mark.parametrize("n,share,cell", [(700, 100, 60), (0, 8192, 4096)])
def test_offers_against_brute_force(spark, n, share, cell):
    lines, sales, items = shop(n, n)
    clash = [F.lit("x").alias(c) for c in ("group_", "layer_", "code_0", "n_", "cell_", "sold_")]
    a, b, c = [f.select("*", *clash) for f in frames(spark, lines, sales, items)]
    found = layered_offers(offers(a, b, c), share=share, cell=cell).collect()
    rows = [r.asDict() for r in found]
    assert all(set(r) == {"item_id", "vendor_id", "part_type", *MEASURES, "type_layer", "global_layer", "n_equal"} for r in rows)
    assert told(tuple(r.values()) for r in rows) == told(brute_offers(lines, sales, items))
