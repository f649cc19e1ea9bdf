"""Pareto layers by pivot lattice trees, and the layers of a shop's offers.

A tree splits its points by bitmask against a balanced pivot: bit i says that measure i is no better than the pivot's. A point
with a measure better than the pivot's can't be dominated by one that is no better there, so whole branches are skipped. One
such tree is kept for each layer, and a point's layer follows from the highest layer in which a tree finds a dominator.

Sets that don't fit into one task are dealt twice. First points are dealt by hash: a point behind ``most`` layers of its share
is behind as many of the whole set, and so are the points that it dominates, so it goes. Then what is left of a set is split by
bitmasks against its medians into cells of at most ``CELL`` points, by the same lattice, and the cells are settled in waves: a
cell's dominators lie in cells whose masks are subsets of its own, which belong to earlier waves. A task holds two cells at
most, whatever the size of the set.

Defined cases: a null measure is better than any number and equal to null; equal points don't dominate each other and share
a layer; a null group is a group; points behind ``most`` layers have layer 0; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import stored

#: Points of a leaf; points of a share dealt by hash; points of a cell.
LEAF, SHARE, CELL = 192, 8192, 4096
#: Code of a null measure, better than all numbers.
BEST = -(1 << 62)


# ---- one task


def split(points: np.ndarray) -> np.ndarray:
    """A balanced pivot: the medians, but above the least of each measure, so that some points go either way."""
    low = points.min(axis=0)
    return np.maximum(np.partition(points, len(points) // 2, axis=0)[len(points) // 2], low + 1)


def masks_of(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return ((points >= pivot) << np.arange(points.shape[1])).sum(axis=1)


class PivotTree:
    """Finds whether any of its points dominates a point; smaller is better, and points are distinct."""

    def __init__(self, points: np.ndarray):
        self.points, self.pivot = points, None
        self.low, self.high, self.several = points.min(axis=0), points.max(axis=0), len(points) > 1
        if len(points) > LEAF:
            self.pivot = split(points)
            masks = masks_of(points, self.pivot)
            self.points, self.children = None, [(m, PivotTree(points[masks == m])) for m in np.unique(masks)]

    def dominated(self, asked: np.ndarray) -> np.ndarray:
        # who is worse than the worst corner is dominated; only who is no better than the best corner can be
        out = (asked >= self.high).all(axis=1) & self.several
        at = np.flatnonzero(~out & (asked >= self.low).all(axis=1))
        if not len(at):
            return out
        rest = asked[at]
        if self.pivot is None:
            out[at] = dominance(self.points, rest).any(axis=0)
            return out
        masks, found = masks_of(rest, self.pivot), np.zeros(len(rest), dtype=bool)
        for mask, child in self.children:
            some = np.flatnonzero(~found & ((masks & mask) == mask))
            if len(some):
                found[some] = child.dominated(rest[some])
        out[at] = found
        return out


def dominance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[i, j]: whether a[i] dominates b[j]."""
    no_worse = np.ones((len(a), len(b)), dtype=bool)
    better = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(a.shape[1]):
        x, y = a[:, k][:, None], b[:, k][None, :]
        no_worse &= x <= y
        better |= x < y
    return no_worse & better


class LayerTrees:
    """A tree for each layer of a set of points (or of a part of it) whose layers are known."""

    def __init__(self, points: np.ndarray, layers: np.ndarray, most: int):
        held = [k for k in range(most, 0, -1) if (layers == k).any()]
        self.trees = [(k, PivotTree(points[layers == k])) for k in held]

    def deepest(self, asked: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For each point the highest layer that has a dominator of it, or ``base`` if that is higher.

        A part of a set may hold a dominator in a layer and none in those before it, so layers are asked from the highest on.
        """
        out = base.copy()
        for k, tree in self.trees:
            open_ = np.flatnonzero(out < k)
            if not len(open_):
                continue
            out[open_[tree.dominated(asked[open_])]] = k
        return out


def layers_within(points: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
    """Layers of distinct points, given the highest layer ``base`` of each one's dominators elsewhere; most + 1 for beyond."""
    out = np.full(len(points), most + 1, dtype=np.int64)
    at = np.flatnonzero(base < most)
    points, base = points[at], base[at].astype(np.int64)
    if not len(points):
        return out
    if len(points) <= LEAF:
        above = dominance(points, points)
        found = base + 1
        while True:
            pushed = np.maximum(found, np.where(above, found[:, None], 0).max(axis=0) + 1)
            if (pushed == found).all():
                break
            found = pushed
        out[at] = np.minimum(found, most + 1)
        return out
    masks = masks_of(points, split(points))
    done: list[tuple[int, LayerTrees]] = []
    for mask in sorted(np.unique(masks), key=lambda m: (int(m).bit_count(), m)):
        some = np.flatnonzero(masks == mask)
        under = base[some]
        for other, trees in done:
            if other & mask == other:
                under = trees.deepest(points[some], under)
        layers = layers_within(points[some], under, most)
        done.append((mask, LayerTrees(points[some], layers, most)))
        out[at[some]] = layers
    return out


# ---- many tasks


def _vectors(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    return rows[names].to_numpy(dtype=np.int64)


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: columns that came in several Arrow chunks can't go back as they are."""
    return pd.DataFrame({c: pd.Series(rows[c].tolist(), dtype=object) if c in ("group_", "cell_") else rows[c].to_numpy() for c in rows.columns})


def _front(points: DataFrame, names: list[str], most: int, share: int) -> DataFrame:
    """Points that are within ``most`` layers of their share, dealt again until the shares no longer shrink."""
    held = points

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        found = layers_within(_vectors(rows, names), np.zeros(len(rows), dtype=np.int64), most)
        return _plain(rows.loc[found <= most, ["group_", *names]])

    before = None
    while True:
        sizes = held.groupBy("group_").agg(F.count(F.lit(1)).alias("size_"))
        total, largest = sizes.agg(F.sum("size_"), F.max("size_")).first()
        if before is not None and (total > 0.7 * before or largest <= share) or not total:
            return held
        before = total
        mine = sizes.withColumnRenamed("group_", "mine_")
        dealt = held.join(mine, F.col("group_").eqNullSafe(F.col("mine_"))).drop("mine_")
        n = F.ceil(F.col("size_") / F.lit(share))
        dealt = dealt.withColumn("share_", F.pmod(F.xxhash64(*names), n)).drop("size_")
        held = stored(dealt.groupBy("group_", "share_").applyInPandas(keep, held.select("group_", *names).schema), "front")


def _cells(points: DataFrame, names: list[str], cell: int) -> DataFrame:
    """Adds ``cell_``, the masks on the way down the lattice, two hex digits each, until no cell has more than ``cell`` points,
    and ``wave_``, their numbers of bits: cells of one wave can't hold dominators of each other's points."""
    held, done = points.withColumns({"cell_": F.lit(""), "wave_": F.lit("")}), None
    mask = sum((F.when(F.col(n) >= F.col(f"pivot_{i}"), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    while True:
        pivots = [F.greatest(F.percentile_approx(n, 0.5, 1000), F.min(n) + 1).alias(f"pivot_{i}") for i, n in enumerate(names)]
        large = stored(held.groupBy("group_", "cell_").agg(F.count(F.lit(1)).alias("size_"), *pivots).where(F.col("size_") > cell), "pivots")
        more = not large.isEmpty()
        mine = large.withColumnsRenamed({"group_": "g_", "cell_": "c_"})
        joined = held.join(mine, F.col("group_").eqNullSafe(F.col("g_")) & (F.col("cell_") == F.col("c_")), "left") if more else held
        rest = joined.where("c_ is null").select(held.columns) if more else held
        done = rest if done is None else done.unionByName(rest)
        if not more:
            return stored(done, "cells")
        steps = {"cell_": F.concat("cell_", F.lpad(F.hex(mask), 2, F.lit("0"))), "wave_": F.concat("wave_", F.lpad(F.bit_count(mask).cast("string"), 2, F.lit("0")))}
        held = stored(joined.where("c_ is not null").withColumns(steps).select(held.columns), "split")


def pareto_layers(points: DataFrame, better: dict[str, str], group: str | None = None, most: int = 12, share: int = SHARE, cell: int = CELL) -> DataFrame:
    """(group_, code_0.., layer_): the distinct points of each group within the first ``most`` layers; the others aren't listed.

    ``better`` says of each measure whether less or more is better ("min" or "max"). Points come coded as by ``coded``.
    """
    names = [f"code_{i}" for i in range(len(better))]
    distinct = points.select((F.col(group) if group else F.lit(None).cast("string")).alias("group_"), *[c.alias(n) for n, c in zip(names, coded(better), strict=True)])
    front = _front(stored(distinct.distinct(), "points"), names, most, share)
    celled = _cells(front, names, cell)
    waves = [r["wave_"] for r in celled.select("wave_").distinct().collect()]  # at most 5 ** depth of the lattice
    width = max(map(len, waves), default=0)
    schema = celled.select("group_", "cell_", *names).schema.add("layer_", "long")
    boxes = stored(celled.groupBy("group_", "cell_", "wave_").agg(*[F.min(n).alias(f"low_{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"high_{i}") for i, n in enumerate(names)]), "boxes")
    settled: DataFrame | None = None
    for wave in sorted(waves, key=lambda w: w.ljust(width, "0")):
        own = celled.where(F.col("wave_") == wave).select("group_", "cell_", *names)
        based = own.withColumn("base_", F.lit(0).cast("long"))
        if settled is not None:
            earlier = F.rpad("wave_", max(width, 1), F.lit("0")) < F.lit(wave.ljust(max(width, 1), "0"))
            based = _based(own, settled, boxes.where(earlier), boxes.where(F.col("wave_") == wave), names, most)

        def inside(rows: pd.DataFrame) -> pd.DataFrame:
            found = layers_within(_vectors(rows, names), rows["base_"].to_numpy(), most)
            return _plain(rows.assign(layer_=found).loc[found <= most, ["group_", "cell_", *names, "layer_"]])

        new = stored(based.groupBy("group_", "cell_").applyInPandas(inside, schema), "layers")
        settled = new if settled is None else settled.unionByName(new)
    return (settled if settled is not None else points.sparkSession.createDataFrame([], schema)).drop("cell_")


def _based(own: DataFrame, settled: DataFrame, earlier: DataFrame, mine: DataFrame, names: list[str], most: int) -> DataFrame:
    """``own`` with ``base_``: the highest layer of a dominator in earlier cells. Only cells meet whose boxes let one dominate,
    which implies that one's masks are subsets of the other's."""
    a, b = earlier.alias("a"), mine.alias("b")
    met = a.join(b, F.col("a.group_").eqNullSafe(F.col("b.group_")))
    for i in range(len(names)):
        met = met.where(F.col(f"a.low_{i}") <= F.col(f"b.high_{i}"))
    pairs = met.select(F.col("b.group_").alias("g_"), F.col("a.cell_").alias("from_"), F.col("b.cell_").alias("to_"))
    pairs = stored(pairs, "pairs")
    on = lambda end: F.col("group_").eqNullSafe(F.col("g_")) & (F.col("cell_") == F.col(end))
    ends = lambda *more: [F.col(c).alias(c) for c in ("group_", "from_", "to_", *names, *more)]
    above, below = settled.join(pairs, on("from_")).select(ends("layer_")), own.join(pairs, on("to_")).select(ends())

    def meet(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return _plain(others.assign(base_=np.zeros(len(others), dtype=np.int64)).iloc[:0][["group_", *names, "base_"]])
        trees = LayerTrees(_vectors(some, names), some["layer_"].to_numpy(), most)
        found = trees.deepest(_vectors(others, names), np.zeros(len(others), dtype=np.int64))
        return _plain(others.assign(base_=found).loc[found > 0, ["group_", *names, "base_"]])

    keys = ["group_", "from_", "to_"]
    made = above.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInPandas(meet, own.select("group_", *names).schema.add("base_", "long"))
    under = made.groupBy(*[F.col(n).alias(f"u_{n}") for n in ("group_", *names)]).agg(F.max("base_").alias("base_"))
    same = F.col("group_").eqNullSafe(F.col("u_group_"))
    for n in names:
        same &= F.col(n) == F.col(f"u_{n}")
    return own.join(under, same, "left").select("group_", "cell_", *names, F.coalesce("base_", F.lit(0)).cast("long").alias("base_"))


def coded(better: dict[str, str]) -> Iterator[Column]:
    """Measures as numbers of which less is better; null is the best of all."""
    for name, kind in better.items():
        yield F.coalesce(F.col(name).cast("long") * F.lit(1 if kind == "min" else -1), F.lit(BEST))


# ---- offers

MEASURES = {"price": "min", "discount": "max", "delay": "min", "quantity": "max"}


def _floor_ratio(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, exactly; null for b = 0."""
    a, b = F.when(b < 0, -a).otherwise(a), F.nullif(F.abs(b), F.lit(0))
    return F.call_function("div", a - F.pmod(a, b), b)


def hundredths(value: Column) -> Column:
    return F.floor(100 * value + 0.5).cast("long")


def offers(sale_lines: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, vendor_id, part_type, price, discount, delay, quantity): one row for each pair of an item and a vendor.

    Repeated lines all count. Of repeated sales or items the least row (date; brand, price) counts.
    """
    dates = stored(sales.where("sale_id is not null").groupBy(F.col("sale_id").alias("sale_")).agg(F.min(F.to_date("sold_at")).alias("sold_")), "dates")
    prices = items.where("item_id is not null").groupBy(F.col("item_id").alias("item_")).agg(F.min(F.struct("brand", "price")).alias("i_"))
    prices = stored(prices.select("item_", F.col("i_.brand").alias("part_type"), hundredths(F.col("i_.price")).alias("p_")), "prices")
    lines = sale_lines.where("item_id is not null and vendor_id is not null")
    lines = lines.select("sale_id", "item_id", "vendor_id", F.col("quantity").cast("long").alias("q_"), hundredths(F.col("amount")).alias("c_"), hundredths(F.col("discount")).alias("d_"), F.to_date("shipped_at").alias("shipped_"))
    dated = lines.join(dates, F.col("sale_id") == F.col("sale_"), "left")
    whole = F.col("c_").isNotNull() & F.col("d_").isNotNull() & F.col("q_").isNotNull()
    days = F.datediff("shipped_", "sold_").cast("long")
    summed = dated.groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(whole, F.col("c_") * (100 - F.col("d_")))).alias("paid_"),
        F.sum(F.when(whole, F.col("q_"))).alias("pieces_"),
        F.sum("d_").alias("d_sum_"),
        F.count("d_").alias("d_n_"),
        F.sum(days).alias("days_"),
        F.count(days).alias("days_n_"),
        F.max("q_").alias("quantity"),
    )
    priced = stored(summed, "sums").join(prices, F.col("item_id") == F.col("item_"), "left")
    price = F.when(F.col("p_") >= 1, _floor_ratio(F.col("paid_"), F.col("p_") * F.col("pieces_")))
    discount, delay = _floor_ratio(F.col("d_sum_"), F.col("d_n_")), _floor_ratio(F.col("days_"), F.col("days_n_"))
    return priced.select("item_id", "vendor_id", "part_type", price.alias("price"), discount.alias("discount"), delay.alias("delay"), "quantity")


def layered_offers(made: DataFrame, most: int = 12, share: int = SHARE, cell: int = CELL) -> DataFrame:
    """``made`` (of ``offers``) with type_layer, global_layer and n_equal."""
    names = [f"code_{i}" for i in range(len(MEASURES))]
    made = stored(made.select("*", *[c.alias(n) for n, c in zip(names, coded(MEASURES), strict=True)]), "offers")
    by_type = stored(made.groupBy("part_type", *names).agg(F.count(F.lit(1)).alias("n_")), "kinds")
    everywhere = by_type.groupBy(*names).agg(F.sum("n_").alias("n_equal"))
    measures = {n: "min" for n in names}
    own = pareto_layers(by_type, measures, "part_type", most, share, cell)
    every = pareto_layers(by_type, measures, None, most, share, cell)
    everywhere = everywhere.join(every.select(*names, F.col("layer_").alias("global_layer")), names, "left")
    own = own.select(F.col("group_").alias("type_"), *[F.col(n).alias(f"own_{n}") for n in names], F.col("layer_").alias("type_layer"))
    same = F.col("part_type").eqNullSafe(F.col("type_"))
    for n in names:
        same &= F.col(n) == F.col(f"own_{n}")
    told = by_type.join(own, same, "left").join(everywhere, names).select(F.col("part_type").alias("type_"), *[F.col(n).alias(f"own_{n}") for n in names], "type_layer", "global_layer", "n_equal")
    same = F.col("part_type").eqNullSafe(F.col("type_"))
    for n in names:
        same &= F.col(n) == F.col(f"own_{n}")
    layer = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return made.join(told, same).select("item_id", "vendor_id", "part_type", *MEASURES, layer("type_layer"), layer("global_layer"), F.col("n_equal").cast("long"))
