"""Vectors in cells: an index that grows, nearest neighbours and similar pairs, each with a bound that proves results exact.

Cells are the neighbourhoods of centroids that k-means finds on a bounded sample; every vector belongs to the cell of its
nearest centroid. A cell's radius is the largest angle between its centroid and one of its vectors, so by the triangle
inequality no vector of a cell is nearer to a query than the query's angle to the centroid less the radius.

Centroids and radii (``MOST_CELLS`` rows at most) are all that goes through the driver or is broadcast.

Vectors that are null are in no cell. Vectors without a direction (zeros, other lengths than the index's) are in the cell
``NOWHERE``; their cosine with anything is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.functions.scalar import cosine
from tidewell.sources.scratch import settled

#: Vectors from which centroids are found; cells at most; vectors for each of which there is a cell; vectors of one side that
#: are compared at a time.
SAMPLE, MOST_CELLS, CELL_ROWS, BLOCK = 16_384, 4096, 1024, 2048
#: Tasks into which a search for nearest vectors is dealt, and bytes of directions that one of them holds; only where these bytes
#: don't suffice there are more tasks.
TASKS, HELD_BYTES = 48, 1 << 26
NOWHERE = -1
#: Angles are taken to be off by as much as this at most.
SLACK = 1e-7


class Cells(NamedTuple):
    """Unit centroids by row, and by cell the radius and the number of vectors."""

    centroids: np.ndarray
    radius: dict[int, float]
    size: dict[int, int]

    def ids(self) -> np.ndarray:
        return np.array(sorted(self.radius), dtype=np.int64)

    def bounds(self, directions: np.ndarray, spread: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(angles, bounds) by direction (a unit vector) and cell, in order of ``ids``: the angle to the centroid, and the largest
        cosine that a vector of the cell may have with one within ``spread`` of the direction. Directions of another length than
        the centroids' have cosine 0 with all."""
        ids = self.ids()
        radius = np.array([self.radius[c] for c in ids])
        if directions.shape[1] != (self.centroids.shape[1] if self.centroids.size else 0):
            return np.full((len(directions), len(ids)), math.pi / 2), np.ones((len(directions), len(ids)))
        angles = np.arccos(np.clip(directions @ self.centroids[np.maximum(ids, 0)].T, -1, 1))
        angles[:, ids == NOWHERE] = math.pi / 2
        return angles, np.where(ids == NOWHERE, 0.0, np.cos(np.maximum(0.0, angles - radius - spread - SLACK)))

    def nearest(self, angles: np.ndarray, k: int, probe: int | None = None) -> np.ndarray:
        """By direction and cell: whether it is among the nearest cells that hold ``k`` vectors, or among the ``probe`` nearest."""
        ids = self.ids()
        order = np.argsort(angles, axis=1, kind="stable")
        sizes = np.array([self.size[c] for c in ids])[order]
        near = np.arange(len(ids))[None, :] < probe if probe else np.cumsum(sizes, axis=1) - sizes < k
        out = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(out, order, np.broadcast_to(near, angles.shape), axis=1)
        return out


def units(rows: pd.Series) -> np.ndarray:
    found = np.stack(rows.to_numpy()).astype(np.float64)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def fit_centroids(vectors: DataFrame, key: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids, one for CELL_ROWS vectors (or ``cells``), from the ``sample`` vectors of least key hashes."""
    held = vectors.where(F.col(vector).isNotNull())
    n = held.count()
    cells = max(1, min(MOST_CELLS, cells or -(-n // CELL_ROWS)))
    width = held.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None or not width["width"]:
        return np.zeros((0, 0))
    some = held.where((F.size(vector) == width["width"]) & F.exists(vector, lambda x: x != 0)).orderBy(F.xxhash64(key), key).limit(sample)
    first = some.first()
    if first is None:
        return np.zeros((0, width["width"]))
    found = np.array([first[vector]], dtype=np.float64)
    if cells > 1:
        features = settled(some.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
        found = np.array(KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(features).clusterCenters(), dtype=np.float64)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def with_cell(df: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``df`` without null vectors, with ``cell`` and ``angle`` to its centroid."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle = shared.value
        for batch in batches:
            cell, angle = np.full(len(batch), NOWHERE), np.zeros(len(batch))
            rows = batch[vector].to_numpy()
            fit = np.flatnonzero([len(middle) > 0 and len(v) == middle.shape[1] and np.any(v) for v in rows])
            if len(fit):
                near = units(batch[vector].iloc[fit]) @ middle.T
                cell[fit] = near.argmax(axis=1)
                angle[fit] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield batch.assign(cell=cell.astype(np.int32), angle=angle)

    return df.where(F.col(vector).isNotNull()).mapInPandas(assign, schema)


def cells_of(celled: DataFrame, centroids: np.ndarray) -> Cells:
    found = celled.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    return Cells(centroids, {r["cell"]: r["radius"] for r in found}, {r["cell"]: r["n"] for r in found})


# ---- rows that meet in cells


def _met(probes: DataFrame, members: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """``meet(probes, members)`` for both sides' rows of each cell, dealt into blocks, so that a task holds two blocks at most.

    Block counts are known for each cell, a table of MOST_CELLS + 1 rows at most.
    """
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    both = F.broadcast(settled(count(probes, "p_").join(count(members, "m_"), "cell")))
    deal = lambda df, own, n, other, m: df.join(both, "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("p_", "m_")
    a, b = deal(probes, "a_", "p_", "b_", "m_"), deal(members, "b_", "m_", "a_", "p_")
    keys = lambda df: df.select([F.col(c).alias(c) for c in df.columns]).groupBy("cell", "a_", "b_")
    return keys(a).cogroup(keys(b)).applyInPandas(meet, schema)


def _visits(df: DataFrame, cells: Cells, choose: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], extra: Sequence[str] = ()) -> DataFrame:
    """(cell, id, v, extra): each row of ``df`` (id, v, extra) once for each cell that ``choose(angles, bounds, rows)`` marks."""
    shared = df.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *[df.schema[c] for c in ("id", "v", *extra)]])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        ids, width = held.ids(), held.centroids.shape[1] if held.centroids.size else 0
        for batch in batches:
            for fits in (True, False):
                rows = batch[[(len(v) == width) == fits for v in batch["v"]]]
                for start in range(0, len(rows), 1024):
                    part = rows.iloc[start : start + 1024]
                    chosen = choose(*held.bounds(units(part["v"]) if fits else np.zeros((len(part), 0 if width else 1))), part)
                    row, cell = np.nonzero(chosen)
                    out = part.iloc[row].reset_index(drop=True)
                    out.insert(0, "cell", ids[cell].astype(np.int32))
                    yield out[schema.names]

    return df.select("id", "v", *extra).mapInPandas(visit, schema)


# ---- the nearest of each vector


class _Lists:
    """The ``k`` nearest of some vectors (``ids``, ``x``; all of one length) among those offered so far, ties by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.x, self.floor, self.k = ids, x, floor.copy(), k
        self.short = x.astype(np.float32)
        # twice what sums of so many products of unit vectors lose in single precision
        self.lost = 2 * (x.shape[1] + 4) * 2.0**-24
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, near: np.ndarray, y: np.ndarray, short: np.ndarray) -> None:
        """Vectors of the same length. Single precision tells which may be among the nearest, double precision which are."""
        scores = self.short @ short.T
        may = scores >= (self.floor - self.lost).astype(np.float32)[:, None] - np.float32(1e-7)
        if self.k < len(near) and np.count_nonzero(may) > 4 * self.k * len(self.ids):
            may &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k][:, None] - np.float32(2 * self.lost)
        rows, cols = np.divmod(np.flatnonzero(may), len(near))  # much faster than np.nonzero of two axes
        step = max(1, (1 << 22) // max(1, y.shape[1]))
        for start in range(0, len(rows), step):
            i, j = rows[start : start + step], cols[start : start + step]
            self._take(i, np.minimum(1.0, np.einsum("ij,ij->i", self.x[i], y[j])), near[j])

    def offer_across(self, near: np.ndarray) -> None:
        """Vectors whose cosine with all of these is 0."""
        if len(near) and (self.floor <= 0).any():
            first = np.sort(near)[: self.k]
            i, j = np.indices((len(self.ids), len(first))).reshape(2, -1)
            self._take(i, np.zeros(len(i)), first[j])

    def _take(self, rows: np.ndarray, weights: np.ndarray, near: np.ndarray) -> None:
        keep = weights >= self.floor[rows]
        self.found.append((rows[keep], weights[keep], near[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > self.k * len(self.ids):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.found:
            return None
        rows, weights, near = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((near, -weights, rows))
        rows, weights, near = rows[order], weights[order], near[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], weights[last])
        keep = place < self.k
        self.found, self.waiting = [(rows[keep], weights[keep], near[keep])], 0
        return self.found[0]


def _directions(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by length; vectors without a direction stay zeros."""
    width = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(width) - width
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        found = flat[start[rows][:, None] + np.arange(w)]
        yield rows, found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _panels(size: dict[int, int], most: int) -> tuple[dict[int, list[int]], int]:
    """(panels by cell, number of panels): cells in order fill panels of about ``most`` rows; larger cells have several."""
    out: dict[int, list[int]] = {}
    panel, filled = 0, 0.0
    for cell in sorted(size):
        pieces = -(-size[cell] // most)
        for _ in range(pieces):
            if filled and filled + size[cell] / pieces > most:
                panel, filled = panel + 1, 0.0
            filled += size[cell] / pieces
            out.setdefault(cell, []).append(panel)
    return out, panel + 1


def _nearest(probes: DataFrame, members: DataFrame, centroids: np.ndarray, k: int, block: int = BLOCK) -> DataFrame:
    """(asked, near, weight): for each of ``probes`` (cell, angle, id, v, floor) the ``k`` nearest of ``members`` (cell, angle, id, v)
    of cosine ``floor`` or more, ties by id.

    Cells of probes make panels; a task holds a panel, and one share of the members streams past it, those of cells that may
    hold a vector near enough to one of the panel's cells. Only the nearest leave the task. There are TASKS tasks unless
    HELD_BYTES makes more, so what is shuffled grows with the vectors and not with the pairs that are compared.
    """
    spark, width = probes.sparkSession, centroids.shape[1] if centroids.size else 0
    summed = probes.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"), F.min("floor").alias("floor")).collect()
    asked = Cells(centroids, {r["cell"]: r["radius"] for r in summed}, {r["cell"]: r["n"] for r in summed})
    held = cells_of(members, centroids)
    n, m = sum(asked.size.values()), sum(held.size.values())
    # a share costs a probe its vector and k rows, a panel costs a member its vector
    panels = min(TASKS, math.ceil(math.sqrt(TASKS * n * (1 + k / 12) / max(m, 1)))) or 1
    most = max(1, min(max(block, -(-n // panels)), HELD_BYTES // (8 * max(width, 1))))
    of_cell, panels = _panels(asked.size, most)
    shares = max(1, min(-(-TASKS // panels), -(-m // block)))
    lowest = {r["cell"]: r["floor"] for r in summed}
    reached: dict[int, set[int]] = {c: set() for c in held.size}
    for h, own in of_cell.items():
        middle = asked.centroids[[h]] if h != NOWHERE else np.zeros((1, 0 if width else 1))
        _, bounds = held.bounds(middle, asked.radius[h])
        # what has no direction, or another length, has cosine 0 with all vectors that aren't alike in that
        bound = np.where(held.ids() == NOWHERE, 1.0, 0.0) if h == NOWHERE else bounds[0]
        for c in held.ids()[bound >= lowest[h] - 1e-9].tolist():
            reached[c].update(own)
    table = lambda rows: F.broadcast(spark.createDataFrame([(c, sorted(p)) for c, p in rows.items()], "cell int, panels array<int>"))
    kinds = [next(f for f in df.schema.fields if f.name == "id").dataType.simpleString() for df in (probes, members)]
    share = lambda c: (F.col("panel") * shares + c).alias("task")
    piece = F.pmod(F.xxhash64("id"), F.size("panels")).cast("int")
    a = probes.join(table(of_cell), "cell").select("*", F.get("panels", piece).alias("panel")).select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    a = a.select(share(F.col("share")), F.lit(0).alias("side"), "cell", "angle", F.col("id").alias("asked"), F.lit(None).cast(kinds[1]).alias("near"), "v", "floor")
    b = members.join(table(reached), "cell").select("*", F.explode("panels").alias("panel"))
    b = b.select(share(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shares)).cast("int")), F.lit(1).alias("side"), "cell", F.lit(0.0).alias("angle"), F.lit(None).cast(kinds[0]).alias("asked"), F.col("id").alias("near"), "v", F.lit(0.0).alias("floor"))
    met = a.unionByName(b).repartitionById(panels * shares, "task").sortWithinPartitions("side", "cell")
    shared = spark.sparkContext.broadcast(centroids)

    def lists(some: pa.Table) -> list[tuple[int, float, bool, _Lists]]:
        """(cell, radius, whether they have directions, lists) of the probes, ``block`` of a cell at a time."""
        cell, angle, floor = (some[c].to_numpy() for c in ("cell", "angle", "floor"))
        ids, out = some["asked"].to_numpy(), []
        for rows, x in _directions(some["v"].combine_chunks()):
            kind = np.where(x.any(axis=1), cell[rows], NOWHERE - 1) if x.shape[1] else np.full(len(rows), NOWHERE - 1)
            for c in np.unique(kind):
                of = np.flatnonzero(kind == c)
                for i in (of[start : start + block] for start in range(0, len(of), block)):
                    out.append((int(c), float(angle[rows[i]].max()), bool(c >= NOWHERE), _Lists(ids[rows[i]], x[i], floor[rows[i]], k)))
        return out

    def meet(held: list[tuple[int, float, bool, _Lists]], some: pa.RecordBatch) -> None:
        near = some.column("near").to_numpy(zero_copy_only=False)
        for rows, y in _directions(some.column("v")):
            short = y.astype(np.float32)
            own = sorted({c for c, _, _, _ in held if c >= 0}) if y.shape[1] == width else []
            angles = dict(zip(own, np.arccos(np.clip(shared.value[own] @ y.T, -1, 1)), strict=True)) if own else {}
            for c, radius, directed, found in held:
                if not directed or found.x.shape[1] != y.shape[1]:
                    found.offer_across(near[rows])
                    continue
                hit = np.flatnonzero(np.cos(np.maximum(0.0, angles[c] - radius - SLACK)) >= found.floor.min() - 1e-9) if c in angles else rows
                if len(hit) == len(rows):
                    found.offer(near[rows], y, short)
                elif len(hit):
                    found.offer(near[rows[hit]], y[hit], short[hit])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, kinds = [], None, None
        for batch in batches:
            n = int((batch.column("side").to_numpy() == 0).sum())
            if n:
                first.append(batch.slice(0, n))
            if n == batch.num_rows or not first:
                continue
            if held is None:
                held, kinds = lists(pa.Table.from_batches(first)), batch.schema
            for start in range(n, batch.num_rows, block):
                meet(held, batch.slice(start, block))
        for _, _, _, found in held or []:
            best = found.settle()
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ids[best[0]], kinds.field("asked").type), pa.array(best[2], kinds.field("near").type), pa.array(best[1], pa.float64())], ["asked", "near", "weight"]
                )

    found = met.mapInArrow(compare, f"asked {kinds[0]}, near {kinds[1]}, weight double")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("weight"), "near"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def knn_join(queries: DataFrame, docs: DataFrame, k: int, vector: str = "embedding", key: str = "doc_id", cells: int | None = None, probe: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k nearest documents of each row of ``queries`` (query_id, ``vector``).

    A query visits its nearest cells that hold k documents; then it meets all cells that may hold one as near as the k-th it has
    found, so the result is exact. With ``probe`` it visits that many cells and no others.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    schema = f"query_id {kinds[0]}, key {kinds[1]}, score double"
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").alias("id"), F.col(vector).alias("v"))
    centroids = fit_centroids(docs, key, vector, cells)
    members = settled(with_cell(docs.select(F.col(key).alias("id"), F.col(vector).alias("v")), centroids, "v"))
    held = cells_of(members, centroids)

    def meet(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"query_id": [], "key": [], "score": []})
        scores = np.zeros((len(some), len(others)))
        of = lambda rows: np.array([len(x) for x in rows["v"]])
        for width in set(of(some)) & set(of(others)):
            i, j = np.flatnonzero(of(some) == width), np.flatnonzero(of(others) == width)
            scores[np.ix_(i, j)] = units(some["v"].iloc[i]) @ units(others["v"].iloc[j]).T
        most = min(k, len(others))
        floor = np.partition(scores, -most, axis=1)[:, -most][:, None]
        i, j = np.nonzero(scores >= floor - 1e-12)
        return pd.DataFrame({"query_id": some["id"].to_numpy()[i], "key": others["id"].to_numpy()[j], "score": scores[i, j]})

    def nearest(angles: np.ndarray, bounds: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        return held.nearest(angles, k, probe)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    first = best(_met(_visits(asked, held, nearest), members.select("cell", "id", "v"), meet, schema, block))
    if not probe:
        floors = first.groupBy(F.col("query_id").alias("q_")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n_"))
        floored = asked.join(floors, F.col("id") == F.col("q_"), "left").select("id", "v", F.when(F.col("n_") >= k, F.col("floor") - 1e-9).otherwise(F.lit(-2.0)).alias("floor"))
        found = _nearest(settled(with_cell(floored, centroids, "v")), members, centroids, k, block)
        first = best(found.select(F.col("asked").alias("query_id"), F.col("near").alias("key"), F.col("weight").alias("score")))
    return first.withColumnRenamed("key", key)


def similar_classes(vectors: DataFrame, least: float, cells: int | None = None, block: int = BLOCK) -> tuple[DataFrame, int]:
    """((a, b, weight), visits): pairs a < b of rows of ``vectors`` (id, v; different vectors) of cosine ``least`` or more, and how
    many times a vector was sent to a cell.

    A vector visits a cell only if its angle to the centroid is at most the cell's radius and the angle of ``least`` together;
    of two cells that would visit each other, the one of the smaller number does.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    centroids = fit_centroids(vectors, "id", "v", cells)
    celled = settled(with_cell(vectors.select("id", "v"), centroids, "v"))
    held = cells_of(celled, centroids)
    members = celled.where(F.col("cell") != NOWHERE).select("cell", "id", "v", F.col("cell").alias("home"))

    def reach(angles: np.ndarray, bounds: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        return (bounds >= least) & (held.ids() >= rows["home"].to_numpy()[:, None]) & (held.ids() != NOWHERE)

    def meet(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"a": [], "b": [], "weight": []})
        x, y = units(some["v"]), units(others["v"])
        i, j = np.nonzero(x @ y.T >= least)
        p, q = some["id"].to_numpy()[i], others["id"].to_numpy()[j]
        keep = (some["home"].to_numpy()[i] < others["cell"].to_numpy()[j]) | (p < q)
        i, j, p, q = i[keep], j[keep], p[keep], q[keep]
        swap = p > q
        return pd.DataFrame({"a": np.where(swap, q, p), "b": np.where(swap, p, q), "weight": np.minimum(1.0, np.einsum("ij,ij->i", x[i], y[j]))})

    visits = settled(_visits(members, held, reach, ["home"]))
    return _met(visits, members.drop("home"), meet, f"a {kind}, b {kind}, weight double", block), visits.count()


def nearest_classes(vectors: DataFrame, least: float, most: int, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """(class, other, weight): for each row of ``vectors`` (id, v; different vectors) its ``most`` nearest others of cosine ``least``
    or more, ties by id. Unlike ``similar_classes`` it never makes the other pairs."""
    centroids = fit_centroids(vectors, "id", "v", cells)
    celled = settled(with_cell(vectors.select("id", "v"), centroids, "v")).where(F.col("cell") != NOWHERE)
    near = _nearest(celled.withColumn("floor", F.lit(float(least))), celled, centroids, most + 1, block).where("asked != near")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("weight"), "near"))
    near = near.withColumn("place", place).where(F.col("place") <= most)
    return near.select(F.col("asked").alias("class"), F.col("near").alias("other"), "weight")


def similar_pairs(vectors: DataFrame, least: float, per_node: int, key: str = "id", vector: str = "embedding", cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """(source_id, target_id, weight): for each vector its ``per_node`` nearest others of cosine ``least`` or more, ties by key.

    Equal vectors are one class, which is compared once. As many of a class's keys as can be among anyone's nearest stand for it.
    """
    kind = "array<float>" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))
    alike = Window.partitionBy("v").orderBy("id")
    named = rows.withColumns({"class": F.first("id").over(alike), "place": F.row_number().over(alike)})
    named = settled(named.withColumn("v", F.when(F.col("place") == 1, F.col("v"))))
    classes = named.where("place = 1").select("id", "v")
    ways = nearest_classes(classes, least, per_node + 1, cells, block)
    ways = ways.unionByName(classes.where(F.exists("v", lambda x: x != 0)).select(F.col("id").alias("class"), F.col("id").alias("other"), F.lit(1.0).alias("weight")))
    shown = named.where(F.col("place") <= per_node + 1).select(F.col("class").alias("other"), F.col("id").alias("near"))
    turn = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "near"))
    lists = ways.join(shown, "other").withColumn("turn", turn).where(F.col("turn") <= per_node + 1).select("class", "near", "weight", "turn")
    met = named.select("id", "class").join(lists, "class").where("near != id")
    own = F.row_number().over(Window.partitionBy("id").orderBy("turn"))
    top = met.withColumn("own", own).where(F.col("own") <= per_node)
    return top.select(F.col("id").alias("source_id"), F.col("near").alias("target_id"), "weight")


# ---- an index that is kept


class VectorIndex:
    """Vectors in a folder, by cell: ``vectors`` (key, vector, added; partitioned by cell), ``cells`` and ``gone``.

    Everything is appended. ``add`` gives rows a number of its own; a key that is added again or removed masks its earlier rows
    by that number, until ``compact``. Cells are written before vectors, so a search never relies on a radius that is too small.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", vector: str = "embedding"):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        """An index of ``vectors`` in a folder that is empty or new."""
        made = cls(vectors.sparkSession, path, key, vector)
        centroids = fit_centroids(vectors, key, vector, cells)
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
        made.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{made.path}/centroids")
        vectors.select(key, vector).limit(0).write.parquet(f"{made.path}/kinds")
        made._append(vectors, centroids, 0)
        return made

    def _read(self, name: str) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.path}/kinds").schema}
        schemas = {
            "vectors": f"`{self.key}` {kinds[self.key]}, `{self.vector}` {kinds[self.vector]}, added int, cell int",
            "gone": f"gone_key {kinds[self.key]}, before int",
            "cells": "cell int, radius double, n long, added int",
            "centroids": "cell int, centroid array<double>",
        }
        return self.spark.read.schema(schemas[name]).parquet(f"{self.path}/{name}")

    def exists(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gone/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self._read("centroids").orderBy("cell").collect()], dtype=np.float64)

    def cells(self) -> Cells:
        """Radii and sizes of all that was added; masked rows only make them larger than need be."""
        found = self._read("cells").where(F.col("cell").isNotNull()).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()
        return Cells(self._centroids(), {r["cell"]: r["radius"] for r in found}, {r["cell"]: r["n"] for r in found})

    def _turn(self) -> int:
        return (self._read("cells").agg(F.max("added")).first()[0] or 0) + 1

    def _append(self, vectors: DataFrame, centroids: np.ndarray, added: int) -> None:
        celled = settled(with_cell(vectors.select(self.key, self.vector), centroids, self.vector))
        summed = celled.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        mark = self.spark.createDataFrame([(None, None, None)], "cell int, radius double, n long")
        summed.unionByName(mark).withColumn("added", F.lit(added)).coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        rows = celled.drop("angle").withColumn("added", F.lit(added)).hint("rebalance", "cell")
        rows.write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        gone = celled.select(self.key).distinct() if added else celled.select(self.key).limit(0)
        self._mask(gone, added)

    def _mask(self, keys: DataFrame, before: int) -> None:
        keys.select(F.col(self.key).alias("gone_key"), F.lit(before).alias("before")).write.mode("append").parquet(f"{self.path}/gone")

    def add(self, vectors: DataFrame) -> None:
        """More vectors, by the centroids that are there; a key that is there already gets its new vector."""
        self._append(vectors, self._centroids(), self._turn())

    def remove(self, keys: DataFrame) -> None:
        turn = self._turn()
        mark = self.spark.createDataFrame([(None, None, None, turn)], "cell int, radius double, n long, added int")
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        self._mask(keys.select(self.key).distinct(), turn)

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """(key, vector): what is there, of some cells only if they are named; other cells' files aren't read."""
        found = self._read("vectors")
        if cells is not None:
            found = found.where(F.col("cell").isin([int(c) for c in cells]))
        masks = self._read("gone").groupBy("gone_key").agg(F.max("before").alias("before"))
        masked = (F.col(self.key) == F.col("gone_key")) & (F.col("added") < F.col("before"))
        return found.join(masks, masked, "left_anti").select(self.key, self.vector)

    def search(self, query: Sequence[float], k: int, probe: int | None = None) -> DataFrame:
        """(key, score): the k nearest, ties by key, exactly; with ``probe`` the nearest of the so many nearest cells."""
        return self._best(self.reach(query, k, probe), query, k)

    def reach(self, query: Sequence[float], k: int, probe: int | None = None) -> list[int]:
        """The cells that a search reads: the nearest that hold k rows, and those that may hold a nearer one than the k-th of these."""
        held = self.cells()
        ids = held.ids()
        if not len(ids):
            return []
        q = np.asarray(query, dtype=np.float64)[None, :]
        angles, bounds = held.bounds(q / max(np.linalg.norm(q), 1e-300))
        first = ids[held.nearest(angles, k, probe)[0]].tolist()
        if probe:
            return first
        near = self._best(first, query, k).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).first()
        floor = near["floor"] if near["n"] >= k else -2.0
        return sorted({*first, *ids[bounds[0] >= floor - 1e-9].tolist()})

    def _best(self, cells: Sequence[int], query: Sequence[float], k: int) -> DataFrame:
        asked: Column = F.array(*[F.lit(float(x)) for x in query])
        scored = self.rows(cells).select(self.key, cosine(F.col(self.vector), asked).alias("score"))
        return scored.orderBy(F.desc("score"), self.key).limit(k)

    def compact(self, path: str, cells: int | None = None) -> VectorIndex:
        """The same rows in a new folder, with new centroids and without masks."""
        return VectorIndex.build(self.rows(), path, self.key, self.vector, cells)
