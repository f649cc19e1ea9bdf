"""N-gram Jaccard join: an exact similarity join in the metric space of Jaccard distances.

1 - |x & y| / |x | y| is a metric on sets of shingles. Two documents link when it is at most r = 1 - threshold.

Strangers. Almost all documents lie at distance 1 from almost all others, where pivots tell nothing apart, so documents that
link with none leave first. Of its n shingles a set takes the ones with the smallest hashes, as many as may differ and some
more; linked sets have some of those in common (``smallest_hashes``). A document of which fewer occur anywhere else links with
none.

Regions. Of the documents that are left, shingles fall into m classes by hash, m above the largest possible difference of two
linked sets, so linked sets have a class in common shingle by shingle. The least document of all that agree in a class is
their pivot, and a region is a pivot with all documents that agree with it in some class: every linked pair is in some region.

Cells. Within a region pivots are taken that are far from each other. Documents within r of a pivot link to it. Each of the
rest is at home with its nearest pivot, or outside if that is farther than 1 - r; a Voronoi cell holds a pivot's home documents
and, by the triangle inequality, boundary documents that are at most 2r farther from it than from their own pivot. Documents
linked to a cell's pivot that are too far from all others of the cell leave it; cells and the outside join in the same way.
Where pivots don't tell the documents of a cell apart, those that share one of their rarest shingles are compared.
Regions within REGION_BYTES of text are joined by one task, larger ones are cut into cells by Spark, round by round, or in pairs
of blocks where pivots don't tell their documents apart: cells that overlap would hold each text many times over. No pair is
lost and no group of near copies is expanded into pairs.

Passages that very many documents have would make large regions of strangers. Linked sets share more classes than one, so each
set leaves out as many of the classes that a sample knows to be frequent, from the most frequent on (``signatures``). Of equal
texts only the first is in a region.

Defined cases: null and empty texts have no shingles and link with nothing; a text of fewer than k words is one shingle;
a null doc_id links with nothing and has a null component; rows with one doc_id are one node; repeated rows each get the
result; very long texts are read whole; an empty table gives an empty result; extra columns are kept. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.llm.arrow import add_columns, slices
from tidewell.llm.components import connected_components
from tidewell.llm.shared import bit_filter, maybe_in, stored, surely_not_in, temp_name

#: Bytes of text that a region joined by one task holds at most.
REGION_BYTES = 4_000_000
#: New pivots of a region that is split by Spark, and rounds of that before blocks are paired.
PIVOTS, ROUNDS = 8, 4
#: Pivots of a cell in memory; cells of at most FEW documents are compared one by one.
CELL_PIVOTS, FEW = 8, 24
#: Of a hundred shingles, how many a set takes more than may differ.
SPARE = 10
#: Shingles that more than one document of a sample in so many has are known to be shared without a shuffle.
HOT_SHINGLES = 1000
#: Of texts that more than one row in so many has, only one document is searched with; there are at most so many such texts.
HOT_TEXTS = 1000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six gap characters
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)], dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = len(words) - k + 1
    found = np.zeros(n, np.uint64)
    for i in range(k):
        found = _mix(found * _A + hashes[i : i + n])
    return np.unique(found)


class Threshold:
    """Links when den * |x & y| >= num * |x | y|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.r = 1 - num / den

    def linked(self, inter, union):
        return (self.den * inter >= self.num * union) & (inter > 0)

    def most_different(self, n: int) -> int:
        """The largest difference (elements in just one of them) of linked sets of which the smaller has n elements."""
        return n * (self.den - self.num) // self.num

    def least_common(self, n: int) -> int:
        """The fewest elements that a set of n shares with any set it is linked to."""
        return -(-n * self.num // self.den)

    def classes(self, n: int) -> int:
        """The number of classes for a set of n: a power of two somewhat above the largest difference."""
        need, m = (11 * (self.most_different(n) + 1) + 9) // 10, 1
        if self.most_different(n) == 0:
            return 1
        while m < need:
            m *= 2
        return m

    def cells(self, d: np.ndarray) -> list[np.ndarray]:
        """Places of the documents in each pivot's cell and, last, of those outside; d[c, i]: the distance of i to pivot c.

        Linked documents are both outside, or one is at home with a pivot (its nearest, nearer than the rim) and the other is
        at most r farther from it than the first, and at most 2r farther than from its own nearest.
        """
        nearest, rim = d.min(axis=0), 1 - self.r - 1e-9
        reach = np.minimum(nearest + 2 * self.r, rim + self.r) + 1e-12
        cells = [np.flatnonzero(row <= reach) for row in d]
        return [*cells, np.flatnonzero(nearest > rim)]

    def levels(self, n: int) -> list[int]:
        """The class counts under which a set of n can meet a set that is as large or larger."""
        m, last = self.classes(n), self.classes(n * self.den // self.num)
        out = [m]
        while m < last:
            m *= 2
            out.append(m)
        return out


def signatures(sets: list[np.ndarray], limit: Threshold, hot: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for every class with shingles of every set on each of its levels.

    ``hot``: signatures known to be frequent, sorted, and how frequent they are. A set that has shingles in f classes on a level
    leaves out the f - d - 1 most frequent of them (others count as 0, and equal counts are ordered by signature), where d classes
    at most may differ: of the classes that two linked sets share, the last in this order has d others at most behind it in either
    set, so both keep it.

    If a set has shingles in no more classes than may differ, its smallest hashes, one more than may differ from a linked set,
    are signatures too: of two linked sets either one has an unchanged class with shingles, or both have such hashes, of
    which they share one.
    """
    jobs = [(i, m) for i, s in enumerate(sets) if len(s) for m in limit.levels(len(s))]
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.array([i for i, _ in jobs])
    sizes = np.array([m for _, m in jobs])
    base = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([sets[i] for i, _ in jobs])
    lengths = np.array([len(sets[i]) for i, _ in jobs])
    mixed = _mix(flat * _B + _A)
    slot = (mixed & np.repeat((sizes - 1).astype(np.uint64), lengths)).astype(np.int64) + np.repeat(base[:-1], lengths)
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, slot, _mix(flat * _C + _B))
    keep = np.bincount(slot, minlength=base[-1]) > 0
    job = np.repeat(np.arange(len(jobs)), sizes)
    place = np.arange(base[-1]) - base[job]
    tag = _mix((sizes[job].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + _C)
    tokens, job = _mix(total ^ tag)[keep], job[keep]
    filled = np.add.reduceat(keep.astype(np.int64), base[:-1])
    most = np.array([limit.most_different(len(sets[i])) for i in owner])
    often = np.zeros(len(tokens), np.int64)
    if hot is not None and len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], tokens), len(hot[0]) - 1)
        often = np.where(hot[0][at] == tokens, hot[1][at], 0)
    order = np.lexsort((tokens, -often, job))
    place = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
    stay = order[place >= (filled - most - 1)[job[order]]]
    found, of = [tokens[stay]], [owner[job[stay]]]
    for j in np.flatnonzero(filled <= most).tolist():
        one = sets[owner[j]]
        least = one[: len(one) - limit.least_common(len(one)) + 1]
        found.append(_mix(least * _C + sizes[j].astype(np.uint64)))
        of.append(np.full(len(least), owner[j]))
    return np.concatenate(found), np.concatenate(of)


# ---- one region in memory


class _Region:
    """Sets of a region in one flat array; finds components, not all pairs."""

    def __init__(self, sets: list[np.ndarray], limit: Threshold, blocks: np.ndarray | None = None):
        """blocks: of two blocks, each of which is joined elsewhere, only documents of different ones have to be compared."""
        self.sets, self.limit = sets, limit
        self.blocks = blocks if blocks is not None and len(np.unique(blocks)) > 1 else None
        self.sizes = np.array([len(s) for s in sets])
        self.root = list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def distances(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Jaccard distance, linked) of members to the pivot."""
        inter = intersections(self.sets[pivot], [self.sets[i] for i in members])
        union = self.sizes[members] + self.sizes[pivot] - inter
        return 1 - inter / union, self.limit.linked(inter, union)

    def join(self, members: np.ndarray) -> None:
        """Joins members, taken to be in any state."""
        while len(members) > 1:
            if len({self.find(i) for i in members.tolist()}) == 1:
                return
            pivots, d, linked = self._pivots(members, CELL_PIVOTS if len(members) > FEW else 1)
            rest = ~np.isin(members, pivots)
            members, d, linked = members[rest], d[:, rest], linked[:, rest]
            *cells, outside = self.limit.cells(d)
            cells = [members[at][self._open(d[c][at], linked[c][at])] for c, at in enumerate(cells)] + [members[outside]]
            if len(pivots) == 1:
                members = members[self._open(d[0], linked[0])]
                continue
            if sum(map(len, cells)) > len(members) or 2 * max(map(len, cells)) > len(members):  # pivots don't tell these apart
                self._by_rarest(members)
                return
            cells.sort(key=len)
            for cell in cells[:-1]:
                self.join(cell)
            members = cells[-1]

    def _pivots(self, members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first member and up to ``most`` - 1 others, each far from those before; distances and links of members to them."""
        pivots, ds, ls = [], [], []
        at = 0
        while len(pivots) < most:
            pivot = int(members[at])
            d, linked = self.distances(pivot, members)
            for i in members[linked].tolist():
                self.union(pivot, i)
            pivots.append(pivot)
            ds.append(d)
            ls.append(linked)
            nearest = np.min(ds, axis=0)
            at = int(np.argmax(nearest))
            if nearest[at] <= 2 * self.limit.r:
                break
        return np.array(pivots), np.array(ds), np.array(ls)

    def _by_rarest(self, members: np.ndarray) -> None:
        """Joins members by their rarest shingles: of two linked sets, each ordered from the rarest shingle in the cell on, the
        first n - least_common(n) + 1 of each have one in common. Documents of one component are compared until they link."""
        members = np.sort(members)
        sets = [self.sets[i] for i in members]
        lengths = np.array([len(s) for s in sets])
        _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), lengths)
        order = np.lexsort((at, often[at], owner))
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first = lengths - np.array([self.limit.least_common(n) for n in lengths.tolist()]) + 1
        rare = order[(place < first[owner]) & (often[at[order]] > 1)]
        met: dict[int, list[int]] = {}
        element = at[rare].tolist()
        ends = np.searchsorted(owner[rare], np.arange(len(sets) + 1)).tolist()
        for k in range(len(sets)):
            mine, near = int(members[k]), set()
            for e in element[ends[k] : ends[k + 1]]:
                held = met.setdefault(e, [])
                near.update(held)
                held.append(k)
            n = int(lengths[k])
            if self.blocks is not None:
                near = {j for j in near if self.blocks[members[j]] != self.blocks[mine]}
            near = sorted(j for j in near if lengths[j] >= self.limit.least_common(n) and n >= self.limit.least_common(int(lengths[j])))
            by_root: dict[int, int] = {}
            for j in near:
                by_root.setdefault(self.find(int(members[j])), j)
            self._compare(mine, [j for root, j in by_root.items() if root != self.find(mine)], members)
            self._compare(mine, [j for j in near if self.find(int(members[j])) != self.find(mine)], members)

    def _compare(self, mine: int, others: list[int], members: np.ndarray) -> None:
        if others:
            those = members[others]
            for i in those[self.distances(mine, those)[1]].tolist():
                self.union(mine, i)

    def _open(self, d: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """Which documents of a pivot's cell are still to be compared: all but linked ones too far from every unlinked one."""
        if linked.all():
            return np.zeros(len(d), bool)
        return ~linked | (d >= d[~linked].min() - self.limit.r - 1e-12)


def intersections(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Elements that each of the sorted sets shares with ``one``."""
    if not len(others):
        return np.zeros(0, np.int64)
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    hit = one[np.minimum(at, len(one) - 1)] == flat
    ends = np.cumsum([len(o) for o in others])
    running = np.concatenate([[0], np.cumsum(hit)])
    return running[ends] - running[ends - np.array([len(o) for o in others])]


def _joiner(limit: Threshold, k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids = group["id"].to_numpy()
        region = _Region([shingle_set(t, k) for t in group["text"]], limit, group["block"].to_numpy() if "block" in group else None)
        region.join(np.arange(len(ids)))
        roots = [region.find(i) for i in range(len(ids))]
        pairs = [(int(ids[i]), int(ids[r])) for i, r in enumerate(roots) if ids[i] != ids[r]]
        return pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype="int64")

    return run


# ---- the join


def signature_rows(df: DataFrame, key: str, text: str, k: int, limit: Threshold, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(sig, id): a row for each signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                sigs, owner = signatures([shingle_set(t, k) for t in part.column(at).to_pylist()], limit, hot)
                ids = part.column(part.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
                for start in range(0, len(sigs), 50_000):
                    piece = slice(start, start + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(sigs[piece].view(np.int64)), pa.array(ids[owner[piece]].astype(np.int64))], names=["sig", "id"])

    return df.mapInArrow(run, "sig long, id long")


def smallest_hashes(whole: np.ndarray, limit: Threshold) -> tuple[np.ndarray, int]:
    """(a set's smallest hashes, how many of them a linked set has among its own).

    A set of n takes n - least_common(n) + spare(n). Of two linked sets, the one whose largest taken hash is smaller has at
    least its spare of the other's among them, and the other has taken those too; the other may be the larger set, so each
    can only count on the spare of the smallest set that it could be linked to.
    """
    n, common = len(whole), limit.least_common(len(whole))
    spare = lambda size: max(1, size * SPARE // 100)
    return whole[: n - common + spare(n)], spare(common)


def _smallest(df: DataFrame, key: str, text: str, k: int, limit: Threshold, hot: np.ndarray) -> DataFrame:
    """(hash, id, need): a row for each of a set's smallest hashes that isn't hot. need: how many of them must occur elsewhere.

    A set that needs none has one row with need 0 besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            at, ident = batch.schema.get_field_index(text), batch.schema.get_field_index(key)
            for part in slices(batch, at):
                hashes, ids, needs = [], [], []
                for t, i in zip(part.column(at).to_pylist(), part.column(ident).to_pylist(), strict=True):
                    whole = shingle_set(t, k)
                    if not len(whole):
                        continue
                    least, need = smallest_hashes(whole, limit)
                    cold = least[hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] != least] if len(hot) else least
                    need -= len(least) - len(cold)
                    if need <= 0:
                        cold, need = whole[:1], 0
                    hashes.append(cold)
                    ids.append(np.full(len(cold), i, np.int64))
                    needs.append(np.full(len(cold), need, np.int32))
                if hashes:
                    columns = [np.concatenate(hashes).view(np.int64), np.concatenate(ids), np.concatenate(needs)]
                    for start in range(0, len(columns[0]), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 50_000]) for c in columns], names=["hash", "id", "need"])

    return df.mapInArrow(run, "hash long, id long, need int")


def _promising(documents: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """The documents that may link with any: all that do, and few others.

    Hashes that very many documents have are found on a sample of one document in 64 and known from then on, so no task
    gathers the documents of one of them; there can't be more than HOT_SHINGLES times a text's hashes of them.
    """
    none = np.zeros(0, np.uint64)
    sample = documents.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(64)) == 0)
    sampled = stored(_smallest(sample, "id", "text", k, limit, none).select("hash", "id").distinct(), "sampled")
    least = max(3, sampled.select("id").distinct().count() // HOT_SHINGLES)
    known = sampled.groupBy("hash").count().where(F.col("count") >= least).select("hash").toPandas()["hash"].to_numpy(np.int64)
    hot = np.sort(known.view(np.uint64))
    rows = _smallest(documents, "id", "text", k, limit, hot)
    elsewhere = F.min("id").over(Window.partitionBy("hash")) != F.max("id").over(Window.partitionBy("hash"))
    shared = rows.withColumn("shared", elsewhere).where("shared or need = 0")
    left = shared.groupBy("id", "need").count().where(F.col("count") >= F.col("need")).select(F.col("id").alias("left_id")).distinct()
    left = stored(left, "left")
    return maybe_in(documents, "id", bit_filter(left, "left_id")).join(left, F.col("id") == F.col("left_id")).select("id", "text")


def _hot_signatures(documents: DataFrame, k: int, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Frequent signatures and their counts in a sample of one document in 64; HOT_SHINGLES times a text's signatures at most."""
    sample = documents.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(64)) == 0)
    least = max(3, sample.count() // HOT_SHINGLES)
    known = signature_rows(sample, "id", "text", k, limit).groupBy("sig").count().where(F.col("count") >= least).toPandas()
    sigs = known["sig"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(sigs)
    return sigs[order], known["count"].to_numpy(np.int64)[order]


def _copies(documents: DataFrame) -> DataFrame:
    """(a, b): each document whose text an earlier one has, and the first of these."""
    told = documents.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("mark"))
    first = F.min("id").over(Window.partitionBy("mark"))
    return stored(told.select(F.col("id").alias("a"), first.alias("b")).where("a != b"), "copies")


def _regions(documents: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """(region, id): every document that agrees in a class with others, for each pivot it meets."""
    rows = signature_rows(documents, "id", "text", k, limit, _hot_signatures(documents, k, limit))
    least = rows.groupBy("sig").agg(F.min("id").alias("region"), F.max("id").alias("most"))
    shared = stored(least.where("region < most").select(F.col("sig").alias("sig2"), "region"), "shared")
    again = maybe_in(rows, "sig", bit_filter(shared, "sig2"))
    met = again.join(shared, F.col("sig") == F.col("sig2"))
    return _largest(stored(met.select("region", "id").distinct(), "regions"))


def _largest(regions: DataFrame) -> DataFrame:
    """Without regions whose documents are all in the first region that their pivot is in as well."""
    home = regions.groupBy(F.col("id").alias("pivot")).agg(F.min("region").alias("home")).where("pivot != home")
    moved = regions.join(home, F.col("region") == F.col("pivot")).select("region", "id", "home")
    there = regions.select(F.col("region").alias("home2"), F.col("id").alias("id2"))
    missed = moved.join(there, (F.col("home") == F.col("home2")) & (F.col("id") == F.col("id2")), "left_anti").select("region").distinct()
    inside = home.select(F.col("pivot").alias("region")).join(missed, "region", "left_anti")
    return stored(regions.join(inside, "region", "left_anti"), "largest")


def _chunks(rows: DataFrame, more: int = 0) -> DataFrame:
    mass = rows.groupBy(F.col("region").alias("region2")).agg(F.sum(F.octet_length("text")).alias("mass"))
    return mass.select("region2", F.ceil(F.col("mass") / (REGION_BYTES // 4) + more).cast("int").alias("chunks"))


def _split(rows: DataFrame, limit: Threshold, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round for regions (region, id, text) that are too large: (links, rows of the new regions).

    PIVOTS documents of each region are sent to every chunk of it; each chunk measures its documents against them. A region stays
    ``whole`` if its cells would hold more rows than it has, or one of them more than half of it.
    """
    chunks = _chunks(rows)
    slot = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(PIVOTS))
    chosen = rows.groupBy(F.col("region").alias("r2"), slot.alias("slot")).agg(F.min("id").alias("i2")).select("r2", "i2")
    centres = rows.join(chosen, (F.col("region") == F.col("r2")) & (F.col("id") == F.col("i2"))).select("region", "id", "text")
    sent = centres.join(chunks, F.col("region") == F.col("region2"))
    sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("pivot", F.lit(True))
    dealt = rows.join(chunks, F.col("region") == F.col("region2")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.col("chunks")).cast("int"))
    names = ["region", "chunk", "id", "text", "pivot"]
    both = dealt.withColumn("pivot", F.lit(False)).select(names).unionByName(sent.select(names))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        is_pivot = group["pivot"].to_numpy(dtype=bool)
        centres, members = group[is_pivot].sort_values("id"), group[~is_pivot].reset_index(drop=True)
        sets = [shingle_set(t, k) for t in members["text"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        ds, ls = [], []
        for centre in (shingle_set(t, k) for t in centres["text"]):
            inter = intersections(centre, sets)
            union = sizes + len(centre) - inter
            ds.append(1 - inter / np.maximum(union, 1))
            ls.append(limit.linked(inter, union))
        d, linked = np.array(ds).reshape(len(ds), len(sets)), np.array(ls, dtype=bool).reshape(len(ds), len(sets))
        if not len(centres) or not len(members):
            return pd.DataFrame({"parent": [], "pivot": [], "id": [], "d": [], "linked": []})
        *cells, outside = limit.cells(d)
        parts = []
        for c, at in enumerate(cells):
            parts.append(pd.DataFrame({"pivot": centres["id"].iloc[c], "id": members["id"].iloc[at], "d": d[c][at], "linked": linked[c][at]}))
        parts.append(pd.DataFrame({"pivot": None, "id": members["id"].iloc[outside], "d": 1.0, "linked": False}))
        return pd.concat(parts).assign(parent=group["region"].iloc[0])[["parent", "pivot", "id", "d", "linked"]].astype({"pivot": "Int64"})

    made = both.groupBy("region", "chunk").applyInPandas(measure, "parent long, pivot long, id long, d double, linked boolean")
    made = stored(made, "split")
    links = made.where("linked and id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    made = made.withColumn("child", F.xxhash64("parent", F.coalesce("pivot", F.lit(0)), F.col("pivot").isNull(), F.lit(seed)))
    open_ = made.where("not linked").groupBy(F.col("child").alias("child2")).agg(F.min("d").alias("from"))
    kept = made.join(open_, F.col("child") == F.col("child2")).where(F.col("d") >= F.col("from") - limit.r - 1e-12)
    kept = stored(kept.select("parent", "child", F.col("id").alias("id2")).distinct(), "kept")
    cells = kept.groupBy("parent", "child").count().groupBy("parent").agg(F.sum("count").alias("held"), F.max("count").alias("largest"))
    members = rows.groupBy(F.col("region").alias("parent")).agg(F.count(F.lit(1)).alias("members"))
    told = cells.join(members, "parent").select("parent", ((F.col("held") > F.col("members")) | (2 * F.col("largest") > F.col("members"))).alias("whole"))
    to = kept.join(told, "parent").select("parent", F.when(F.col("whole"), F.col("parent")).otherwise(F.col("child")).alias("to"), "id2", "whole").distinct()
    again = to.join(rows, (F.col("parent") == rows["region"]) & (F.col("id2") == rows["id"]))
    return links, again.select(F.col("to").alias("region"), "id", "text", "whole")


def _blocks(rows: DataFrame) -> DataFrame:
    """Regions that pivots don't split: every block of a region and every two blocks of it as a region of their own."""
    dealt = rows.join(_chunks(rows, 1), F.col("region") == F.col("region2")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(pair.alias("region"), "id", "text", "block")


def links(documents: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """Links (a, b) that span the components of (id, text) documents."""
    documents = stored(_promising(documents, k, limit), "promising")
    copies = _copies(documents)
    regions = _regions(documents, k, limit)
    regions = stored(regions.join(copies.select("a"), F.col("id") == F.col("a"), "left_anti"), "regions")
    wanted = stored(regions.select("id").distinct(), "wanted")
    texts = maybe_in(documents, "id", bit_filter(wanted, "id")).select(F.col("id").alias("id2"), "text")
    sizes = stored(texts.groupBy("id2").agg(F.sum(F.octet_length("text")).alias("bytes")), "sizes")
    mass = regions.join(sizes, F.col("id") == F.col("id2")).groupBy(F.col("region").alias("region2")).agg(F.sum("bytes").alias("mass"))
    large = stored(mass.where(F.col("mass") > REGION_BYTES).select("region2"), "large")

    joined = lambda rows: rows.groupBy("region").applyInPandas(_joiner(limit, k), "a long, b long")
    with_text = lambda rows: rows.join(texts, F.col("id") == F.col("id2")).select("region", "id", "text")
    found = [copies, joined(with_text(regions.join(large, F.col("region") == F.col("region2"), "left_anti")))]
    rows, seed = None, 0
    if not large.isEmpty():
        rows = stored(with_text(regions.join(large, F.col("region") == F.col("region2"), "left_semi")), "rows")
    while rows is not None:
        seed += 10
        linked, rows = _split(rows, limit, k, seed)
        found.append(linked)
        rows = stored(rows, "rows")
        found.append(joined(_blocks(rows.where("whole").drop("whole"))))
        rows = rows.where("not whole").drop("whole")
        mass = rows.groupBy("region").agg(F.sum(F.octet_length("text")).alias("mass"))
        large = stored(mass.where(F.col("mass") > REGION_BYTES).select(F.col("region").alias("region2")), "large")
        found.append(joined(rows.join(large, F.col("region") == F.col("region2"), "left_anti")))
        if large.isEmpty():
            break
        rows = stored(rows.join(large, F.col("region") == F.col("region2"), "left_semi"), "rows")
        if seed >= 10 * ROUNDS:
            found.append(joined(_blocks(rows)))
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out, "links")


def _hot_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(hot_mark, first_copy): the texts that so many rows have that there can't be more than HOT_TEXTS of them."""
    body = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("mark"))
    counted = stored(body.groupBy("mark").agg(F.min("id").alias("first_copy"), F.count("*").alias("copies")).where("copies > 50"), "counted")
    total = body.count()
    return stored(counted.where(F.col("copies") > total // HOT_TEXTS).select(F.col("mark").alias("hot_mark"), F.col("first_copy").cast("long").alias("first_copy")), "hot")


def _with_first(df: DataFrame, hot: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: for a row with a hot text, the id of its first document."""
    mark = temp_name(df, out + "mark_")
    hot = hot.select(F.col("hot_mark").alias(mark), F.col("first_copy").alias(out))
    return df.join(F.broadcast(hot), F.sha2(F.col(text).cast("binary"), 256) == F.col(mark), "left").drop(mark)


def _components(df: DataFrame, hot: DataFrame, key: str, text: str, k: int, limit: Threshold) -> DataFrame:
    """(id, component) of the documents that link with any, but for all copies of a hot text except its first document."""
    body = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    body = _with_first(body, hot, "text", "first").where("first is null or first = id").select("id", "text")
    return stored(connected_components(links(body, k, limit)), "components")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The columns but for the text, with n_shingles and component_id (the smallest id reachable by links)."""
    df = df.drop("n_shingles", "component_id")
    hot = _hot_texts(df, key, text)
    components = _components(df, hot, key, text, k, Threshold(num, den))
    first, node, of, found = (temp_name(df, n) for n in ("first_copy_", "node_", "id_", "component_"))
    sized = add_columns(_with_first(df, hot, text, first), text, [T.StructField("n_shingles", T.LongType())], _counter(k), keep_text=False)
    at = F.when(F.col(first).isNotNull() & (F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.col(first)).otherwise(F.col(key))
    sized = sized.withColumn(node, at).drop(first)
    out = sized.join(components.select(F.col("id").alias(of), F.col("component").alias(found)), F.col(node) == F.col(of), "left")
    return out.withColumn("component_id", F.coalesce(found, node)).drop(node, of, found)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows that stay when of each group of linked documents the smallest id stays.

    The ids that go are a small table; rows that a bit filter of it surely doesn't have stay without a shuffle.
    """
    hot = _hot_texts(df, key, text)
    gone = _components(df, hot, key, text, k, Threshold(num, den)).where("id != component").select("id")
    words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    copies = _with_first(df.where(words).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), hot, "text", "first").where("first is not null and id != first")
    mine = temp_name(df, "gone_id_")
    gone = stored(gone.unionByName(copies.select("id")).distinct(), "gone").withColumnRenamed("id", mine)
    made = bit_filter(gone, mine)
    wide = temp_name(df, "wide_id_")
    rows = df.withColumn(wide, F.col(key).cast("long"))
    # an outer join: the optimizer would move an anti join below the filter and so shuffle every text
    stay = maybe_in(rows, wide, made).join(gone, F.col(wide) == F.col(mine), "left").where(F.col(mine).isNull()).drop(mine)
    return surely_not_in(rows, wide, made).unionByName(stay).drop(wide)


def _counter(k: int):
    def make():
        return lambda column: [[len(shingle_set(t, k)) for t in column.to_pylist()]]

    return make
