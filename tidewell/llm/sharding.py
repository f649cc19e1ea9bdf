"""Sharding by a hierarchical weighted hash tree (law ``key``).

A cluster is a tree of regions, racks and shards; a rack weighs what its shards weigh together, a region what its racks do. A
row draws ``-ln(u) / weight`` for each region, from a hash of its key and the region's name, and goes to the region of the least
draw, since the least of several exponential draws falls to each in proportion to its weight. There it draws for the racks of
that region, and then for the shards of that rack: draws on one path only. A change of a weight changes the draws of the nodes
above it alone, so rows move only into, out of or inside that subtree.

A tree is founded with some number of shards; every shard that is added later is a region of its own. Founded regions keep
their weights then, so one more shard takes rows only into itself.

Defined cases: null keys hash as a value of their own; null texts count as empty (size 1, CRC 0); repeated rows and ties each
get a slot; texts of any length are measured whole; an empty table gives an empty result; extra columns are kept, whatever
their names (namesakes of the added columns are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import running_start, temp_name


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(n_shards: int, founded: int | None = None, per_rack: int = 2, per_region: int = 4) -> list[Leaf]:
    """The tree of ``n_shards`` equal shards: the ``founded`` first (all, unless stated) fill racks and regions one after another,
    each later one is a region of its own."""
    founded = n_shards if founded is None else min(founded, n_shards)
    old = [Leaf(f"r{s // per_region}", f"k{s // per_rack}", s) for s in range(founded)]
    return old + [Leaf(f"added{s}", f"added{s}", s) for s in range(founded, n_shards)]


def _descend(key: Column, level: str, children: Sequence[tuple[str, float]], seed: int) -> Column:
    """The number of the child of the least weighted draw; equal draws go to the first child."""
    if len(children) == 1:
        return F.lit(0)
    draws = []
    for i, (name, weight) in enumerate(children):
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}:{name}"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(uniform) / F.lit(float(weight))).alias("draw"), F.lit(i).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def _of_chosen(at: str, branches: Sequence[Column]) -> Column:
    """The value of the branch whose number is in ``at``; no other is evaluated."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(branches))):
        out = F.when(F.col(at) == i, branches[i]).otherwise(out)
    return out


def with_shard(df: DataFrame, tree: Sequence[Leaf], key: str, out: str, seed: int = 0) -> DataFrame:
    """Adds ``out``: the shard of the tree that ``key`` descends to. Leaves of weight 0 get no rows."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        return df.withColumn(out, F.lit(None).cast("int"))
    weigh = lambda leaves: sum(leaf.weight for leaf in leaves)
    region_at, rack_at = temp_name(df, "region_at_"), temp_name(df, "rack_at_")
    racks = [(name, leaves) for held in regions.values() for name, leaves in held.items()]
    first = {id(held): n for held, n in zip(regions.values(), _before([len(h) for h in regions.values()]), strict=True)}
    chosen_region = _descend(F.col(key), "region", [(name, sum(map(weigh, held.values()))) for name, held in regions.items()], seed)
    in_region = [_descend(F.col(key), f"rack:{name}", [(rack, weigh(leaves)) for rack, leaves in held.items()], seed) + first[id(held)] for name, held in regions.items()]
    in_rack = []
    for name, leaves in racks:
        child = _descend(F.col(key), f"shard:{leaves[0].region}:{name}", [(str(leaf.shard), leaf.weight) for leaf in leaves], seed)
        in_rack.append(F.element_at(F.array(*[F.lit(leaf.shard) for leaf in leaves]), child + 1))
    found = df.withColumn(region_at, chosen_region).withColumn(rack_at, _of_chosen(region_at, in_region)).withColumn(out, _of_chosen(rack_at, in_rack).cast("int"))
    return found.drop(region_at, rack_at)


def _before(sizes: list[int]) -> list[int]:
    return [sum(sizes[:i]) for i in range(len(sizes))]


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the rows; slots of a shard run from 0 without gaps.

    The tree is founded with ``n_shards`` shards; grown_shard is the shard when it has one more.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumns(
        {"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body), "law": F.lit("key")}
    )
    df = with_shard(df, layout(n_shards), key, "shard", seed)
    df = with_shard(df, layout(n_shards + 1, founded=n_shards), key, "grown_shard", seed)
    one = temp_name(df, "one_")
    df = df.withColumn(one, F.lit(1).cast("long"))
    return running_start(df, "shard", one, [key, "size", "text_crc32"], "slot").drop(one)
