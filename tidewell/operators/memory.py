"""Memory records: validation, duplicates, contradictions, signatures, lifetimes, staging, context and ageing."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import days_between
from tidewell.llm.shared import bit_filter, maybe_in
from tidewell.sources.scratch import settled

# Texts that look like an attempt to give instructions.
INJECTION_PATTERNS = [
    "remember that you must always",
    "for all future queries",
    "system instruction:",
    "override settings",
    "ignore previous instructions",
    "act as",
    "pretend you are",
    "you are now",
    "new persona",
    "developer mode",
    "your true self",
    "ignore all safety",
    "ignore all previous",
    "disregard prior",
    "disregard earlier",
    "forget your instructions",
    "override your",
    "bypass your",
    "supersede the system",
    "do anything now",
    "jailbreak",
    "no restrictions",
    "unrestricted mode",
    "repeat your system prompt",
    "show me your instructions",
    "what are your rules",
    "print your prompt",
]
# Categories of memories.
CATEGORIES = ["preferences", "entities", "events", "cases", "patterns"]
CATEGORY_ALIASES = {c.rstrip("s"): c for c in CATEGORIES} | {c: c for c in CATEGORIES} | {"entity": "entities"}
LAYERS = {"session": 0, "boot": 1, "archive": 2}
MIN_CONTENT, MIN_TITLE, MIN_TOPIC = 50, 10, 5
MAX_HANDOFF_BYTES = 4096


# ---- validation


def validation_errors(df: DataFrame) -> Column:
    """The array of what is wrong with a memory; empty if nothing is."""
    said = F.lower(F.concat_ws(" ", "title", "topic", "content"))
    found = [
        F.when(F.char_length("content") < MIN_CONTENT, "content too short"),
        F.when(F.char_length("title") < MIN_TITLE, "title too short"),
        F.when(F.char_length("topic") < MIN_TOPIC, "topic too short"),
        F.when(~F.col("importance").between(0.0, 1.0), "importance out of range"),
    ]
    found += [F.when(F.contains(said, F.lit(p)), f"injection: {p}") for p in INJECTION_PATTERNS]
    return F.array_compact(F.array(*found))


def validate(memories: DataFrame) -> DataFrame:
    errors = memories.withColumn("errors", validation_errors(memories))
    return errors.withColumn("valid", F.size("errors") == 0)


# ---- duplicates and contradictions


def title_duplicates(memories: DataFrame, others: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """Pairs (id_a, id_b, similarity) of titles whose edit similarity, 1 - distance / longer length, is ``least`` or more.

    Distinct titles are compared, by ``_near_titles``. Without ``others`` each pair of memories comes once.
    """
    ids = lambda r, x: r.select(F.col("id").alias(f"id_{x}"), F.col("title").alias(f"t_{x}"), *([f"several_{x}"] if f"several_{x}" in r.columns else []))
    if others is not None:
        left, right = _titled(memories), _titled(others)
        close = _near_titles(left.select("title").distinct(), right.select("title").distinct(), least)
        return close.join(ids(left, "a"), "t_a").join(ids(right, "b"), "t_b").where("id_a != id_b").select("id_a", "id_b", "similarity")
    rows = settled(_titled(memories))
    # only a memory of several titles can make a pair twice
    several = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("several")).where("several")
    rows = rows.join(several, "id", "left")
    titles = settled(rows.select("title").distinct()).withColumn("nr", F.monotonically_increasing_id())
    rows = settled(rows.join(titles, "title").select("nr", "id", F.coalesce("several", F.lit(False)).alias("several")))
    near = _near_titles(titles.select("title"), None, least)
    number = lambda x: titles.select(F.col("title").alias(f"t_{x}"), F.col("nr").alias(f"nr_{x}"))
    near = near.join(number("a"), "t_a").join(number("b"), "t_b").select("nr_a", "nr_b", "similarity")
    same, across = _same_rows(rows).withColumn("similarity", F.lit(1.0)), _other_rows(near, rows)
    pair = [F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity"]
    found = same.select(*pair, (F.col("several_a") & F.col("several_b")).alias("again")).unionByName(across.select(*pair, (F.col("several_a") | F.col("several_b")).alias("again")))
    if several.isEmpty():
        return found.drop("again")
    return found.where("not again").drop("again").unionByName(found.where("again").drop("again").distinct())


#: Rows of a class that one task pairs with others.
CHUNK = 2048


def _chunked(rows: DataFrame) -> DataFrame:
    """``rows`` (nr, id, ...) with the number of chunks of their class, and each row's chunk."""
    chunks = rows.groupBy("nr").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    return rows.join(chunks, "nr").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """The join by class and chunk, whose rows, the square of a class, aren't shuffled. A stated number of tasks, since adaptive
    execution would join so few bytes into one."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, "nr", "chunk").join(right.repartition(n, "nr", "chunk"), ["nr", "chunk"])


def _same_rows(rows: DataFrame) -> DataFrame:
    """Each pair of rows (nr, id, ...) of one class, once; the columns end in _a and _b. Classes meet chunk by chunk."""
    chunked = settled(_chunked(rows))
    of = lambda df, x: df.select("nr", "chunk", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "nr"])
    everywhere = chunked.drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return _met(of(everywhere, "a"), of(chunked, "b")).where("id_a < id_b")


def _other_rows(near: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of rows (nr, id, ...) of the classes of ``near`` (nr_a, nr_b, ...); the columns end in _a and _b. The rows of the
    smaller class come first, so what is shuffled aren't the pairs."""
    near, chunked = settled(near), settled(_chunked(rows))
    sizes = chunked.groupBy("nr").agg(F.count(F.lit(1)).alias("n"), F.first("chunks").alias("chunks"))
    for x in "ab":
        near = near.join(sizes.select(F.col("nr").alias(f"nr_{x}"), F.col("n").alias(f"n_{x}"), F.col("chunks").alias(f"chunks_{x}")), f"nr_{x}")
    turned = F.col("n_a") > F.col("n_b")
    told = [c for c in near.columns if c[:-2] not in ("nr", "n", "chunks")]
    ends = [F.when(turned, F.col("nr_b")).otherwise(F.col("nr_a")).alias("few"), F.when(turned, F.col("nr_a")).otherwise(F.col("nr_b")).alias("nr")]
    ends = near.select(*ends, F.greatest("chunks_a", "chunks_b").alias("chunks"), *told)
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "nr"]
    first = ends.join(rows.select(F.col("nr").alias("few"), *of("a")), "few").drop("few")
    first = first.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return _met(first, chunked.select("nr", "chunk", *of("b"))).where("id_a != id_b")


def title_classes(memories: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, class_id, class_size, n_duplicates): each memory with a title, the first memory of the same title, how many have it,
    and with how many others it makes a pair of ``title_duplicates``. The pairs themselves, the square of a class, aren't made."""
    rows = settled(_titled(memories))
    held = settled(rows.groupBy("title").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")))
    near = settled(_near_titles(held.select("title"), None, least).select("t_a", "t_b"))
    both = near.unionByName(near.select(F.col("t_b").alias("t_a"), F.col("t_a").alias("t_b")))
    linked = both.join(held.select(F.col("title").alias("t_b"), "class_size"), "t_b").groupBy(F.col("t_a").alias("title")).agg(F.sum("class_size").alias("others"))
    told = held.join(linked, "title", "left")
    return rows.join(told, "title").select("id", "class_id", "class_size", (F.coalesce("others", F.lit(0)) + F.col("class_size") - 1).alias("n_duplicates"))


def _titled(memories: DataFrame) -> DataFrame:
    return memories.select("id", F.lower("title").alias("title")).where("title != ''").distinct()


#: Bits of a title's sketch and of its larger one; titles of a block at most, and of one product of sketches.
TITLE_BITS, TITLE_MORE, TITLE_BLOCK, TITLE_TILE = 256, 512, 16384, 1024


def _sketched(titles: DataFrame, blocks: int) -> DataFrame:
    """(title, block, bits, more): a bit for each pair of neighbouring characters and its turn among equal ones, by hash; in two
    sketches."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):  # of an empty partition, without columns
                continue
            made = np.zeros((len(batch), TITLE_BITS + TITLE_MORE), dtype=np.uint8)
            for row, title in zip(made, batch["title"], strict=True):
                turns = {}
                for i in range(len(title) - 1):
                    pair = title[i : i + 2]
                    turns[pair] = turns.get(pair, 0) + 1
                    h = zlib.crc32(f"{pair}{turns[pair]}".encode("utf-8", "surrogatepass"))
                    row[h % TITLE_BITS] = row[TITLE_BITS + (h >> 16) % TITLE_MORE] = 1
            packed = np.packbits(made, axis=1)
            yield batch.assign(bits=[r.tobytes() for r in packed[:, : TITLE_BITS // 8]], more=[r.tobytes() for r in packed[:, TITLE_BITS // 8 :]])

    dealt = titles.select("title", F.pmod(F.xxhash64("title"), F.lit(blocks)).cast("int").alias("block"))
    n = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "block", "title").mapInPandas(sketch, "title string, block int, bits binary, more binary")


def _near_titles(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """(t_a, t_b, similarity) of distinct titles of either side; without ``right`` each pair of different titles of ``left`` once.

    An edit changes four at most of the bits of a title, so titles within k edits differ in 4 k bits at most. Bits are compared
    by products of matrices, block by block; of pairs that pass the larger sketches are compared, and only those that pass again
    are measured. With an edit in every seven characters no piece of a title is sure to stay whole that is long enough to tell
    titles apart by a join.
    """
    own = right is None
    left = settled(left)
    right = left if own else settled(right)
    counts = [df.count() for df in ((left,) if own else (left, right))]
    blocks = [max(1, -(-n // min(TITLE_BLOCK, max(256, -(-n // 16))))) for n in counts]
    n_a, n_b = blocks[0], blocks[-1]
    a = settled(_sketched(left, n_a))
    b = a if own else settled(_sketched(right, n_b))
    meets = lambda df, mine, other, seq: df.withColumn(mine, F.col("block")).withColumn(other, F.explode(seq)).drop("block")
    some = meets(a, "x", "y", F.sequence(F.col("block") if own else F.lit(0), F.lit(n_b - 1)))
    others = meets(b, "y", "x", F.sequence(F.lit(0), F.col("block") if own else F.lit(n_a - 1)))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group[group["left"]], group[~group["left"]]
        none = pd.DataFrame({"t_a": [], "t_b": []}, dtype=object)
        if not len(p) or not len(q):
            return none
        same = own and p["x"].iloc[0] == q["y"].iloc[0]
        bits = lambda df: np.unpackbits(np.frombuffer(b"".join(df["bits"]), dtype=np.uint8).reshape(len(df), -1), axis=1).astype(np.float32)
        p, q = (df.assign(size=df["title"].str.len()).sort_values("size", kind="stable") for df in (p, q))
        u, v = bits(p), bits(q)
        fine, finer = (np.frombuffer(b"".join(df["more"]), dtype=np.uint64).reshape(len(df), -1) for df in (p, q))
        m, n, s, t = (df[c].to_numpy() for c in ("size", "title") for df in (p, q))
        # the product of these is what two titles' bits share twice, without the bits of either: bits that differ, negative
        u = np.column_stack([2 * u, -u.sum(axis=1), -np.ones(len(u), np.float32)])
        v = np.ascontiguousarray(np.column_stack([v, np.ones(len(v), np.float32), v.sum(axis=1)]).T)
        room = np.empty((TITLE_TILE, TITLE_TILE), np.float32)
        found = [none]
        for i in range(0, len(p), TITLE_TILE):
            for j in range(0, len(q), TITLE_TILE):
                k, r = slice(i, i + TITLE_TILE), slice(j, j + TITLE_TILE)
                # a little more than 1 - least, for rounding; of the longest titles of the tiles first, then of each pair's
                reach = (1 - least + 1e-5) * max(m[k][-1], n[r][-1])
                if max(m[k][0] - n[r][-1], n[r][0] - m[k][-1]) > reach:
                    continue
                alike = room.reshape(-1)[: len(m[k]) * len(n[r])].reshape(len(m[k]), -1)
                np.matmul(u[k], v[:, r], out=alike)
                near = np.flatnonzero(alike.reshape(-1) >= -4 * reach)
                y, z = np.divmod(near, alike.shape[1])
                most = (1 - least + 1e-5) * np.maximum(m[k][y], n[r][z])
                keep = (alike[y, z] >= -4 * most) & (np.abs(m[k][y] - n[r][z]) <= most)
                y, z, most = y[keep], z[keep], most[keep]
                keep = np.bitwise_count(fine[k][y] ^ finer[r][z]).sum(axis=1, dtype=np.int32) <= 4 * most
                if same:
                    keep &= s[k][y] < t[r][z]
                if keep.any():
                    found.append(pd.DataFrame({"t_a": s[k][y[keep]], "t_b": t[r][z[keep]]}))
        return pd.concat(found, ignore_index=True)

    # a stated number, since the products take long and adaptive execution would join so few bytes into a few tasks
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_a * n_b, 256))
    both = some.withColumn("left", F.lit(True)).unionByName(others.withColumn("left", F.lit(False)))
    met = both.repartition(n, "x", "y").groupBy("x", "y").applyInPandas(meet, "t_a string, t_b string")
    longer = F.greatest(F.char_length("t_a"), F.char_length("t_b"))
    # beyond this the distance isn't counted to its end
    most = F.floor((1 - least + 1e-5) * longer).cast("int")
    near = met.withColumn("distance", F.call_function("levenshtein", F.col("t_a"), F.col("t_b"), most)).where("distance >= 0")
    return near.select("t_a", "t_b", (1 - F.col("distance") / longer).alias("similarity")).where(F.col("similarity") >= least)


def token_set(text: Column) -> Column:
    """Lower-case words with what isn't a letter or digit removed."""
    bare = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+")
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def content_pairs(memories: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs (id_a, id_b, jaccard, contradicts) of similar contents; they contradict if the trimmed contents differ.

    Memories of the same tokens are one class; classes are compared once, by ``_near_numbers``.
    """
    rows, sets = _token_classes(memories)
    near = _near_numbers(sets, least).select("nr_a", "nr_b", "jaccard")
    within = _same_rows(rows.select("nr", "id", "body")).select("id_a", "id_b", F.lit(1.0).alias("jaccard"), (F.col("body_a") != F.col("body_b")).alias("contradicts"))
    # memories of other tokens have other contents
    across = _other_rows(near, rows.select("nr", "id")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard", F.lit(True).alias("contradicts"))
    return within.unionByName(across)


def content_classes(memories: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, class_id, class_size, n_similar, n_contradicting): each memory, the first of the same content, how many have it, with
    how many others it makes a pair of ``content_pairs`` and with how many of these it disagrees. Memories of the same tokens are
    compared once, and no pairs of rows are made. Contents without a token are similar to none."""
    rows, sets = _token_classes(memories)
    near = settled(_near_numbers(sets, least).select("nr_a", "nr_b"))
    ways = near.unionByName(near.select(F.col("nr_b").alias("nr_a"), F.col("nr_a").alias("nr_b")))
    held = rows.groupBy("nr").agg(F.count(F.lit(1)).alias("in_set"))
    others = ways.join(held.select(F.col("nr").alias("nr_b"), "in_set"), "nr_b").groupBy(F.col("nr_a").alias("nr")).agg(F.sum("in_set").alias("others"))
    # memories of other tokens have other contents, so they all disagree; those of the same tokens do if their trimmed contents differ
    agreeing = rows.groupBy("nr", "body").agg(F.count(F.lit(1)).alias("agreeing")).join(held, "nr").join(others, "nr", "left")
    told = agreeing.select("nr", "body", (F.coalesce("others", F.lit(0)) + F.col("in_set") - 1).alias("n_similar"), (F.coalesce("others", F.lit(0)) + F.col("in_set") - F.col("agreeing")).alias("n_contradicting"))
    named = memories.select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("key"))
    classes = named.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    counts = rows.join(told, ["nr", "body"]).groupBy("key").agg(F.first("n_similar").alias("n_similar"), F.first("n_contradicting").alias("n_contradicting"))
    counted = classes.join(counts, "key", "left")
    return named.join(counted, "key").select("id", "class_id", "class_size", F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("n_contradicting", F.lit(0)).alias("n_contradicting"))


def _token_classes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): (id, key, body, nr) of memories with tokens, contents and trimmed contents by digest and the number of their
    set of tokens; and (nr, hashes) of each set, its tokens by hash."""
    words = memories.select("id", "content", F.array_sort(token_set(F.col("content"))).alias("tokens")).where(F.size("tokens") > 0)
    digest = F.sha2(F.concat_ws(" ", "tokens"), 256)
    told = words.select("id", F.sha2("content", 256).alias("key"), F.sha2(F.trim("content"), 256).alias("body"), digest.alias("set"), _hashes("tokens"))
    told = settled(told).withColumn("own", F.monotonically_increasing_id())
    rows = told.drop("hashes")
    first = rows.groupBy("set").agg(F.min("own").alias("nr"))
    rows = settled(rows.join(first, "set").select("id", "key", "body", "nr"))
    return rows, settled(told.select(F.col("own").alias("nr"), "hashes").join(rows.select("nr").distinct(), "nr"))


def _hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x)).alias("hashes")


#: Bits of the sketch of a set; parts by which it is seen whether two sets have met before; sets of a block whose pairs are measured.
SKETCH, BEFORE, SET_BLOCK = 1024, 8, 4096


def _near_sets(sets: DataFrame, least: float) -> DataFrame:
    """(set_a, set_b, jaccard), each pair once, of different sets (set, tokens) whose Jaccard similarity is ``least`` or more."""
    sets = settled(sets.select("set", _hashes("tokens"))).withColumn("nr", F.monotonically_increasing_id())
    name = lambda x: sets.select(F.col("nr").alias(f"nr_{x}"), F.col("set").alias(f"set_{x}"))
    return _near_numbers(settled(sets.select("nr", "hashes")), least).join(name("a"), "nr_a").join(name("b"), "nr_b").select("set_a", "set_b", "jaccard")


def _near_numbers(sets: DataFrame, least: float) -> DataFrame:
    """(nr_a, nr_b, jaccard), each pair once, of different sets (nr, hashes) whose Jaccard similarity is ``least`` or more.

    Sizes fall into classes, each ``1 / least`` times the one before, so similar sets are in the same class or in neighbouring ones.
    Sets that similar differ by k tokens at most, where k follows from the class. Tokens are dealt by hash into k + 1 parts, of
    which one is then the same in both; pairs meet by a part's digest. Parts that no two sets share are left out before. Of those
    that meet, the parities of the tokens by hash tell most of the others apart, since each token that differs changes one of
    them. Near sets share many parts, so a row has the digests of the first parts as well, and a pair that has met in one of those
    isn't made again. The pairs that are left are measured block by block, so a set goes to each block once and not to each pair.
    """
    ratio, width = (1 - least) / (1 + least), math.log(1 / (least - 1e-9))
    before = [f"p{i}" for i in range(BEFORE)]
    schema = "part long, place int, own boolean, nr long, n int, " + ", ".join(f"s{i} long" for i in range(SKETCH // 64)) + ", " + ", ".join(f"{p} long" for p in before)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def parts_of(h: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
        size = int(math.log(len(h)) / width)
        for group in (size, size + 1):
            k = int(2 * ratio * math.exp(width * (group + 1)) + 1e-6)
            parts = np.arange(k + 1, dtype=np.uint64) + np.uint64(group << 32)
            np.add.at(parts, (h % np.uint64(k + 1)).astype(np.int64), mixed(h))
            yield group == size, mixed(parts).view(np.int64)

    def in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                found = [part for held in batch["hashes"].iloc[start : start + 256] for _, part in parts_of(np.asarray(held, dtype=np.int64).view(np.uint64))]
                yield pd.DataFrame({"part": np.concatenate(found)})

    def in_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                yield of(batch.iloc[start : start + 256])

    def of(some: pd.DataFrame) -> pd.DataFrame:
        digests, own, nr, sizes, sketches, firsts = [], [], [], [], [], []
        for name, held in zip(some["nr"], some["hashes"], strict=True):
            h = np.asarray(held, dtype=np.int64).view(np.uint64)
            sketch = np.packbits((np.bincount((h >> np.uint64(32)) % np.uint64(SKETCH), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)
            for mine, part in parts_of(h):
                first = np.zeros(BEFORE, np.int64)
                first[: len(part)] = part[:BEFORE]
                for column, value in ((digests, part), (own, mine), (nr, name), (sizes, len(h)), (sketches, sketch), (firsts, first)):
                    column.append(value)
        times = [len(x) for x in digests]
        spread, first = np.repeat(np.stack(sketches), times, axis=0), np.repeat(np.stack(firsts), times, axis=0)
        place = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
        rows = {"part": np.concatenate(digests), "place": place, "own": np.repeat(own, times), "nr": np.repeat(nr, times), "n": np.repeat(sizes, times)}
        return pd.DataFrame(rows | {f"s{i}": spread[:, i] for i in range(SKETCH // 64)} | {p: first[:, i] for i, p in enumerate(before)})

    shared = sets.mapInPandas(in_parts, "part long").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    met = settled(maybe_in(sets.mapInPandas(in_rows, schema), "part", bit_filter(settled(shared), "part")))
    a, b = met.where("own").alias("a"), met.alias("b")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(SKETCH // 64)])
    sizes = (F.col("b.n") >= F.col("a.n") * (least - 1e-9)) & (F.col("a.n") >= F.col("b.n") * (least - 1e-9))
    once = ~F.col("b.own") | (F.col("a.nr") < F.col("b.nr"))
    few = differ <= F.floor(F.lit(ratio + 1e-9) * (F.col("a.n") + F.col("b.n")) + 1e-6)
    again = reduce(lambda x, y: x | y, [(F.col("a.place") > i) & (F.col(f"a.{p}") == F.col(f"b.{p}")) for i, p in enumerate(before)])
    pairs = a.join(b, F.col("a.part") == F.col("b.part")).where(once & sizes & few & ~again & (F.col("a.nr") != F.col("b.nr")))
    pairs = settled(pairs.select(F.least("a.nr", "b.nr").alias("nr_a"), F.greatest("a.nr", "b.nr").alias("nr_b")).distinct())
    return _measured(pairs, sets, least)


def _measured(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(nr_a, nr_b, jaccard) of those pairs (nr_a, nr_b) of sets (nr, hashes) whose Jaccard similarity is ``least`` or more. The
    sets are dealt into blocks, and two blocks with the pairs between them make a task."""
    ends = settled(pairs.select(F.col("nr_a").alias("nr")).unionByName(pairs.select(F.col("nr_b").alias("nr"))).distinct())
    blocks = max(8, -(-ends.count() // SET_BLOCK))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    x, y = F.least(of("nr_a"), of("nr_b")).alias("x"), F.greatest(of("nr_a"), of("nr_b")).alias("y")
    dealt = settled(pairs.select(x, y, "nr_a", "nr_b"))
    wanted = dealt.select("x", "y", F.col("nr_a").alias("nr")).unionByName(dealt.select("x", "y", F.col("nr_b").alias("nr"))).distinct()
    held = maybe_in(sets, "nr", bit_filter(ends, "nr"))
    # a row is a set or the pairs of a set
    of_sets = wanted.join(held, "nr").select("x", "y", "nr", "hashes", F.lit(None).cast("array<long>").alias("others"))
    of_pairs = dealt.groupBy("x", "y", F.col("nr_a").alias("nr")).agg(F.collect_list("nr_b").alias("others")).select("x", "y", "nr", F.lit(None).cast("array<long>").alias("hashes"), "others")

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        told, asked = group[group["others"].isna()], group[group["others"].notna()]
        at = {nr: np.sort(np.asarray(h, dtype=np.int64)) for nr, h in zip(told["nr"], told["hashes"], strict=True)}
        found = [pd.DataFrame({"nr_a": [], "nr_b": [], "jaccard": []})]
        for nr, others in zip(asked["nr"], asked["others"], strict=True):
            one, those = at[nr], [at[o] for o in others]
            flat, lengths = np.concatenate(those), np.array([len(o) for o in those])
            hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
            likeness = both / (len(one) + lengths - both)
            near = likeness >= least
            if near.any():
                found.append(pd.DataFrame({"nr_a": nr, "nr_b": np.asarray(others)[near], "jaccard": likeness[near]}))
        return pd.concat(found)

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return of_sets.unionByName(of_pairs).repartition(n, "x", "y").groupBy("x", "y").applyInPandas(measure, "nr_a long, nr_b long, jaccard double")


# ---- signatures


def hmac_sha256(key: bytes, payload: Column) -> Column:
    """HMAC-SHA256 in hexadecimal: the two nested digests of its definition, over the padded key."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ mask for b in padded).hex())) for mask in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(payload, "UTF-8")), 256))), 256)


def sign(memories: DataFrame, key: bytes, out: str = "signature") -> DataFrame:
    """Adds the HMAC-SHA256 of id:category:title:content in hexadecimal."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return memories.withColumn(out, hmac_sha256(key, F.concat_ws(":", empty("id"), empty("category"), empty("title"), empty("content"))))


def verify(memories: DataFrame, key: bytes) -> DataFrame:
    """Adds verified; unsigned memories aren't."""
    signed = sign(memories, key, "expected_")
    return signed.withColumn("verified", F.coalesce(F.lower("signature") == F.col("expected_"), F.lit(False))).drop("expected_")


def signature_status(memories: DataFrame, key: bytes) -> DataFrame:
    checked = verify(memories, key)
    return checked.withColumn("status", F.when(F.col("signature").isNull(), "UNSIGNED").when(F.col("verified"), "ok").otherwise("TAMPERED"))


# ---- lifetimes


def with_ttl(memories: DataFrame, hours: Column | int, as_of: datetime) -> DataFrame:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return memories.withColumn("expires_at", F.timestamp_micros(F.unix_micros(F.lit(as_of).cast("timestamp")) + hours.cast("long") * 3_600_000_000))


def lifetimes(memories: DataFrame, as_of: datetime) -> DataFrame:
    """Adds is_expired and remaining_hours (0 once expired, null without an end)."""
    left = days_between(F.col("expires_at"), F.lit(as_of).cast("timestamp")) * 24
    expired = F.coalesce(left <= 0, F.lit(False))
    return memories.withColumns({"is_expired": expired, "remaining_hours": F.when(expired, F.lit(0)).otherwise(F.floor(left)).cast("long")})


def prune_expired(memories: DataFrame, as_of: datetime) -> DataFrame:
    return memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def supersede(memories: DataFrame, by: DataFrame) -> DataFrame:
    """Marks memories that ``by`` (id, superseded_by) names, with a tag."""
    joined = memories.drop("superseded_by").join(by.select("id", "superseded_by"), "id", "left")
    return joined.withColumn("tags", F.when(F.col("superseded_by").isNotNull(), F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("superseded")))).otherwise(F.col("tags")))


# ---- records


def update(memories: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Applies (id, content, importance) changes, null for none; importance is kept within [0, 1]."""
    c = changes.select(F.col("id").alias("id_"), F.col("content").alias("content_"), F.col("importance").alias("importance_"))
    joined = memories.join(c, memories["id"] == c["id_"], "left")
    hit = F.col("id_").isNotNull()
    return joined.withColumns(
        {
            "content": F.coalesce("content_", "content"),
            # least and greatest leave nulls out, so no change must not get as far as that
            "importance": F.when(F.col("importance_").isNull(), F.col("importance")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance_")))),
            "updated": F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated") if "updated" in memories.columns else F.lit(None).cast("timestamp")),
        }
    ).drop("id_", "content_", "importance_")


def latest(memories: DataFrame, n: int) -> DataFrame:
    return memories.orderBy(F.desc("created"), "id").limit(n)


def review(staged: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted memories, staged ones with their new status) under (id, approve, notes) decisions."""
    d = decisions.select(F.col("id").alias("id_"), "approve", F.col("notes").alias("notes_"))
    joined = staged.join(d, staged["id"] == d["id_"], "left")
    status = F.when(F.col("approve"), "approved").when(~F.col("approve"), "rejected").otherwise(F.col("review_status"))
    left = joined.withColumns({"review_status": status, "reviewer_notes": F.coalesce("notes_", "reviewer_notes")}).drop("id_", "approve", "notes_")
    return left.where("review_status = 'approved'").drop("review_status", "reviewer_notes", "staged_at"), left


def remembered(batch: DataFrame, as_of: datetime, strict: bool = True, title: int = 80) -> DataFrame:
    """Memories from (content, category, importance): title from the first line, id from content and time.

    An unknown category is an error in the row (category null) if ``strict``, else "events".
    """
    aliases = F.create_map(*[F.lit(x) for pair in sorted(CATEGORY_ALIASES.items()) for x in pair])
    category = aliases[F.lower("category")]
    first = F.substring(F.element_at(F.split("content", "\n"), 1), 1, title)
    made = batch.withColumns({"category": category if strict else F.coalesce(category, F.lit("events")), "title": first, "topic": F.coalesce("category", F.lit("general"))})
    return made.withColumns(
        {
            "id": F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", F.lit(as_of.isoformat()), "content"), 256), 1, 8)),
            "importance": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5)))),
            "confidence": F.lit("medium"),
            "trust_level": F.lit(1.0),
            "created": F.lit(as_of).cast("timestamp"),
        }
    )


def as_document(memories: DataFrame) -> DataFrame:
    """(doc_id, content, metadata): a memory as a searchable document."""
    return memories.select(F.col("id").alias("doc_id"), F.concat_ws("\n\n", "title", "abstract_text", "content").alias("content"), F.to_json(F.struct("category", "topic", "importance")).alias("metadata"))


# ---- ageing


def decay_and_boost(memories: DataFrame, access: DataFrame, as_of: datetime) -> DataFrame:
    """Memories that were accessed, with new_importance: up within 7 days, down after 14, the same between."""
    used = access.groupBy("memory_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    joined = memories.select("id", "importance").join(used, F.col("id") == F.col("memory_id"))
    days = F.floor(days_between(F.lit(as_of).cast("timestamp"), F.col("last"))).cast("long")
    up = F.least(F.lit(1.0), F.col("importance") + F.least(F.lit(0.2), 0.05 * F.log2(F.col("n") + 1)))
    down = F.greatest(F.lit(0.1), F.col("importance") - F.least(F.lit(0.3), 0.02 * F.col("days") / 7))
    joined = joined.withColumn("days", days)
    new = F.when(F.col("days") <= 7, up).when(F.col("days") > 14, down).otherwise(F.col("importance"))
    return joined.select("id", "n", "days", "importance", new.alias("new_importance"))


# ---- context


def context_lookup(context: DataFrame) -> DataFrame:
    """The value of each key in its preferred layer: session, boot, archive, others."""
    place = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in LAYERS.items()], F.lit(9))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(place, "layer"))
    return context.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def set_context(context: DataFrame, rows: DataFrame) -> DataFrame:
    """Replaces (key, layer) entries."""
    return context.join(rows.select("key", "layer"), ["key", "layer"], "left_anti").unionByName(rows)


def memory_stats(memories: DataFrame, staged: DataFrame, access: DataFrame) -> DataFrame:
    of = memories.agg(F.count("*").alias("memories"), F.min("created").alias("oldest"), F.max("created").alias("newest"))
    return of.crossJoin(staged.agg(F.count("*").alias("staged"))).crossJoin(access.agg(F.count("*").alias("accesses")))


def injection(memories: DataFrame, seen: list[str] = (), budget_bytes: int = 2000, header: str = "[Relevant context from memory]\n") -> DataFrame:
    """The lines that fit a context budget: by relevance, ending before the first that doesn't fit."""
    line = F.concat(F.lit("- ["), F.col("category"), F.lit("] "), F.col("title"), F.lit(": "), F.col("abstract_text"), F.lit("\n"))
    rows = memories.where(~F.col("id").isin(*seen)) if seen else memories
    rows = rows.withColumn("line", line).withColumn("bytes", F.octet_length("line"))
    order = Window.partitionBy().orderBy(F.desc("importance"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.orderBy(F.desc("importance"), "id").limit(budget_bytes)  # a line has a byte at least, so no more can fit
    rows = rows.withColumn("used", F.sum("bytes").over(order) + len(header.encode()))
    return rows.where(F.col("used") <= budget_bytes)
