"""Mixing sources to target weights by blocks of tokens.

The words of a source, its documents one after another, are a stream that is cut into blocks of a fixed length. A source
whose target is t gets round(t / size * blocks) slots. All slots are dealt to output shards of one length by a pseudorandom
permutation, which draws each shard's counts of sources: multinomial counts, given that the sources' totals are fixed. From
these counts the slots of each source are numbered, shard after shard; slot j reads block perm(j mod blocks), where perm is a
pseudorandom permutation of the source's block numbers (swap-or-not rounds, a bijection for any length), so a block is read
again only after all others were read. Slots and blocks are joined by (source, block).

Targets: sources in code-point order, null last, weigh by a repeating table and share ``share`` of all words; a target stops
at ``most`` times its source's size and the excess is shared again by weight.

Defined cases: a null source is a source of its own; null and empty texts have size 0 and are never taken; repeated rows and
rows with null or equal ids are separate stretches of the stream, each with its own pieces; texts of any length are cut whole;
an empty table gives an empty mix; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.shared import n_words, running_start, stored, temp_name, words

BLOCK_WORDS = 64
ROUNDS = 12
#: Slots of a stretch, and of a task that makes slots.
STRETCH, TASK_SLOTS = 4096, 1 << 17


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with target added; one row per source.

    With sources by rising ratio of limit to weight, those that reach their limit are a prefix; the first source whose fair
    share, after the limits before it, is within its own limit sets the level for itself and all that follow.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight_", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("limit_", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("limit_") / F.col("weight_"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("total_", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("level_", (F.col("total_") - F.coalesce(F.sum("limit_").over(before), F.lit(0.0))) / F.sum("weight_").over(after))
    fits = F.col("level_") * F.col("weight_") <= F.col("limit_")
    s = s.withColumn("level_", F.max(F.when(fits, F.col("level_"))).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.when(fits, F.col("level_")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("target", F.least(F.col("limit_"), F.coalesce(first * F.col("weight_"), F.col("limit_"))))
    return s.drop("weight_", "limit_", "total_", "level_")


def permuted(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..size-1 applied to ``index``; each key has its own."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, partner)), F.lit(2)) == 0
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index.cast("long"), step)


def _stretches(rows: DataFrame, n: str) -> DataFrame:
    """Adds from_ and to_: stretches of 0..n-1 of at most STRETCH, dealt to as many tasks as the sum of ``n`` needs."""
    total = rows.agg(F.sum(n)).first()[0] or 0
    ends = F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(STRETCH).cast("long"))
    cut = rows.where(F.col(n) > 0).withColumn("from_", F.explode(ends)).withColumn("to_", F.least(F.col("from_") + STRETCH, F.col(n)) - 1)
    return cut.repartition(max(1, -(-total // TASK_SLOTS)), *rows.columns, "from_")


def draw_counts(plan: DataFrame, out_shards: int, seed: int) -> DataFrame:
    """(source, out_shard, n): how many slots of each source each output shard gets. ``plan`` has source, slots_, offset_.

    Slots of all sources stand one after another; a permutation of them gives each a place, and places are cut into shards
    of one length (the last may be shorter).
    """
    total = plan.agg(F.sum("slots_")).first()[0] or 0
    length = max(1, -(-total // out_shards))
    slots = _stretches(plan.select("source", "slots_", "offset_"), "slots_").withColumn("slot", F.explode(F.sequence("from_", "to_")))
    place = permuted(F.col("offset_") + F.col("slot"), F.lit(max(1, total)).cast("long"), F.xxhash64(F.lit("shards"), F.lit(seed)))
    return slots.groupBy("source", F.floor(place / length).cast("int").alias("out_shard")).agg(F.count("*").alias("n"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = BLOCK_WORDS,
    out_shards: int = 64,
    seed: int = 0,
    row: str | None = None,
    **target_options,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: key_, source, size, row_, start_ (place in the source's stream), source_size, target.
    spans: a row for each document piece of each slot: source, out_shard, slot, block, row_, start_, word_from, n_words.

    ``row`` names a column that tells rows apart, if ``df`` has one; otherwise rows are numbered as they are stored.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    facts = df.select(F.col(key).alias("key_"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("text_"), number.alias("row_"))
    facts = stored(facts, "sizes")
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, **target_options)
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks_"))).otherwise(0).cast("long")
    plan = plan.withColumn("blocks_", F.ceil(F.col("source_size") / block).cast("long")).withColumn("slots_", slots)
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = stored(plan.withColumn("offset_", F.coalesce(F.sum("slots_").over(before), F.lit(0))), "targets")
    placed = running_start(facts, "source", "size", ["key_", "size", "text_", "row_"], "start_").drop("text_")

    first, last = F.floor(F.col("start_") / block), F.floor((F.col("start_") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    word_from = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start_"))
    pieces = pieces.withColumn("word_from", word_from)
    pieces = pieces.withColumn("n_words", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start_")) - word_from)

    counts = stored(draw_counts(plan, out_shards, seed), "counts")
    by_shard = Window.partitionBy("source").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first_", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    blocks = plan.select(F.col("source").alias("source2_"), "blocks_")
    counts = counts.join(blocks, counts["source"].eqNullSafe(blocks["source2_"])).select("source2_", "blocks_", "out_shard", "first_", "n")
    numbered = _stretches(stored(counts, "numbered"), "n").withColumn("slot", F.explode(F.sequence(F.col("first_") + F.col("from_"), F.col("first_") + F.col("to_"))))
    name = F.xxhash64(F.coalesce(F.col("source2_"), F.lit("\x00null")), F.lit(seed))
    read = permuted(F.pmod(F.col("slot"), F.col("blocks_")), F.col("blocks_"), name)
    numbered = numbered.select("source2_", "slot", "out_shard", read.alias("block2_"))
    # slots come from a few rows by explode, so the optimizer would take them for a table small enough to broadcast
    met = pieces.join(numbered.hint("merge"), pieces["source"].eqNullSafe(numbered["source2_"]) & (pieces["block"] == numbered["block2_"]))
    spans = met.select("source", "out_shard", "slot", "block", "row_", "start_", "word_from", "n_words")
    info = plan.select(F.col("source").alias("source2_"), "source_size", "target")
    documents = placed.join(info, placed["source"].eqNullSafe(info["source2_"])).drop("source2_")
    return documents, spans


def shard_counts(spans: DataFrame) -> DataFrame:
    """The drawn counts as the spans have them: blocks of each source in each output shard."""
    return spans.groupBy("out_shard", "source").agg(F.count_distinct("slot").alias("n_blocks"))


def taken_words(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents (key_, source, size, source_size, target) with taken: the words the mix takes of each row."""
    taken = spans.groupBy(F.col("row_").alias("row2_")).agg(F.sum("n_words").alias("taken"))
    return documents.join(taken, F.col("row_") == F.col("row2_"), "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("row2_")


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows of ``df`` with out_shard and slot: one for each document piece of each slot, its text the piece's words
    joined by a space. Rows are stored once with a number, by which they meet their pieces."""
    df = df.drop("out_shard", "slot")
    columns = df.columns
    row = temp_name(df, "mix_row_")
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, spans = mix(numbered, key, text, source, row=row, **options)
    other, since, many = (temp_name(numbered, n) for n in ("mix_other_", "mix_from_", "mix_words_"))
    spans = spans.select(F.col("row_").alias(other), "out_shard", "slot", F.col("word_from").alias(since), F.col("n_words").alias(many))
    met = numbered.join(spans, F.col(row) == F.col(other))
    piece = F.concat_ws(" ", F.slice(words(F.col(text)), (F.col(since) + 1).cast("int"), F.col(many).cast("int")))
    return met.withColumn(text, piece).select(*columns, "out_shard", "slot")
