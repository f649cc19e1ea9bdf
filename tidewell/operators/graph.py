"""The knowledge graph: building it from documents, and queries over it."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import let, md5_short
from tidewell.operators import text as T
from tidewell.operators.vectors import knn_join, similar_pairs
from tidewell.sources.scratch import settled

# How much an edge's type counts in a graph search.
TYPE_WEIGHTS = {"references": 1.5, "tagged_as": 1.3, "mentions": 1.2, "similar_to": 1.1, "discusses": 1.0, "temporal": 0.4}
OTHER_TYPE = 0.8
# Capitalised words that aren't entities, and technical terms that are.
COMMON_WORDS = (
    "The This That These Those And But Or So Then Now Here There When Where Why How What Which Who Whom Whose Will Would Could Should Might May Can Must Shall"
).split()
TECH_TERMS = r"Python|JavaScript|React|Vue|Angular|Node\.js|Django|Flask|Docker|Kubernetes|AWS|Azure|GCP|Rust|TypeScript|Go|Java|Ruby|PHP|Swift"
# Words that aren't topics.
TOPIC_STOP_WORDS = (
    "that this with have will from they been were some more than also each just like into over "
    "such very when what your about which their would there could other after being these those"
).split()


def live(edges: DataFrame, as_of: datetime) -> DataFrame:
    """Edges that haven't ended."""
    return edges.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(as_of).cast("timestamp")))


def invalidate(edges: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """Ends the edges that ``ids`` (id) names."""
    named = ids.select(F.col("id").alias("id_")).distinct()
    joined = edges.join(named, edges["id"] == named["id_"], "left")
    return joined.withColumn("valid_to", F.when(F.col("id_").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("valid_to"))).drop("id_")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: node, other and the edge's columns."""
    one = edges.withColumns({"node": F.col("source_id"), "other": F.col("target_id")})
    return one.unionByName(edges.withColumns({"node": F.col("target_id"), "other": F.col("source_id")}))


# ---- queries


def levels(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(node, distance) of all nodes within ``depth`` hops of ``start`` (node). A hop joins the frontier, not the graph."""
    hops = settled(both_ways(edges).select("node", "other").distinct())
    reached = start.select("node").distinct().withColumn("distance", F.lit(0).cast("long"))
    frontier = reached
    for d in range(1, depth + 1):
        new = frontier.join(hops, "node").select(F.col("other").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        frontier = settled(new.withColumn("distance", F.lit(d).cast("long")))
        reached = reached.unionByName(frontier)
    return reached


def neighbors(edges: DataFrame, start: str, depth: int, as_of: datetime, limit: int) -> DataFrame:
    """Live edges at nodes within depth - 1 hops of ``start``, with the node at the other end: the heaviest ``limit``."""
    on = live(edges, as_of)
    spark = edges.sparkSession
    near = levels(on, spark.createDataFrame([(start,)], "node string"), min(depth, 3))
    ends = both_ways(on).select(F.col("other").alias("near"), F.col("node"), "id", "type", "weight")
    met = ends.join(near.select(F.col("node").alias("near_")), F.col("node") == F.col("near_")).where(F.col("node") != start)
    return met.select("node", F.col("id").alias("edge_id"), "type", "weight").distinct().orderBy(F.desc("weight"), "node", "edge_id").limit(limit)


def connections(nodes: DataFrame, edges: DataFrame, title: str, depth: int, as_of: datetime) -> DataFrame:
    """(type, n, nodes): nodes within depth of the first node whose title contains the text, by type of discovering edge."""
    first = nodes.where(F.contains(F.lower("title"), F.lit(title.lower()))).orderBy("id").limit(1).select(F.col("id").alias("node"))
    on = live(edges, as_of)
    reached = levels(on, first, min(depth, 3))
    hop = both_ways(on).select("node", "other", "type", "weight", "id")
    near = reached.select(F.col("node").alias("from_"), F.col("distance").alias("d_"))
    found = reached.where("distance > 0").join(hop.withColumnRenamed("other", "other_"), "node")
    found = found.join(near, (F.col("other_") == F.col("from_")) & (F.col("d_") == F.col("distance") - 1))
    one = found.groupBy("node", "distance").agg(F.min_by("type", F.struct((-F.col("weight")).alias("w"), "id")).alias("type"))
    return one.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node")).alias("nodes"))


def similar(edges: DataFrame, nodes: DataFrame, node: str, limit: int) -> DataFrame:
    out = edges.where((F.col("source_id") == node) & (F.col("type") == "similar_to")).orderBy(F.desc("weight"), "target_id").limit(limit)
    return out.join(nodes.select(F.col("id").alias("target_id"), "title"), "target_id").select(F.col("target_id").alias("id"), "title", "weight")


def shortest_path(edges: DataFrame, a: str, b: str, as_of: datetime, most: int = 6, told: dict | None = None) -> DataFrame:
    """(distance, path) of a shortest path over live edges, the first by node ids; no row if there is none within ``most``.

    Two searches, from ``a`` and from ``b``, grow by a level in turns, the one with fewer nodes at its edge first, until they
    meet; rows are nodes, not paths. Then what leads from the meeting nodes back to either end is marked, level by level, and the
    path takes the least marked node of each level. ``told`` gets the number of nodes that were reached.
    """
    spark = edges.sparkSession
    shape = "distance long, path string"
    if a == b:
        return spark.createDataFrame([(0, a)], shape)
    hops = settled(both_ways(live(edges, as_of)).select("node", "other").distinct())
    step = lambda nodes: nodes.join(hops, "node").select(F.col("other").alias("node")).distinct()
    sides = [[spark.createDataFrame([(end,)], "node string")] for end in (a, b)]
    sizes, reached, meeting = [1, 1], 2, None
    while len(sides[0]) + len(sides[1]) - 2 < most:
        grow = 0 if sizes[0] <= sizes[1] else 1
        mine, others = sides[grow], sides[1 - grow]
        # a neighbour of the last level is in it, in the one before or in none
        new = step(mine[-1])
        for level in mine[-2:]:
            new = new.join(level, "node", "left_anti")
        new = settled(new)
        sizes[grow] = new.count()
        if not sizes[grow]:
            break
        mine.append(new)
        reached += sizes[grow]
        met = new.join(others[-1], "node", "left_semi")
        if not met.isEmpty():
            meeting = settled(met)
            break
    if told is not None:
        told["reached"] = reached
    if meeting is None:
        return spark.createDataFrame([], shape)

    def back(levels: list[DataFrame]) -> list[DataFrame]:
        """The marked nodes of each level, the end's own first."""
        marked = [meeting]
        for level in reversed(levels[:-1]):
            marked.append(settled(level.join(step(marked[-1]), "node", "left_semi")))
        return marked[::-1]

    way = [*back(sides[0]), *back(sides[1])[::-1][1:]]
    path = [a]
    for level in way[1:]:
        path.append(hops.where(F.col("node") == path[-1]).select(F.col("other").alias("node")).join(level, "node", "left_semi").agg(F.min("node")).first()[0])
    return spark.createDataFrame([(len(path) - 1, ">".join(path))], shape)


def topic_web(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    first = nodes.where(F.contains(F.lower("title"), F.lit(topic.lower()))).orderBy("id").limit(1).select(F.col("id").alias("node"))
    met = both_ways(edges).join(F.broadcast(first), "node").where("other != node")
    return met.groupBy(F.col("other").alias("id")).agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "id")


def hubs(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    counted = both_ways(edges.select("source_id", "target_id", F.col("id").alias("edge"))).groupBy(F.col("node").alias("id")).agg(F.count_distinct("edge").alias("n"))
    importance = F.coalesce(F.get_json_object("metadata", "$.importance_score").cast("double"), F.lit(0.0)) if "metadata" in nodes.columns else F.lit(0.0)
    named = nodes.select("id", "title", importance.alias("importance"))
    joined = named.join(counted, "id", "left").select("id", "title", F.coalesce("n", F.lit(0)).cast("long").alias("connections"), "importance")
    return joined.orderBy(F.desc("connections"), "id").limit(limit)


def suggest(edges: DataFrame, docs: DataFrame, doc_id: str, as_of: datetime, limit: int) -> DataFrame:
    near = both_ways(live(edges, as_of).where("type = 'co_retrieved'")).where(F.col("node") == doc_id).select(F.col("other").alias("doc_id"), "weight").distinct()
    joined = near.join(docs.select("doc_id", "excitability"), "doc_id", "left").withColumn("excitability", F.coalesce("excitability", F.lit(0.5)))
    return joined.orderBy(F.desc("weight"), "doc_id").limit(limit)


def graph_search(query: str, nodes: DataFrame, edges: DataFrame, as_of: datetime, per_word: int = 10, limit: int = 20, least_bytes: int = 20, depth: int = 2, per_start: int = 20) -> DataFrame:
    """(doc_id, content, score): nodes whose titles match the query's words, and the nodes within ``depth`` hops of them.

    From each match the ``per_start`` heaviest live edges at the nodes reached count, as in neighbors(); a node has the score
    of its best edge.
    """
    words = [w.lower() for w in query.split() if len(w.encode()) >= 3]
    schema = "doc_id string, content string, score double"
    if not words:
        return nodes.sparkSession.createDataFrame([], schema)
    matched = []
    for word in words:
        matched.append(nodes.where(F.contains(F.lower("title"), F.lit(word))).select("id", "title", "content").orderBy("id").limit(per_word))
    first = reduce(DataFrame.unionByName, matched).distinct()
    hits = lambda c: reduce(lambda a, b: a + b, [F.contains(F.lower(c), F.lit(w)).cast("double") for w in words])
    body = F.coalesce("content", "title")
    own = first.select("id", body.alias("content"), (1 + 0.5 * hits(F.col("title"))).alias("score"))

    kind = F.coalesce(*[F.when(F.col("type") == t, w) for t, w in TYPE_WEIGHTS.items()], F.lit(OTHER_TYPE))
    on = live(edges, as_of)
    ends = both_ways(on).select("node", F.col("id").alias("edge_id"), "type", "weight", "confidence")
    hops = both_ways(on).select("node", "other").distinct()
    frontier = first.select(F.col("id").alias("start"), F.col("id").alias("node"))
    reached = frontier
    for _ in range(min(depth, 3)):
        frontier = frontier.join(hops, "node").select("start", F.col("other").alias("node")).distinct()
        reached = reached.unionByName(frontier)
    # a match's own row is its title's; the nodes it reaches are those in the table of nodes
    reached = reached.where("node != start").distinct().join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    met = reached.join(ends, "node").distinct()
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("weight"), "node", "edge_id"))
    near = met.withColumn("place", place).where(F.col("place") <= per_start).select("node", (F.col("weight") * F.col("confidence") * kind).alias("base"))
    led = near.groupBy(F.col("node").alias("id")).agg(F.max("base").alias("base")).join(nodes.select("id", "title", "content"), "id")
    led = led.select("id", body.alias("content"), (F.col("base") * (1 + 0.5 * hits(F.col("title")) + 0.3 * hits(body))).alias("score"))
    both = own.unionByName(led).where(F.octet_length("content") >= least_bytes)
    best = both.groupBy("id").agg(F.max_by("content", "score").alias("content"), F.max("score").alias("score"))
    return best.select(F.concat(F.lit("graph:"), "id").alias("doc_id"), "content", "score").orderBy(F.desc("score"), "doc_id").limit(limit)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


# ---- building


def note_parts(notes: DataFrame) -> DataFrame:
    """(doc_id, kind, value, n): what each note (id, content) adds to a graph: its tags, links and entities, and its topic words
    with their counts. A graph is made of these rows alone, so of a changed note only its own are made anew."""
    c = F.col("content")
    listed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    each = F.concat(listed("tag", T.tags(c)), listed("link", T.wiki_links(c)), listed("entity", _entities(c)))
    marks = notes.select(F.col("id").alias("doc_id"), F.explode(each).alias("x")).select("doc_id", "x.kind", "x.value", F.lit(1).cast("long").alias("n"))
    words = notes.select(F.col("id").alias("doc_id"), F.explode(_topic_words(c)).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))
    return marks.unionByName(words.select("doc_id", F.lit("word").alias("kind"), "value", "n"))


def explicit_edges(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag nodes, edges): references by wiki links, resolved by title, and tagged_as by hashtags."""
    of = lambda kind, values: notes.select(F.col("id").alias("doc_id"), F.explode(values).alias("value")).withColumn("kind", F.lit(kind))
    return explicit_of(of("tag", T.tags(F.col("content"))).unionByName(of("link", T.wiki_links(F.col("content")))), notes)


def explicit_of(parts: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """explicit_edges from the rows of ``note_parts`` and the notes' titles (id, title)."""
    tagged = parts.where("kind = 'tag'").select(F.col("doc_id").alias("id"), F.col("value").alias("tag"))
    tag_nodes = tagged.select(F.concat(F.lit("tag_"), "tag").alias("id"), F.lit("tag").alias("type"), F.concat(F.lit("#"), "tag").alias("title")).distinct()
    tag_edges = tagged.select(F.col("id").alias("source_id"), F.concat(F.lit("tag_"), "tag").alias("target_id"), F.lit("tagged_as").alias("type"), F.lit(0.7).alias("weight"), F.lit(1.0).alias("confidence"))
    links = parts.where("kind = 'link'").select(F.col("doc_id").alias("id"), F.col("value").alias("link"))
    found = resolve_titles(links.select("link").distinct(), notes.select("id", "title"))
    refs = links.join(found, "link").where("id != target_id").select(F.col("id").alias("source_id"), "target_id", F.lit("references").alias("type"), F.lit(0.8).alias("weight"), F.lit(0.9).alias("confidence"))
    return tag_nodes, refs.unionByName(tag_edges).distinct()


def resolve_titles(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(link, target_id): the title that equals the link, else equals it trimmed, else contains it or is contained; shortest first.

    Equal titles are compared once, by the first of them. Containment is a join on pieces (``contained``), not of all with all.
    """
    t = titles.groupBy(F.lower("title").alias("t")).agg(F.min("id").alias("target_id"))
    l = links.select("link", F.lower("link").alias("l")).distinct()  # noqa: E741
    exact = l.join(t, F.col("l") == F.col("t")).withColumn("priority", F.lit(0))
    trimmed = l.join(t, F.trim("l") == F.trim("t")).withColumn("priority", F.lit(1))
    settled_ = settled(exact.select("link", "priority", "t", "target_id").unionByName(trimmed.select("link", "priority", "t", "target_id")))
    left = settled(l.join(settled_.select("link").distinct(), "link", "left_anti"))
    words, whole = left.select(F.col("l").alias("s")).distinct(), t.select(F.col("t").alias("s"))
    met = contained(words, whole).select(F.col("short").alias("l"), F.col("long").alias("t"))
    met = met.unionByName(contained(whole, words).select(F.col("long").alias("l"), F.col("short").alias("t"))).distinct()
    found = met.join(left, "l").join(t, "t").select("link", F.lit(2).alias("priority"), "t", "target_id")
    best = settled_.unionByName(found).groupBy("link").agg(F.min(F.struct("priority", F.octet_length("t").alias("size"), "target_id")).alias("b"))
    return best.select("link", F.col("b.target_id").alias("target_id"))


#: Characters of the pieces by which strings find those that contain them.
PIECE = 3


def _pieces(text: Column, size: Column | int) -> Column:
    """The distinct stretches of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, size)))


def contained(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """(short, long): the strings (s) of ``shorter`` that those (s) of ``longer`` contain; empty strings aside.

    A string that is contained has all its pieces in the other, so it is looked up by the one that the fewest of them have; then
    the pair is verified. Strings of fewer than PIECE characters are their own piece.
    """
    sized = shorter.where("s != ''").select("s", F.least(F.char_length("s"), F.lit(PIECE)).alias("size"))
    mine = sized.select("s", F.explode(_pieces(F.col("s"), F.col("size"))).alias("piece"))
    theirs = longer.where("s != ''").select("s", F.explode(F.flatten(F.array(*[F.when(F.char_length("s") >= n, _pieces(F.col("s"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, PIECE + 1)]))).alias("piece"))
    # only the pieces that are asked for stay
    theirs = settled(theirs.join(mine.select("piece").distinct(), "piece", "left_semi"))
    counts = theirs.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    known = mine.join(counts, "piece", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest"))
    asked = known.where("rarest.n > 0").select(F.col("s").alias("short"), F.col("rarest.piece").alias("piece"))
    met = asked.join(theirs.select(F.col("s").alias("long"), "piece"), "piece").where(F.contains("long", "short"))
    return met.select("short", "long")


def temporal_pairs(dated: DataFrame, days: int = 7) -> DataFrame:
    """(source_id, target_id, gap, weight) of nodes (id, date) at most ``days`` apart: nodes meet those of their day and of each of
    the ``days`` before. Each pair is met once, so the pairs, which are many more than the nodes, aren't shuffled."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    at = dated.where("date is not null").select("id", day.alias("day")).distinct()
    a = at.select(F.col("id").alias("target_id"), F.col("day").alias("later"), F.explode(F.sequence(F.col("day") - days, F.col("day"))).alias("day"))
    # a stated number, since adaptive execution would join so few bytes into one task
    n = int(dated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(n, "day").join(at.withColumnRenamed("id", "source_id").repartition(n, "day"), "day").where("source_id < target_id or (source_id > target_id and day < later)")
    pairs = met.select("source_id", "target_id", (F.col("later") - F.col("day")).cast("long").alias("gap"))
    return pairs.withColumn("weight", F.greatest(F.lit(0.3), 1 - 0.5 * F.col("gap") / days))


#: Rows of a range in the sweep over dates.
RANGE = 65_536


def temporal_edges(dated: DataFrame, days: int = 7, most: int = 50_000, per_node: int = 20, rows: int = RANGE) -> DataFrame:
    """(source_id, target_id, weight) of nodes (id, date) at most ``days`` apart: kept in order of dates and ids while both ends
    have fewer than ``per_node``, and the first ``most`` of those.

    A node that isn't full links to the nodes right behind it, since whoever has linked to a later one has linked to it as well.
    So a sweep in order only has to know how far the last ``per_node`` nodes reach. The nodes are dealt into ranges of about
    ``rows``; a range is swept with what reaches into it from the one before, and with the first nodes behind it, and no further
    range is read once there are ``most`` links. No pairs are made but those that stay.
    """
    at = dated.where("date is not null").select("id", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"))
    n = max(1, -(-at.count() // rows))
    ranged = settled(at.repartitionByRange(n, "day", "id").withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = dated.schema["id"].dataType.simpleString()
    schema = f"source_id {kind}, target_id {kind}, gap long, place long, reach array<long>"
    parts, reach, made = [], [], 0
    for r in sorted(sizes):
        behind, so_far = [], 0
        for later in sorted(k for k in sizes if k > r):
            if so_far >= per_node:
                break
            behind, so_far = [*behind, later], so_far + sizes[later]
        ahead = ranged.where(F.col("range").isin(behind)).orderBy("day", "id").limit(per_node) if behind else ranged.limit(0)
        # one range and a few rows: a bounded number
        one = ranged.where(F.col("range") == r).unionByName(ahead).coalesce(1).sortWithinPartitions("day", "id")
        swept = settled(one.mapInPandas(_sweep(days, per_node, sizes[r], reach), schema))
        state = swept.where("reach is not null").select("reach", "place").first()
        parts.append(swept.where("reach is null").withColumn("range", F.lit(r)))
        reach, made = list(state["reach"]), made + state["place"]
        if made >= most:
            break
    if not parts:
        return dated.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit(0.0).alias("weight")).limit(0)
    kept = reduce(DataFrame.unionByName, parts).orderBy("range", "place").limit(most)
    return kept.select("source_id", "target_id", F.greatest(F.lit(0.3), 1 - 0.5 * F.col("gap") / days).alias("weight"))


def _sweep(days: int, per_node: int, own: int, reach: list[int]):
    """Links of the first ``own`` of sorted rows, and a last row with their number and how far (from the end of these rows) the
    last nodes reach. ``reach``: the same of the range before."""

    def run(batches):
        rows = pd.concat(list(batches), ignore_index=True)
        day, ids = rows["day"].to_numpy(), rows["id"].to_numpy()
        last = np.searchsorted(day, day + days, side="right") - 1
        ends, made = list(reach), []
        for i in range(min(own, len(rows))):
            ends = [e for e in ends if e >= i]
            free = min(per_node - len(ends), int(last[i]) - i)
            if free > 0:
                made += [(i, j) for j in range(i + 1, i + free + 1)]
                ends.append(i + free)
        i, j = (np.array(x, dtype=np.int64) for x in zip(*made, strict=True)) if made else (np.zeros(0, dtype=np.int64),) * 2
        links = pd.DataFrame({"source_id": ids[i], "target_id": ids[j], "gap": (day[j] - day[i]).astype(np.int64), "place": np.arange(len(i)), "reach": None})
        if len(links):
            yield links
        yield pd.DataFrame({"source_id": [None], "target_id": [None], "gap": [0], "place": [len(made)], "reach": [[e - own for e in ends if e >= own]]})

    return run


def date_of(path: Column, metadata: Column | None = None) -> Column:
    """The date in a note's metadata, else in its path."""
    found = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1)
    fields = [F.get_json_object(metadata, f"$.{name}") for name in ("created_time", "modified_time", "file_date", "date", "fm_date")] if metadata is not None else []
    return F.to_date(F.coalesce(*[F.try_to_timestamp(F.left(x, F.lit(10)), F.lit("yyyy-MM-dd")) for x in [*fields, F.nullif(found, F.lit(""))]]))


def _entities(content: Column) -> Column:
    """Distinct names, technical terms, capitalised words and links."""
    patterns = [r"(?U)\b[A-Z][a-z]+ [A-Z][a-z]+\b", rf"(?U)\b(?:{TECH_TERMS})\b", r"(?U)\b[A-Z][a-zA-Z]{2,}\b"]
    found = reduce(F.array_union, [F.regexp_extract_all(content, F.lit(p), F.lit(0)) for p in patterns] + [T.wiki_links(content)])
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(COMMON_WORDS)))


def entity_mentions(notes: DataFrame, least: int = 2) -> DataFrame:
    """(id, entity, entity_id, frequency): names, technical terms, capitalised words and links that occur in several notes."""
    return entities_of(notes.select(F.col("id").alias("doc_id"), F.lit("entity").alias("kind"), F.explode(_entities(F.col("content"))).alias("value")), least)


def entities_of(parts: DataFrame, least: int = 2) -> DataFrame:
    """entity_mentions from the rows of ``note_parts``."""
    seen = parts.where("kind = 'entity'").select(F.col("doc_id").alias("id"), F.col("value").alias("entity"))
    frequent = seen.groupBy("entity").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    return seen.join(frequent, "entity").select("id", "entity", F.concat(F.lit("entity_"), md5_short(F.lower("entity"))).alias("entity_id"), "frequency")


def _topic_words(content: Column) -> Column:
    return F.filter(F.split(F.lower(content), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w.rlike("^[a-z]{4,}$"))


def topic_clusters(notes: DataFrame, words: int = 20, least: int = 2, least_notes: int = 1) -> DataFrame:
    """(id, topic, topic_id, n): the corpus's most frequent words, and the notes that use each of them at least twice.

    One scan finds the words, a second counts only those in each note; no (note, word) rows are shuffled. Fewer than
    ``least_notes`` notes have no topics.
    """
    token = _topic_words(F.col("content"))
    totals = notes.select(F.explode(token).alias("topic")).groupBy("topic").agg(F.count("*").alias("total"))
    frequent = totals.where((F.col("total") >= 2) & ~F.col("topic").isin(TOPIC_STOP_WORDS)).orderBy(F.desc("total"), "topic").limit(words)
    top = [r["topic"] for r in frequent.collect()]
    if not top or (least_notes > 1 and notes.limit(least_notes).count() < least_notes):
        top = []
    asked = F.array(*[F.lit(t) for t in top]).cast("array<string>")
    hits = F.filter(token, lambda w: F.array_contains(asked, w))
    each = lambda h: F.transform(asked, lambda t: F.struct(t.alias("topic"), F.size(F.filter(h, lambda w: w == t)).cast("long").alias("n")))
    used = notes.select("id", F.explode(F.filter(let(hits, each), lambda x: x["n"] >= least)).alias("x")).select("id", "x.topic", "x.n")
    used = settled(used)
    shared = used.groupBy("topic").agg(F.count("*").alias("notes")).where("notes >= 2").select("topic")
    return used.join(F.broadcast(shared), "topic").select("id", "topic", F.concat(F.lit("topic_"), md5_short(F.col("topic"))).alias("topic_id"), "n")


def topics_of(parts: DataFrame, words: int = 20, least: int = 2) -> DataFrame:
    """topic_clusters from the rows of ``note_parts``: frequencies are sums over notes, so no text is read."""
    counted = parts.where("kind = 'word'").select(F.col("doc_id").alias("id"), F.col("value").alias("topic"), "n")
    totals = counted.groupBy("topic").agg(F.sum("n").alias("total")).where((F.col("total") >= 2) & ~F.col("topic").isin(TOPIC_STOP_WORDS))
    top = F.broadcast(totals.orderBy(F.desc("total"), "topic").limit(words).select("topic"))
    used = settled(counted.join(top, "topic").where(F.col("n") >= least).select("id", "topic", "n"))
    shared = used.groupBy("topic").agg(F.count("*").alias("notes")).where("notes >= 2").select("topic")
    return used.join(F.broadcast(shared), "topic").select("id", "topic", F.concat(F.lit("topic_"), md5_short(F.col("topic"))).alias("topic_id"), "n")


def semantic_edges(vectors: DataFrame, least: float = 0.7, per_node: int = 20, key: str = "id", cells: int | None = None) -> DataFrame:
    """(source_id, target_id, weight): pairs of cosine ``least`` or more, each node's ``per_node`` nearest. Vectors meet in cells."""
    top = similar_pairs(vectors, least, per_node, key, cells=cells)
    return top.select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"), "weight").distinct()


def semantic_capped(pairs: DataFrame, per_node: int = 20) -> DataFrame:
    """Of semantic_edges' pairs, those kept when nodes in order of ids take their nearest while both ends have fewer than ``per_node``."""
    ends = lambda a, b: F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"))
    ways = pairs.select(F.explode(F.array(ends("source_id", "target_id"), ends("target_id", "source_id"))).alias("way"), "weight").select("way.*", "weight")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id"))
    first = ways.withColumn("rank", rank).where(F.col("rank") <= per_node)
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    turn = F.struct(F.col("source_id").cast("string").alias("s"), "rank")
    order = first.groupBy(a.alias("source_id"), b.alias("target_id")).agg(F.min(turn).alias("turn"), F.max("weight").alias("nearness"))
    # prune_greedy goes by weight, then id; equal weights and ids that sort like the turns make it go turn by turn
    named = order.select("source_id", "target_id", "nearness", F.lit(1.0).alias("weight"), F.concat_ws("\u0001", "turn.s", F.lpad(F.col("turn.rank").cast("string"), len(str(per_node)), "0")).alias("id"))
    return prune_greedy(named, 0.0, per_node).select("source_id", "target_id", F.col("nearness").alias("weight"))


def allocation_edges(new: DataFrame, docs: DataFrame, above: float = 0.6, k: int = 5) -> DataFrame:
    """(source_id, target_id, type, weight, confidence): from each new document (doc_id, embedding) to those of its k nearest
    documents, itself apart, whose excitability is over ``above``."""
    near = knn_join(new.select(F.col("doc_id").alias("query_id"), "embedding"), docs, k + 1)
    others = near.where("query_id != doc_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
    excited = docs.where(F.col("excitability") > above).select("doc_id")
    kept = others.join(excited, "doc_id", "left_semi")
    return kept.select(F.col("query_id").alias("source_id"), F.col("doc_id").alias("target_id"), F.lit("similar_to").alias("type"), F.col("score").alias("weight"), F.lit(0.8).alias("confidence"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    counted = both_ways(edges.where("source_id != target_id")).groupBy("node").agg(F.count_distinct("other").alias("degree"))
    top = counted.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    return counted.crossJoin(F.broadcast(top)).select(F.col("node").alias("id"), "degree", (F.col("degree") / F.col("top")).alias("centrality"))


def betweenness(edges: DataFrame, samples: int = 500) -> DataFrame:
    """(id, passes): how often a node lies inside the search trees of up to ``samples`` sources, ids in order.

    All trees grow together, level by level: what the last level's (source, node) rows reach and hasn't been reached hangs from
    the neighbour that a search would have come to first, that of the least path. Then numbers of descendants are summed up the
    trees, the deepest level first; a node lies inside the paths to all its descendants. No part of the graph goes to the driver.
    """
    hops = settled(both_ways(edges.where("source_id != target_id")).select("node", "other").distinct())
    sources = hops.select("node").distinct().orderBy("node").limit(samples)
    last = sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path"))
    reached, grown = last.select("source", "node"), []
    while True:
        step = last.join(hops, "node").groupBy("source", F.col("other").alias("node")).agg(F.min("path").alias("path"))
        new = settled(step.join(reached, ["source", "node"], "left_anti").withColumn("path", F.concat("path", F.array("node"))))
        if new.isEmpty():
            break
        grown.append(new.select("source", "node", F.element_at("path", -2).alias("parent")))
        last = new
        reached = reached.unionByName(new.select("source", "node"))
    counted: list[DataFrame] = []
    below: DataFrame | None = None
    for level in reversed(grown):
        if below is None:
            own = level.withColumn("descendants", F.lit(0).cast("long"))
        else:
            under = below.groupBy("source", F.col("parent").alias("node")).agg(F.sum(F.col("descendants") + 1).alias("descendants"))
            own = level.join(under, ["source", "node"], "left").withColumn("descendants", F.coalesce("descendants", F.lit(0)))
            own = settled(own.select("source", "node", "parent", "descendants"))
        counted.append(own.where("descendants > 0").select(F.col("node").alias("id"), "descendants"))
        below = own
    if not counted:
        return hops.select(F.col("node").alias("id"), F.lit(0).cast("long").alias("passes")).limit(0)
    return reduce(DataFrame.unionByName, counted).groupBy("id").agg(F.sum("descendants").alias("passes"))


def centrality(edges: DataFrame, samples: int = 500) -> DataFrame:
    degree, between = degree_centrality(edges), betweenness(edges, samples)
    joined = degree.join(between, "id", "left").withColumn("passes", F.coalesce("passes", F.lit(0)))
    top = joined.agg(F.greatest(F.max("passes"), F.lit(1)).alias("most"))
    return joined.crossJoin(F.broadcast(top)).select("id", "degree", "passes", (0.7 * F.col("centrality") + 0.3 * F.col("passes") / F.col("most")).alias("score"))


def merge_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one type and title become the first of them by id; edges follow, and loops go."""
    key = F.struct("type", F.trim(F.lower("title")).alias("t"))
    first = nodes.groupBy(key.alias("k")).agg(F.min("id").alias("kept"))
    mapping = nodes.select("id", key.alias("k")).join(first, "k").select("id", "kept")
    kept = nodes.join(mapping.where("id = kept").select("id"), "id", "left_semi")
    a, b = mapping.select(F.col("id").alias("source_id"), F.col("kept").alias("s")), mapping.select(F.col("id").alias("target_id"), F.col("kept").alias("t"))
    moved = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    moved = moved.withColumns({"source_id": F.coalesce("s", "source_id"), "target_id": F.coalesce("t", "target_id")}).drop("s", "t")
    return kept, moved.where("source_id != target_id")


def prune_by_rank(edges: DataFrame, least: float = 0.3, most: int = 50) -> DataFrame:
    """Edges of weight ``least`` or more that are among the ``most`` heaviest of both their ends. A parallel stand-in for prune_greedy."""
    strong = edges.where(F.col("weight") >= least)
    ranks = both_ways(strong).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "id")))
    kept = ranks.where(F.col("r") <= most).groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select("id")
    return strong.join(kept, "id", "left_semi")


def prune_greedy(edges: DataFrame, least: float = 0.3, most: int = 50) -> DataFrame:
    """Edges from the heaviest on while both ends have fewer than ``most``, in parallel rounds with the sequential result.

    An edge surely stays if, at both ends, fewer than ``most`` edges before it have been kept or are undecided; it surely
    goes if ``most`` before it at one end have been kept. Each round decides the heaviest undecided edge at least. A kept edge
    takes no part any more once no undecided edge follows it at either end.
    """
    state = settled(edges.where(F.col("weight") >= least).withColumn("kept_", F.lit(0)))
    done: list[DataFrame] = []
    while True:
        order = Window.partitionBy("node").orderBy(F.desc("weight"), "id")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        last = F.max(F.when(F.col("kept_") == 0, F.struct((-F.col("weight")).alias("w"), "id"))).over(Window.partitionBy("node"))
        follows = F.coalesce(last > F.struct((-F.col("weight")).alias("w"), "id"), F.lit(False))
        seen = both_ways(state).select("id", "kept_", count(F.col("kept_")).alias("held"), count(F.lit(1)).alias("ahead"), follows.alias("follows"))
        by_edge = seen.groupBy("id").agg(F.max("held").alias("held_"), F.max("ahead").alias("ahead_"), F.max("follows").alias("follows_"))
        joined = state.join(by_edge, "id").where((F.col("kept_") == 1) | (F.col("held_") < most))
        decided = settled(joined.withColumn("kept_", F.when(F.col("ahead_") < most, 1).otherwise(F.col("kept_"))).drop("held_", "ahead_"))
        state = decided.where("kept_ = 0 OR follows_").drop("follows_")
        done.append(decided.where("kept_ = 1 AND NOT follows_").drop("kept_", "follows_"))
        if state.where("kept_ = 0").isEmpty():
            return reduce(DataFrame.unionByName, done, state.drop("kept_"))
