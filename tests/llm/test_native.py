"""Operators 1 to 5 against plain Python on small tables with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, license_scan, mixing, quality_rules, sharding

SCHEMA = "doc_id long, text string, source string, size int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet the of and " * 3000
ROWS = [
    (1, "Alpha beta gamma.\nAlpha beta gamma.\n\nx # $", "a", 9, "old"),
    (2, "ALPHA beta gamma.\nalpha BETA gamma.\n\nx # $", "b", 9, "old"),
    (3, None, "a", None, None),
    (4, "", None, 1, "x"),
    (5, LONG, "c", 1, "x"),
    (5, LONG, "c", 1, "x"),
    (None, "no id Éà", "b", 1, "x"),
    (7, "no id Éà", "b", 1, "x"),
    (8, "no id éà", "b", 1, "x"),
    (9, "one two three one two three four one two three " * 12, "a", 2, "x"),
    (10, "\t\x0b word joined \x1c end", "a", 2, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def collected(df):
    return [r.asDict() for r in df.collect()]


# ---- 1


def test_shards_and_slots(docs):
    found = collected(sharding.assign_shards(docs, 16))
    assert len(found) == len(ROWS)
    by = collections.defaultdict(list)
    for r in found:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.assign_shards(empty, 16).count() == 0
    assert exact_dedup.dedup(empty).count() == 0
    assert quality_rules.apply_rules(empty).count() == 0
    documents, spans = mixing.mix(empty)
    assert documents.count() == 0 and spans.count() == 0


def test_weights_move_only_their_subtree(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.layout(16)
    heavier = [leaf._replace(weight=2.0) if leaf.shard == 5 else leaf for leaf in tree]
    both = sharding.with_shard(sharding.with_shard(keys, tree, "doc_id", "s"), heavier, "doc_id", "t")
    region = F.floor(F.col("t") / 4)
    moved = both.where("s != t")
    assert moved.count() > 0
    # a row that moves comes into the region that grew, or moves inside it
    assert moved.where(region != 1).count() == 0
    counts = [r["count"] for r in both.groupBy("s").count().collect()]
    assert max(counts) < 1.4 * 250 and min(counts) > 0.6 * 250


def test_growth_takes_rows_only_into_the_new_shard(spark):
    keys = spark.range(1500).withColumnRenamed("id", "doc_id")
    founded = (1, 2, 3, 5, 8, 13, 16, 20)
    for n in founded:
        for more in range(5):
            keys = sharding.with_shard(keys, sharding.layout(n + more, founded=n), "doc_id", f"s{n}_{more}")
    rows = collected(keys)
    for n in founded:
        for more in range(4):
            moved = [r for r in rows if r[f"s{n}_{more}"] != r[f"s{n}_{more + 1}"]]
            assert moved and all(r[f"s{n}_{more + 1}"] == n + more for r in moved)
            share = 1500 / (n + more + 1)
            assert abs(len(moved) - share) < 6 * share**0.5


def test_the_tree_decides(spark):
    """Other regions and racks over the same shards deal the rows otherwise; a rack's weight decides its share."""
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    flat = [leaf._replace(region="r", rack="k") for leaf in sharding.layout(16)]
    both = sharding.with_shard(sharding.with_shard(keys, sharding.layout(16), "doc_id", "s"), flat, "doc_id", "t")
    assert both.where("s != t").count() > 2000
    uneven = [leaf._replace(weight=3.0 if leaf.rack == "k0" else 1.0) for leaf in sharding.layout(8)]
    shares = {r["s"]: r["count"] for r in sharding.with_shard(keys, uneven, "doc_id", "s").groupBy("s").count().collect()}
    assert abs(shares[0] + shares[1] - 3000 * 6 / 12) < 160


def test_shards_by_brute_force(spark):
    """The descent, level by level, in plain Python from the draws of the nodes on the way."""
    tree = [leaf._replace(weight=1.0 + leaf.shard % 3) for leaf in sharding.layout(11, founded=9)] + [sharding.Leaf("r0", "k0", 99, 0.0)]
    keys = spark.range(400).withColumnRenamed("id", "doc_id")
    held = [x for x in tree if x.weight > 0]
    names = {f"region:{x.region}" for x in held} | {f"rack:{x.region}:{x.rack}" for x in held} | {f"shard:{x.region}:{x.rack}:{x.shard}" for x in held}
    hashes = {r["doc_id"]: r for r in collected(keys.select("doc_id", *[F.xxhash64("doc_id", F.lit(n), F.lit(0)).alias(n) for n in names]))}
    for r in collected(sharding.with_shard(keys, tree, "doc_id", "s")):

        def draw(name, weight):
            u = (((hashes[r["doc_id"]][name] % (1 << 64)) >> 11) + 0.5) / (1 << 53)
            return -math.log(u) / weight

        weight = lambda **of: sum(x.weight for x in held if all(getattr(x, k) == v for k, v in of.items()))
        region = min({x.region for x in held}, key=lambda n: draw(f"region:{n}", weight(region=n)))
        rack = min({x.rack for x in held if x.region == region}, key=lambda n: draw(f"rack:{region}:{n}", weight(region=region, rack=n)))
        assert r["s"] == min((x for x in held if (x.region, x.rack) == (region, rack)), key=lambda x: draw(f"shard:{region}:{rack}:{x.shard}", x.weight)).shard


# ---- 3


def expected_rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(docs):
    for r in collected(quality_rules.apply_rules(docs)):
        n, chars, symbols, dup, rep = expected_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_repeats_beyond_the_position_bits(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 3)
    texts = ["a b c d a b c e f g h i j k a b c", "x y z " * 9, "p q r s t u v w x y z a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in collected(quality_rules.measure(df)):
        assert r["n_repeat_words"] == expected_rules(r["text"])[4]


def test_threshold_rows_are_what_rejects(spark):
    good = " ".join(f"the{i} word of {i} and then some" for i in range(20))
    df = spark.createDataFrame([(1, good), (2, good.replace("word", "w### $$$ %%"))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in collected(quality_rules.apply_rules(df))}
    assert found[1]["kept"] and not found[2]["kept"] and "symbols to words" in found[2]["failed_rules"]


# ---- 4


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_dedup(found, rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    for r in found:
        ids = groups[lowered(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(lowered(r["text"]).encode()).hexdigest()


def test_dedup(docs):
    found = collected(exact_dedup.dedup(docs))
    assert len(found) == len(ROWS)
    check_dedup(found, ROWS)


def test_bytes_decide_when_digests_clash(docs):
    weak = lambda text: F.lpad(F.hex(F.pmod(F.length(text), F.lit(3))), 64, "0")
    check_dedup(collected(exact_dedup.dedup(docs, digest=weak)), ROWS)


def test_large_groups(spark):
    rows = [(i, "copy" if i % 3 else f"own {i // 6}") for i in range(300)]
    check_dedup(collected(exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a", "x"), (2, "A", "y"), (2, "a", "y"), (2, "a", "y"), (2, "b", "z"), (None, "c", "p"), (None, "c", "q"), (7, None, "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key_ string")
    found = sorted([tuple(r) for r in exact_dedup.without_copies(df).collect()], key=str)
    assert len(found) == 4
    assert [(r[0], (r[1] or "").lower()) for r in found] == [(2, "a"), (2, "b"), (8, ""), (None, "c")]
    check = {(r["doc_id"], r["text"]): r for r in collected(exact_dedup.decisions(df.select("doc_id", "text")).join(df, "doc_id"))}
    assert check[(1, "a")]["kept"] is False


def test_compaction_shuffles_only_what_runs_may_share(spark):
    index = exact_dedup.MergeIndex(spark, fanout=4)
    for k in range(3):
        index.flush(spark.range(100).select(F.unhex(F.sha2(F.concat(F.lit(str(k if k < 2 else 0)), F.col("id").cast("string")), 256)).alias("digest"), (F.col("id") + 1000 * k).alias("ident"), F.lit(1).cast("long").alias("n")))
    first = index.levels[0]
    assert index._contested(first[1], [first[0], first[2]]).where("contested_").count() < 20
    assert index._contested(first[0], [first[1], first[2]]).where("contested_").count() == 100
    merged = collected(index.compact())
    assert len(merged) == 200 and sum(r["n"] for r in merged) == 300 and all(r["ident"] < 1100 for r in merged)


def test_index_levels(spark):
    index = exact_dedup.MergeIndex(spark, fanout=2)
    for lot in ([("a", 3), ("b", 1)], [("a", 2)], [("c", 9), ("b", 5)]):
        index.flush(spark.createDataFrame([(f"{ord(d):02x}{d}", i, 1) for d, i in lot], "digest string, ident long, n long"))
    assert {r["ident"] for r in index.lookup(["61a"]).collect()} == {3, 2}
    assert {(r["digest"][2:], r["ident"], r["n"]) for r in index.compact().collect()} == {("a", 2, 2), ("b", 1, 2), ("c", 9, 1)}


# ---- 5


def test_mix(docs):
    documents, spans = mixing.mix(docs, block=8)
    found = collected(mixing.taken_words(documents, spans))
    assert len(found) == len(ROWS)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in found)
    assert all(abs(taken[s] - target[s]) <= 8 for s in sizes)
    again = collected(mixing.taken_words(*mixing.mix(docs, block=8)))
    key = lambda r: (str(r["key_"]), r["start_"], r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_targets_against_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 3, "d": 90, None: 40, "z": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        parts = sum(weight[s] for s in order if s not in full)
        now = {s: 2 * sizes[s] if s in full else rest * weight[s] / parts for s in order}
        over = {s for s in order if s not in full and now[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    assert all(found[s] == pytest.approx(now[s]) for s in order)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 101])
def test_permutation_is_a_bijection(spark, n):
    key = F.xxhash64(F.lit("source"))
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), key).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == list(range(n))


def brute_mix(rows, block, out_shards, seed, spark):
    """(taken words by row, shard counts) in plain Python, from the rows' places in their streams and the two permutations."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    blocks = {s: -(-by[s][0]["source_size"] // block) for s in order}
    # Spark rounds halves up
    slots = {s: math.floor(by[s][0]["target"] / by[s][0]["source_size"] * blocks[s] + 0.5) if by[s][0]["source_size"] else 0 for s in order}
    total = sum(slots.values())
    length = max(1, -(-total // out_shards))
    key = F.xxhash64(F.lit("shards"), F.lit(seed))
    places = [r["p"] for r in spark.range(total).select(mixing.permuted(F.col("id"), F.lit(total).cast("long"), key).alias("p")).collect()]
    counts, at, taken = collections.Counter(), 0, collections.Counter()
    for s in order:
        for j in range(slots[s]):
            counts[(places[at + j] // length, s)] += 1
        at += slots[s]
        if not slots[s]:
            continue
        name = F.xxhash64(F.lit("\x00null" if s is None else s), F.lit(seed))
        perm = [r["p"] for r in spark.range(blocks[s]).select(mixing.permuted(F.col("id"), F.lit(blocks[s]).cast("long"), name).alias("p")).collect()]
        for j in range(slots[s]):
            low = perm[j % blocks[s]] * block
            for r in by[s]:
                taken[r["row_"]] += max(0, min(r["start_"] + r["size"], low + block) - max(r["start_"], low))
    return taken, counts


def test_mix_by_brute_force(spark, docs):
    many = docs.unionByName(docs.where("size is null or size < 9")).unionByName(spark.createDataFrame([(None, f"word {i} of no id", "b", 1, "x") for i in range(9)], SCHEMA))
    documents, spans = mixing.mix(many, block=8, out_shards=5)
    rows = collected(mixing.taken_words(documents, spans))
    taken, counts = brute_mix(rows, 8, 5, 0, spark)
    assert {r["row_"]: r["taken"] for r in rows if r["taken"]} == {k: v for k, v in taken.items() if v}
    assert {(r["out_shard"], r["source"]): r["n_blocks"] for r in collected(mixing.shard_counts(spans))} == dict(counts)
    lengths = collections.Counter()
    for (shard, _), n in counts.items():
        lengths[shard] += n
    assert len({lengths[i] for i in range(4)}) == 1 and lengths[4] <= lengths[0]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["start_"], r["size"]))
    for stretches in by.values():
        at = 0
        for start, size in sorted(stretches):
            assert start == at or size == 0
            at += size


def test_mixed_texts_are_the_words_of_their_documents(spark, docs):
    """Repeated rows and null ids have their own pieces: the words of all pieces are the words taken."""
    clashing = docs.withColumns({"n": F.monotonically_increasing_id(), "n_words": F.lit("y"), "word_from": F.lit("z"), "row_": F.lit("r"), "mix_row_": F.lit("m"), "key_": F.lit("k")})
    found = collected(mixing.mixed_documents(clashing, block=8))
    words = {r["n"]: WORD.findall(r["text"] or "") for r in collected(clashing)}
    for r in found:
        assert (r["n_words"], r["word_from"], r["row_"], r["mix_row_"], r["key_"]) == ("y", "z", "r", "m", "k")
        assert " ".join(r["text"].split(" ")) in " ".join(words[r["n"]])
    pieces, taken = collections.Counter(), collections.Counter()
    for r in found:
        pieces[r["doc_id"], r["source"]] += len(r["text"].split(" "))
    for r in collected(mixing.taken_words(*mixing.mix(docs, block=8))):
        taken[r["key_"], r["source"]] += r["taken"]
    assert pieces == {k: v for k, v in taken.items() if v}
    assert sum(pieces.values()) == sum(taken.values())


# ---- 2


def test_licenses(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "p/LICENSE", mit),
        (2, "p/q/r/code.py", "x = 1"),
        (3, "p/q/other.py", "# Licensed under the Apache License, Version 2.0.\n" + "y = 2\n" * 40),
        (4, "z/free.py", "nothing here"),
        (5, None, "nothing either"),
        (6, "p/q/r/s/COPYING", "This work is licensed under the GNU General Public License, version 3. " * 2),
        (7, "p/q/r/s/t/deep.py", None),
        (8, "top.py", "licence of my own making, with words that no template has"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: r for r in collected(license_scan.scan(df))}
    assert found[1]["license"] == "MIT" and found[1]["is_license_file"]
    assert (found[2]["license"], found[2]["inherited_from"]) == ("MIT", "p/LICENSE")
    assert found[3]["license"] == "Apache-2.0" and not found[3]["is_license_file"]
    assert found[4]["license"] is None and found[5]["license"] is None and found[8]["license"] is None
    assert (found[7]["license"], found[7]["inherited_from"]) == ("GPL-3.0", "p/q/r/s/COPYING")


def test_license_cosine_by_hand(spark):
    names, idf, vectors, unseen = license_scan.template_vectors()
    text = "this file is licensed under the mit license, licensed to all"
    counts = collections.Counter(re.findall(r"[a-z0-9]+", text))
    weights = {t: n * idf.get(t, unseen) for t, n in counts.items()}
    norm = sum(x * x for x in weights.values()) ** 0.5
    cosines = [sum(weights.get(t, 0) * x for t, x in v.items()) / norm for v in vectors]
    df = spark.createDataFrame([(1, "a/b", text)], "doc_id long, path string, text string")
    row = license_scan.own_licenses(df, least=0.0).first()
    assert row["own_score"] == pytest.approx(max(cosines)) and row["own_license"] == names[cosines.index(max(cosines))]


LICENSE_LINES = {
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This library is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 License.": "CC-BY-3.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0 OR MIT",
    "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy is missing, see the site.": "MPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
    "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.": "GPL-2.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_license_versions_tags_and_joined_lines(spark):
    code = "\n\n" + "x = 1\n" * 60
    df = spark.createDataFrame([(i, f"d{i}/code.py", line + code) for i, line in enumerate(LICENSE_LINES)], "doc_id long, path string, text string")
    found = {r["doc_id"]: r["own_license"] for r in collected(license_scan.scan(df))}
    assert [found[i] for i in range(len(LICENSE_LINES))] == list(LICENSE_LINES.values())


def test_whole_licence_bodies(spark):
    bodies = license_scan.bodies()
    rows = [(i, f"d{i}/1", "Copyright (c) 2020 Some Person\n\n" + texts[0].replace("\n", "\r\n" if i % 2 else "\n")) for i, texts in enumerate(bodies.values())]
    prose = "The copyright of this story and of the songs in it is held by the singer, and the license to sing is not to be had. " * 40
    rows += [(100, "d0/2", "x = 1"), (101, "p/1", prose), (102, "d3/2", "y = 2")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: r for r in collected(license_scan.scan(df))}
    assert [found[i]["own_license"] for i in range(len(bodies))] == list(bodies)
    assert all(found[i]["is_license_file"] for i in range(len(bodies)))
    assert found[100]["license"] == list(bodies)[0] and found[102]["license"] == list(bodies)[3] and found[101]["license"] is None


# ---- 2, all of it once more in plain Python


def plain_vectors(templates):
    counts = [(name, collections.Counter(re.findall("[a-z0-9]+", t.lower()))) for name, texts in templates.items() for t in texts]
    df = collections.Counter(t for _, c in counts for t in c)
    idf = {t: math.log((len(counts) + 1) / (k + 1)) + 1 for t, k in df.items()}
    return counts, idf, math.log(len(counts) + 1) + 1


def plain_cosines(text, templates):
    counts, idf, unseen = plain_vectors(templates)
    own = collections.Counter(re.findall("[a-z0-9]+", text.lower()))
    norm = lambda c: math.sqrt(sum((k * idf.get(t, unseen)) ** 2 for t, k in c.items()))
    return [(sum(k * c[t] * idf[t] ** 2 for t, k in own.items() if t in c) / (norm(own) * norm(c)) if own else 0.0, name) for name, c in counts]


def plain_decision(name, said, text, body=False):
    s, whole = said.lower(), re.sub(r"\s+", " ", text.lower())
    found = re.search(license_scan.VERSION, s)
    version = f"-{found[1]}.{found[2] or 0}" if found else ""
    has = lambda pattern: re.search(pattern, s) is not None
    if body and not found and name.split("-")[0] in ("GPL", "LGPL", "AGPL", "Apache", "MPL", "EPL", "EUPL", "CDDL", "GFDL", "Artistic"):
        return name
    if name.split("-")[0] in ("GPL", "LGPL", "AGPL"):
        kind = "AGPL" if has(r"affero|\bagpl") else "LGPL" if has(r"lesser|library general|\blgpl") else "GPL"
        return kind + version
    if name.startswith("CC-BY"):
        if has(r"\bcc0\b|public domain"):
            return "CC0-1.0"
        parts = [short for pattern, short in ((r"non-?\s?commercial|\bnc\b", "-NC"), (r"share-?\s?alike|\bsa\b", "-SA"), (r"no-?\s?deriv|\bnd\b", "-ND")) if has(pattern)]
        number = re.search(r"\b([1-4]\.[05])\b", s)
        return "CC-BY" + "".join(parts) + (f"-{number[1]}" if number else "")
    if name.startswith("BSD-"):
        for clauses, pattern in ((2, r"2.clause|simplified|freebsd"), (3, r"3.clause|new bsd|modified bsd|revised bsd")):
            if has(pattern):
                return f"BSD-{clauses}-Clause"
        if has(r"4.clause|original bsd") or "all advertising materials" in whole:
            return "BSD-4-Clause"
        return "BSD-3-Clause" if "neither the name" in whole else "BSD-2-Clause" if "this software is provided by" in whole else name
    if name.split("-")[0] in ("Apache", "MPL", "EPL", "EUPL", "CDDL", "GFDL", "Artistic"):
        return name.split("-")[0] + version
    return name


def plain_own(text, path):
    """(licence, score) of a text, from all its sentences and its whole, none left out beforehand."""
    if not text:
        return None, None
    plain = re.sub(license_scan.MARKS, "", text)
    blocks = [re.sub(r"\s+", " ", b).strip() for b in re.split(r"\n\s*\n", plain)]
    sentences = re.split(license_scan.SENTENCE_END, text) + [x for b in blocks for x in re.split(license_scan.JOINED_END, b)]
    counts = plain_vectors(license_scan.TEMPLATES)[0]
    telling = {t for _, c in counts for t in c} - license_scan.EVERYDAY
    found = []
    for s in dict.fromkeys(sentences):
        tag = re.search(license_scan.SPDX, s)
        scores = plain_cosines(s, license_scan.TEMPLATES)
        top = max(x for x, _ in scores)
        at = next(i for i, (x, _) in enumerate(scores) if x == top)
        if tag:
            found.append((1.0, len(scores) + 1, s, tag[1]))
        elif top >= 0.6 and set(re.findall("[a-z0-9]+", s.lower())) & telling:
            found.append((top, at + 1, s, plain_decision(scores[at][1], s, text)))
    named = re.search(license_scan.FILE_NAME, path or "") is not None
    bodies = plain_cosines(text, license_scan.bodies())
    top, name = max(bodies, key=lambda x: x[0])
    if top >= (0.6 if named else 0.9):
        lines = [x for x in re.split(r"\r?\n", text) if x.strip() and not re.search(license_scan.OWNERS, x)]
        return plain_decision(name, " ".join(lines[: license_scan.TITLE_LINES]), text, True), top
    best = max(found, default=None)
    return (best[3], best[0]) if best else (None, None)


def test_license_results_by_plain_python(spark):
    chance, rows = random.Random(4), []
    sentences = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    for k in range(140):
        words = chance.choice(sentences).split()
        for _ in range(chance.randint(0, 7)):
            at = chance.randrange(len(words))
            words[at : at + chance.randint(0, 2)] = [chance.choice(["the", "house", "version", "2.0", "license", "GNU", "of", "all", "NonCommercial", "3"])] * chance.randint(0, 2)
            words = words or ["x"]
        text = " ".join(words)
        cut = chance.randrange(len(text))
        text = chance.choice([text, f"Some prose before. {text} And after that.", "# " + text[:cut].replace("\n", " ") + "\n# " + text[cut:], text[:cut] + "\n\n" + text[cut:]])
        rows.append((k, f"{chance.choice('ab')}/{chance.choice('cd')}/{chance.choice(['x.py', 'LICENSE', 'y'])}{k % 3 if chance.random() < 0.7 else ''}", text))
    for k, (name, (body,)) in enumerate(license_scan.bodies().items()):
        owners = "Copyright (c) 2020 Somebody\n" * 30 + "All rights reserved.\n\n"
        rows.append((200 + k, f"z/{name}/{chance.choice(['COPYING', 'text'])}", owners + body))
    rows += [(300, None, sentences[0]), (301, "a/c/none", None), (302, "a/q/plain.txt", "just some prose of no licence"), (303, "a/q/e/deep.txt", ""), (304, "top", "SPDX-License-Identifier: (MIT OR Apache-2.0)")]
    own = {k: plain_own(text, path) for k, path, text in rows}
    found = {r["doc_id"]: r for r in collected(license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)))}
    for k, path, text in rows:
        name, score = own[k]
        r = found[k]
        assert (r["own_license"], r["own_score"]) == (name, score if score is None else pytest.approx(score)), (text, r)
        if name is None and path is not None:
            holders = {}
            for q in found.values():
                if q["is_license_file"] and q["path"] is not None:
                    folder = q["path"].rpartition("/")[0]
                    holders[folder] = min(holders.get(folder, (q["path"], q["own_license"])), (q["path"], q["own_license"]))
            folder = path.rpartition("/")[0]
            while folder and folder not in holders:
                folder = folder.rpartition("/")[0]
            held = holders.get(folder)
            assert (r["license"], r["inherited_from"]) == ((held[1], held[0]) if held else (None, None))
        else:
            assert r["license"] == name and r["inherited_from"] is None
    assert sum(name is not None for name, _ in own.values()) > 100
