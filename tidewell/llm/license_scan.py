"""License scans: TF-IDF cosine of header sentences and whole texts to templates, then inheritance down the directories.

Sentences are taken line by line and from blocks joined over their lines, comment marks removed; each is a sparse TF-IDF vector
whose best template is that of the largest cosine, if the cosine reaches ``least``. A whole text is compared with whole licence
bodies too, and is that licence from ``least_body`` on (from ``least`` on if it has a licence file's name). A sentence
or text that has none of the terms without which no template is near enough (``needed_terms``) is compared with none. SPDX tags count as they stand. Versions and variants whose templates differ by a word or two
(GPL, CC BY, BSD, ...) are decided by what the sentence or the body's title says; where it names no version, none is reported.
A file that is a licence body, whose licence sentences make up most of it, or which has a licence file's name, is its
directory's licence file. A file without a licence of its own takes that of the licence file in its nearest ancestor
directory, found by joining the distinct directories' ancestors with the directories of licence files.

Defined cases: null and empty texts have no licence of their own; a null path has no directory and inherits nothing; of several
licence files of a directory the least path counts, of equal paths the least licence; texts of any length are read whole; of
templates with equal cosines the first in order counts, of a text's licences with equal scores the last template's; repeated rows
are scanned one by one; an empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import let, stored, temp_name

#: Template sentences by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Released under the MIT License.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Simplified BSD License."],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License, version 2.",
        "Licensed under the GPL v2.",
        "Released under the GPL-2.0 license.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL v2.1.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License, version 3.",
        "Licensed under the AGPL v3.",
    ],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.", "Licensed under the GNU Free Documentation License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Licensed under the MPL 2.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL, Version 1.2 or later."],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License, version 1.0.", "Licensed under the CDDL 1.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "ISC License.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the BSD Zero Clause License."],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "Licensed under the zlib License.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License, Version 1.0."],
    "Artistic-2.0": ["Licensed under the Artistic License, version 2.0.", "The Artistic License 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense license."],
    "WTFPL": ["Licensed under the WTFPL, the Do What The Fuck You Want To Public License."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "Licensed under CC0 1.0 Universal (Creative Commons Public Domain Dedication).",
    ],
    **{
        f"CC-BY-{short}-4.0": [f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License.", f"Licensed under CC BY-{short} 4.0."]
        for short, long in {"SA": "ShareAlike", "ND": "NoDerivatives", "NC-SA": "NonCommercial-ShareAlike", "NC-ND": "NonCommercial-NoDerivatives"}.items()
    },
}
TEMPLATES["MIT"] += [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
    "Licensed under the MIT License.",
]
TEMPLATES["GPL-3.0"] += ["GNU General Public License, version 3.", "Licensed under the GPL v3."]
BODIES = Path(__file__).parent / "licenses"
TOKEN = r"[a-z0-9]+"
#: Words that don't tell a licence from other texts: they count in cosines, but alone they make no licence.
EVERYDAY = frozenset(
    "a all an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its "
    "like made many may more most must no not of on one only or other our out over she should so some such than that the their "
    "them then there these they this those to under up was way we were what when where which who will with would you your".split()
)
SENTENCE_END = r"\n|(?<=[.!?])\s+"
#: Ends of sentences in a joined block; "v. 2.0" is none.
JOINED_END = r"(?<![vV]\.)(?<=[.!?])\s+"
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/|//+|#+|\*+|;+|--+|%+|<!--+)?[ \t]*|[ \t]*(?:\*+/|--+>)?[ \t]*\r?$"
SPDX = r"(?i)SPDX-License-Identifier:\s*(\(*[a-z0-9][a-z0-9.+:-]*\)*(?:\s+(?:AND|OR|WITH)\s+\(*[a-z0-9][a-z0-9.+:-]*\)*)*)"
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying)(?:\.[a-z]+)?$"
#: Lines that make up a body's title: its first that aren't blank and don't say whose work it is.
TITLE_LINES = 4
OWNERS = r"(?i)^[\s*#/;%!<>-]*(?:(?:portions|parts)\b.{0,80}?)?(?:copyright\b|copr\.|\(c\)|\u00a9|all rights reserved|authors?\s*:|written by\b)"
VERSION = r"(?:version|gpl|fdl|mpl|epl|eupl|cddl|artistic|apache|licen[cs]e|\bv)[\s,.(-]*(?:version\s*)?v?([0-9])(?:\.([0-9]))?(?![0-9])"


@cache
def bodies() -> dict[str, list[str]]:
    """Whole licences by SPDX identifier."""
    return {p.stem: [p.read_text()] for p in sorted(BODIES.glob("*.txt"))}


def template_vectors(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[str], dict[str, float], list[dict[str, float]], float]:
    """(licence of each template, idf by term, unit vectors, idf of terms that no template has)."""
    names = [name for name, texts in templates.items() for _ in texts]
    counts = [Counter(re.findall(TOKEN, text.lower())) for texts in templates.values() for text in texts]
    n = len(counts)
    df = Counter(term for c in counts for term in c)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    vectors = []
    for c in counts:
        v = {t: k * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    return names, idf, vectors, math.log(n + 1) + 1


def needed_terms(templates: dict[str, list[str]], least: float) -> list[list[list[str]]]:
    """For each template groups of its terms, everyday words left out: a text is compared only if, for some template, it has
    a term of each group.

    A text that lacks some of a template's terms has at most the norm of the template's other weights as cosine. Each group,
    the heaviest terms first, is so heavy that the norm of the others is below ``least``, so a text without it can't reach
    that. A template whose other words are too light has them all as its group: everyday words alone don't make a licence.
    """
    out = []
    for vector in template_vectors(templates)[2]:
        groups: list[list[str]] = [[]]
        held = 0.0
        for term in sorted((t for t in vector if t not in EVERYDAY), key=lambda t: (-vector[t], t)):
            groups[-1].append(term)
            held += vector[term] ** 2
            if held > 1 - (least - 1e-9) ** 2:
                groups.append([])
                held = 0.0
        out.append([sorted(g) for g in groups[: max(1, len(groups) - 1)]])
    return out


def needed(templates: dict[str, list[str]], least: float) -> str:
    """A pattern for texts that have a term of the first group of some template."""
    return any_of(sorted({t for groups in needed_terms(templates, least) for t in groups[0]}))


def has_needed(text: Column, templates: dict[str, list[str]], least: float) -> Column:
    """Whether a text has a term of each group of some template."""
    literal = lambda terms: F.array(*[F.lit(t) for t in terms])
    each = lambda tokens, groups: reduce(Column.__and__, [F.arrays_overlap(tokens, literal(g)) for g in groups])
    some = lambda tokens: reduce(Column.__or__, [each(tokens, groups) for groups in needed_terms(templates, least)])
    terms = any_of(sorted({t for groups in needed_terms(templates, least) for g in groups for t in g}))
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(terms), F.lit(0))), F.lower)
    return let(found, some)


def may_reach(text: Column, templates: dict[str, list[str]], least: float) -> Column:
    """Whether the known tokens of a text can make up enough of its vector: the squares of k known tokens' weights are at most
    the square of k times the largest, those of the others at least as many times the weight of one."""
    _, idf, _, unseen = template_vectors(templates)
    known, bound = F.regexp_count(text, F.lit(any_of(sorted(idf)))).cast("double"), (least - 1e-9) ** 2
    other = F.regexp_count(text, F.lit(f"(?i){TOKEN}")) - known
    enough = known * known * (max(idf.values()) ** 2 * (1 - bound)) >= other * (unseen**2 * bound)
    return enough | text.rlike("[\u0130\u212a]")  # the two other characters that lower-case to a-z


def any_of(terms: list[str]) -> str:
    """A pattern that finds any of the terms as a whole one; a tree of their letters, so that each place is read once."""
    tree: dict = {}
    for term in terms:
        at = tree
        for letter in term:
            at = at.setdefault(letter, {})
        at[""] = {}

    def written(at: dict) -> str:
        branches = [letter + written(below) for letter, below in sorted(at.items()) if letter]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{joined})?" if "" in at else joined

    return r"(?i:(?<![a-z0-9])(?:" + written(tree) + r")(?![a-z0-9]))"


def _best(sentence: Column, templates: dict[str, list[str]]) -> Column:
    """structure (score, at): the largest cosine of a sentence and the place of its template."""
    names, idf, vectors, unseen = template_vectors(templates)
    # a map is searched entry by entry, so terms are dealt into as many small maps as there are terms
    slots = max(1, len(idf))
    weights, rarity = [{} for _ in range(slots)], [{} for _ in range(slots)]
    for t in idf:
        at = zlib.crc32(t.encode()) % slots
        weights[at][t] = [round(idf[t] * v[t], 12) if t in v else 0 for v in vectors]
        rarity[at][t] = idf[t]
    table = F.from_json(F.lit(json.dumps(weights)), "array<map<string,array<double>>>")
    idfs = F.from_json(F.lit(json.dumps(rarity)), "array<map<string,double>>")
    slot = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(slots)).cast("int")
    zeros = F.array(*[F.lit(0.0)] * len(names))

    def scored(tokens: Column) -> Column:
        dots = F.aggregate(tokens, zeros, lambda acc, t: let(F.get(table, slot(t))[t], lambda w: F.when(w.isNull(), acc).otherwise(F.zip_with(acc, w, lambda a, b: a + b))))
        # a token's count is the length of its run in the sorted tokens; the squared norm sums the squared weights of runs
        start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        weight = lambda acc: F.pow(acc["run"] * F.coalesce(F.get(idfs, slot(acc["t"]))[acc["t"]], F.lit(unseen)), F.lit(2.0))
        step = lambda acc, t: F.when(
            acc["t"] == t, F.struct(acc["t"].alias("t"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))
        ).otherwise(F.struct(t.alias("t"), F.lit(1.0).alias("run"), (acc["sum"] + weight(acc)).alias("sum")))
        norm = F.aggregate(F.sort_array(tokens), start, step, lambda acc: F.sqrt(acc["sum"] + weight(acc)))
        return let(
            F.struct(dots.alias("dots"), norm.alias("norm")),
            lambda x: let(
                F.array_max(x["dots"]),
                lambda top: F.struct(F.when(x["norm"] > 0, top / x["norm"]).otherwise(0.0).alias("score"), F.array_position(x["dots"], top).cast("int").alias("at")),
            ),
        )

    return let(F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN), F.lit(0)), scored)


def _decided(name: Column, said: Column, text: Column, body: bool = False) -> Column:
    """The version and variant that ``said`` (a sentence or a body's title) names, within the best template's family.

    A body whose title names no version keeps that of its template, since the whole text tells.
    """
    s = F.lower(said)
    major, minor = F.regexp_extract(s, VERSION, 1), F.regexp_extract(s, VERSION, 2)
    version = F.when(major == "", "").otherwise(F.concat(F.lit("-"), major, F.lit("."), F.when(minor == "", "0").otherwise(minor)))
    gnu = F.when(s.rlike(r"affero|\bagpl"), "AGPL").when(s.rlike(r"lesser|library general|\blgpl"), "LGPL").otherwise("GPL")
    part = lambda pattern, short: F.when(s.rlike(pattern), short).otherwise("")
    cc = F.concat(F.lit("CC-BY"), part(r"non-?\s?commercial|\bnc\b", "-NC"), part(r"share-?\s?alike|\bsa\b", "-SA"), part(r"no-?\s?deriv|\bnd\b", "-ND"))
    number = F.regexp_extract(s, r"\b([1-4]\.[05])\b", 1)
    whole = F.regexp_replace(F.lower(text), r"\s+", " ")
    bsd = (
        F.when(s.rlike(r"2.clause|simplified|freebsd"), "BSD-2-Clause")
        .when(s.rlike(r"3.clause|new bsd|modified bsd|revised bsd"), "BSD-3-Clause")
        .when(s.rlike(r"4.clause|original bsd") | whole.contains("all advertising materials"), "BSD-4-Clause")
        .when(whole.contains("neither the name"), "BSD-3-Clause")
        .when(whole.contains("this software is provided by"), "BSD-2-Clause")
        .otherwise(name)
    )
    versioned = "^(?:[AL]?GPL|Apache|MPL|EPL|EUPL|CDDL|GFDL|Artistic)-"
    return (
        F.when(F.lit(body) & name.rlike(versioned) & (major == ""), name)
        .when(name.rlike("^[AL]?GPL-"), F.concat(gnu, version))
        .when(name.startswith("CC-BY") & s.rlike(r"\bcc0\b|public domain"), "CC0-1.0")
        .when(name.startswith("CC-BY"), F.concat(cc, F.when(number == "", "").otherwise(F.concat(F.lit("-"), number))))
        .when(name.rlike("^BSD-"), bsd)
        .when(name.rlike(versioned), F.concat(F.regexp_extract(name, "^[A-Za-z]+", 0), version))
        .otherwise(name)
    )


def own_licenses(
    df: DataFrame, text: str = "text", path: str = "path", least: float = 0.6, templates: dict[str, list[str]] = TEMPLATES, whole: dict[str, list[str]] | None = None, least_body: float = 0.9
) -> DataFrame:
    """Adds own_license, own_score, header (the sentence, or a body's first line) and is_license_file."""
    t, whole = F.col(text), bodies() if whole is None else whole
    literal = lambda of: F.array(*[F.lit(n) for n in template_vectors(of)[0]])
    names, body_names = literal(templates), literal(whole)
    in_sentence = needed(templates, least) + "|" + SPDX
    speaks = lambda parts: F.filter(parts, lambda s: s.rlike(in_sentence))
    plain = F.regexp_replace(t, MARKS, "")
    blocks = F.transform(speaks(F.split(plain, r"\n\s*\n", -1)), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    lines = speaks(F.split(t, SENTENCE_END, -1))
    joined = speaks(F.flatten(F.transform(blocks, lambda b: F.split(b, JOINED_END, -1))))

    last = len(template_vectors(templates)[0])

    def score(s: Column) -> Column:
        tag = F.regexp_extract(s, SPDX, 1)
        tagged = F.struct(F.lit(1.0).alias("score"), F.lit(last + 1).alias("at"), s.alias("header"), tag.alias("name"))
        by_template = let(_best(s, templates), lambda b: F.struct(b["score"].alias("score"), b["at"].alias("at"), s.alias("header"), _decided(F.get(names, b["at"] - 1), s, t).alias("name")))
        return F.when(tag != "", tagged).when(may_reach(s, templates, least), by_template)

    sentences = F.array_distinct(F.concat(lines, joined))
    good = F.filter(F.transform(sentences, score), lambda x: x["score"] >= least)
    first = F.regexp_extract(t, r"[^\s][^\r\n]*", 0)
    file_name = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False))
    enough = F.when(file_name, least).otherwise(least_body)
    title = F.array_join(F.slice(F.filter(F.split(t, r"\r?\n"), lambda x: x.rlike(r"\S") & ~x.rlike(OWNERS)), 1, TITLE_LINES), " ")
    named = lambda b: _decided(F.get(body_names, b["at"] - 1), title, t, body=True)
    body = let(_best(t, whole), lambda b: F.when(b["score"] >= enough, F.struct(b["score"].alias("score"), b["at"].alias("at"), first.alias("header"), named(b).alias("name"))))
    columns = df.columns
    own, whole_, best = (temp_name(df, n) for n in ("licenses_", "body_", "best_"))
    said = file_name | (t.rlike(needed(whole, least_body)) & has_needed(t, whole, least_body))
    df = df.withColumns({own: F.when(t.rlike(in_sentence), good), whole_: F.when(said, body)})
    df = df.withColumn(best, F.coalesce(whole_, F.array_max(own)))
    # a line that is a piece of a longer joined sentence counts once
    bare = lambda h: F.regexp_replace(h, MARKS, "")
    within = lambda x, y: (y["header"] != x["header"]) & (F.char_length(y["header"]) > F.char_length(bare(x["header"]))) & F.contains(y["header"], bare(x["header"]))
    alone = F.filter(own, lambda x: ~F.exists(own, lambda y: within(x, y)))
    part = F.aggregate(alone, F.lit(0), lambda a, x: a + F.char_length(x["header"])) / F.greatest(F.char_length(t), F.lit(1))
    return df.select(
        *columns,
        F.col(best)["name"].alias("own_license"),
        F.col(best)["score"].alias("own_score"),
        F.col(best)["header"].alias("header"),
        (F.col(best).isNotNull() & (F.col(whole_).isNotNull() | file_name | F.coalesce(part >= 0.5, F.lit(False)))).alias("is_license_file"),
    )


def scan(df: DataFrame, text: str = "text", path: str = "path", least: float = 0.6, templates: dict[str, list[str]] = TEMPLATES, keep_text: bool = True) -> DataFrame:
    """own_licenses with license and inherited_from (the licence file's path) added; own licences come first.

    The rows with their own licences (without the text, unless ``keep_text``) are stored once for the three reads that follow.
    """
    df = df.drop("own_license", "own_score", "header", "is_license_file", "license", "inherited_from")
    df = own_licenses(df, text, path, least, templates)
    df = stored(df if keep_text else df.drop(text), "own")
    folder = temp_name(df, "dir_")
    df = df.withColumn(folder, F.regexp_replace(F.col(path), r"/?[^/]*$", ""))
    held = F.min(F.struct(F.col(path).alias("p"), F.col("own_license").alias("l"))).alias("held")
    holders = df.where("is_license_file").groupBy(F.col(folder).alias("holder")).agg(held)
    wanting = df.where(F.col("own_license").isNull() & F.col(folder).isNotNull()).select(F.col(folder).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))
    up = wanting.withColumn("above", F.explode(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))).otherwise(above)))
    met = up.join(holders, up["above"]["up"] == holders["holder"])
    of, found = temp_name(df, "of_"), temp_name(df, "from_")
    nearest = met.groupBy(F.col("dir").alias(of)).agg(F.max_by("held", F.col("above")["depth"]).alias(found))
    # a table, so that the join deals both sides anew and adaptive execution can split a directory of very many files
    nearest = stored(nearest, "nearest")
    out = df.join(nearest, (df[folder] == nearest[of]) & df["own_license"].isNull(), "left")
    return out.withColumns({"license": F.coalesce("own_license", F.col(found)["l"]), "inherited_from": F.col(found)["p"]}).drop(folder, of, found)
