"""Text to rows: chunks, sentences, tags, links, front matter, ids and query variants."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import md5_short

CHUNK_MOST, PARAGRAPH_TARGET, SECTION_LEAST, SMALL_FILE = 4000, 3000, 10, 200
MAX_VARIANTS = 12
# Acronyms and what they stand for.
ACRONYMS = {
    "ml": "machine learning",
    "ai": "artificial intelligence",
    "nlp": "natural language processing",
    "llm": "large language model",
    "rag": "retrieval augmented generation",
    "nn": "neural network",
    "cnn": "convolutional neural network",
    "rnn": "recurrent neural network",
    "gpu": "graphics processing unit",
    "cpu": "central processing unit",
    "api": "application programming interface",
    "cli": "command line interface",
    "db": "database",
    "sql": "structured query language",
    "ssh": "secure shell",
    "tls": "transport layer security",
    "ssl": "secure sockets layer",
    "dns": "domain name system",
    "dhcp": "dynamic host configuration protocol",
    "vpn": "virtual private network",
    "vm": "virtual machine",
    "os": "operating system",
    "ci": "continuous integration",
    "cd": "continuous deployment",
    "k8s": "kubernetes",
    "tf": "tensorflow",
    "ner": "named entity recognition",
    "rrf": "reciprocal rank fusion",
    "bm25": "best match 25",
    "fts": "full text search",
    "orm": "object relational mapping",
    "jwt": "json web token",
    "oauth": "open authorization",
    "cors": "cross origin resource sharing",
    "xss": "cross site scripting",
    "csrf": "cross site request forgery",
    "sqli": "sql injection",
    "mitm": "man in the middle",
    "ddos": "distributed denial of service",
    "ids": "intrusion detection system",
    "ips": "intrusion prevention system",
    "siem": "security information event management",
    "osint": "open source intelligence",
    "ctf": "capture the flag",
}
# How questions begin.
QUESTION_STARTS = [
    "what is ", "what are ", "how to ", "how do ", "how does ",
    "why is ", "why are ", "why does ", "when did ", "when does ",
    "where is ", "where are ", "who is ", "who are ",
]


# ---- tags, links, sentences


def tags(content: Column) -> Column:
    """Distinct lower-case hashtags in order: a # at the start or after a space, then a letter."""
    found = F.regexp_extract_all(content, F.lit(r"(?U)(?:^|\s)#([a-zA-Z][a-zA-Z0-9_-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def wiki_links(content: Column) -> Column:
    """Distinct trimmed targets of [[target]] and [[shown|target]], in order."""
    found = F.regexp_extract_all(content, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    target = lambda x: F.trim(F.when(F.contains(x, F.lit("|")), F.regexp_extract(x, r"^[^|]*\|(.*)$", 1)).otherwise(x))
    return F.array_distinct(F.filter(F.transform(found, target), lambda x: x != ""))


def sentences(content: Column) -> Column:
    """Pieces that end with . ! or ? before white space, and the rest; trimmed."""
    return F.filter(F.transform(F.split(content, r"(?U)(?<=[.!?])\s"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def strip_frontmatter(content: Column) -> Column:
    return F.regexp_replace(content, r"(?sm)\A---\n.*?^---\n", "")


def frontmatter(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds frontmatter (JSON of the YAML object at the top, {} if there is none) and body."""
    block = F.regexp_extract(F.col(content), r"(?sm)\A---\n(.*?)^---\n", 1)

    @F.pandas_udf("string")
    def parsed(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import yaml

        def one(text: str | None) -> str:
            try:
                value = yaml.safe_load(text) if text else {}
            except yaml.YAMLError:
                value = {}
            return json.dumps(value if isinstance(value, dict) else {}, default=str, sort_keys=True)

        for block in blocks:
            yield block.map(one)

    return df.withColumns({"frontmatter": parsed(block), "body": strip_frontmatter(F.col(content))})


def frontmatter_tags(front: Column) -> Column:
    return F.transform(F.from_json(F.get_json_object(front, "$.tags"), "array<string>"), F.lower)


def _whole(cut: Column, edge: str) -> Column:
    """Bytes as text, without the character that the cut went through."""
    return F.regexp_replace(F.make_valid_utf8(cut.cast("string")), edge, "")


def excerpt(content: Column, most: int = 2000) -> Column:
    """Head and tail, of ``most`` / 2 bytes each, of a content of more than ``most`` bytes."""
    data, half = content.cast("binary"), most // 2
    head = _whole(F.substring(data, 1, half), "\ufffd+$")
    tail = _whole(F.substring(data, -half, half), "^\ufffd+")
    return F.when(F.octet_length(content) > most, F.concat(head, F.lit("\n...\n"), tail)).otherwise(content)


def without_block(content: Column) -> Column:
    """A content without what stands between its first two ---, if it begins with one."""
    return F.when(content.rlike(r"(?s)\A---.*?---"), F.regexp_replace(content, r"(?s)\A---.*?---\s*", "")).otherwise(content)


def preview(content: Column, lines: int = 3, most: int = 120) -> Column:
    kept = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.array_join(F.slice(kept, 1, lines), " "), 1, most)


def note_facts(docs: DataFrame) -> DataFrame:
    """(id, word_count, modified_time): what a graph keeps of a note besides its title; the time in whole seconds, as indexed."""
    words = F.size(F.filter(F.split("content", r"(?U)\s+"), lambda w: w != "")).cast("long")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(words, F.lit(0)).alias("word_count"), F.unix_seconds("indexed_at").alias("modified_time"))


# ---- ids


def chunk_id(path: Column, index: Column) -> Column:
    """sha256 of the path and the index as eight little-endian bytes: twelve digits, then the index."""
    hexed = F.lpad(F.hex(index.cast("long")), 16, "0")
    little = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    return F.concat(F.substring(F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(little)), 256), 1, 12), F.lit("_"), index.cast("string"))


def note_id(path: Column) -> Column:
    return F.concat(F.lit("note_"), md5_short(path))


def title_of(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.translate(stem, "-_", "  ")


# ---- chunking


def _cut(text: str, most: int) -> str:
    data = text.encode()
    return text if len(data) <= most else data[:most].decode(errors="ignore") + "..."


def _size(text: str) -> int:
    return len(text.encode())


def _sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s", text)) if s]


def pack(parts: list[str], joint: str, target: int) -> list[str]:
    """Parts joined greedily while they stay within ``target`` bytes."""
    out: list[str] = []
    for part in parts:
        if out and _size(out[-1]) + len(joint) + _size(part) <= target:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def paragraphs(text: str) -> list[str]:
    """Paragraphs packed to the target; one that is too long is packed from its sentences."""
    parts: list[str] = []
    for paragraph in re.split(r"\n\n+", text):
        if paragraph.strip():
            parts += pack(_sentences(paragraph), " ", PARAGRAPH_TARGET) if _size(paragraph) > CHUNK_MOST else [paragraph.strip()]
    return pack(parts, "\n\n", PARAGRAPH_TARGET)


def markdown_chunks(content: str) -> list[tuple[str, str]]:
    """(section, text) chunks of a Markdown file: its introduction and each ## or ### section under its parents' titles."""
    body = re.sub(r"\A---\n.*?^---\n", "", content, flags=re.S | re.M)
    top = re.search(r"^# (.+)$", body.encode()[:500].decode(errors="ignore"), re.M)
    h1 = top[1].strip() if top else ""
    if _size(body.strip()) < SECTION_LEAST:
        return []
    if _size(body) < SMALL_FILE:
        return [("full", body.strip())]
    heads = list(re.finditer(r"^(##|###) (.+)$", body, re.M))
    if not heads:
        if _size(body) <= PARAGRAPH_TARGET:
            return [("full", body.strip())]
        return [(f"part_{i + 1}", _cut(text, CHUNK_MOST)) for i, text in enumerate(paragraphs(body))]
    out = []
    intro = body[: heads[0].start()].strip()
    if _size(intro) >= SECTION_LEAST:
        out.append(("intro", _cut(intro, CHUNK_MOST)))
    h2 = ""
    for head, after in zip(heads, [*heads[1:], None], strict=True):
        title = head[2].strip()
        text = body[head.start() : after.start() if after else len(body)].strip()
        above = [f"# {h1}"] if h1 else []
        if head[1] == "##":
            h2 = title
        elif h2:
            above.append(f"## {h2}")
        whole = "\n\n".join([*above, text])
        if _size(text) >= SECTION_LEAST:
            out.append((title, _cut(whole, CHUNK_MOST)))
    return out


def chunk_markdown(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, chunk_index, section, content, doc_id) for each chunk of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _in_parts(batches, content):
            rows = [
                (p, i, section, text, hashlib.sha256(p.encode() + i.to_bytes(8, "little")).hexdigest()[:12] + f"_{i}")
                for p, c in zip(batch[path], batch[content], strict=True)
                for i, (section, text) in enumerate(markdown_chunks(c or ""))
            ]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "section", "content", "doc_id"])

    return files.select(path, content).mapInPandas(run, "path string, chunk_index long, section string, content string, doc_id string")


#: Characters of texts that are cut before their chunks leave a worker.
CHUNK_BATCH = 1 << 20


def _in_parts(batches: Iterator[pd.DataFrame], content: str) -> Iterator[pd.DataFrame]:
    """The rows of batches in parts of about CHUNK_BATCH characters, of a row at least."""
    for batch in batches:
        part = (batch[content].str.len().fillna(0).cumsum() // CHUNK_BATCH).astype("int64")
        for _, rows in batch.groupby(part.to_numpy(), sort=False):
            yield rows


def paragraph_chunks(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, chunk_index, content): the packed paragraphs of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _in_parts(batches, content):
            made = [(k, i, p) for k, c in zip(batch[key], batch[content], strict=True) for i, p in enumerate(paragraphs(c or ""))]
            yield pd.DataFrame(made, columns=[key, "chunk_index", "content"])

    return df.select(key, content).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, chunk_index long, content string")


def sentence_chunks(df: DataFrame, key: str = "doc_id", content: str = "content", target: int = PARAGRAPH_TARGET) -> DataFrame:
    """(key, chunk_index, content): sentences packed greedily to ``target`` bytes, by a fold over the sentence array."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["now"] == "") | (F.octet_length(acc["now"]) + 1 + F.octet_length(s) <= target)
        grown = F.when(acc["now"] == "", s).otherwise(F.concat_ws(" ", acc["now"], s))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"),
            F.when(fits, grown).otherwise(s).alias("now"),
        )

    end = lambda acc: F.filter(F.concat(acc["done"], F.array(acc["now"])), lambda x: x != "")
    packed = F.aggregate(sentences(F.col(content)), start, step, end)
    return df.select(key, F.posexplode(packed).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


# ---- queries


def match_query(query: str) -> str:
    """A query's words without special characters, quoted and joined by OR."""
    special = set("\"'\\(){}[]*^:~@#$%&|<>!")
    words = ["".join(c for c in w if c not in special).strip("-") for w in query.split()]
    words = [w for w in words if len(w.encode()) >= 2]
    return " OR ".join(f'"{w}"' for w in words)


def match_expression(query: Column) -> Column:
    """``match_query`` of a column of queries."""
    special = "\"'\\(){}[]*^:~@#$%&|<>!"
    bare = F.transform(F.split(F.translate(query, special, ""), r"\s+"), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    words = F.filter(bare, lambda w: F.octet_length(w) >= 2)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def query_variants(query: str) -> list[str]:
    """Up to twelve spellings of a query, itself first."""
    if not query.strip():
        return []
    low = query.lower()
    found = [query, low]
    apart = re.sub(r"\b([A-Za-z]+)(\d+)\b", r"\1 \2", query)
    joined = re.sub(r"\b([A-Za-z]+)\s+(\d+)\b", r"\1\2", query)
    for changed in (apart, joined):
        if changed != query:
            found += [changed, changed.lower()]
    for mark, lowered in (("-", True), ("_", False), (".", False)):
        if mark in query:
            for filler in ("", " "):
                changed = query.replace(mark, filler)
                found += [changed, changed.lower()] if lowered else [changed]
    words = query.split()
    if len(words) >= 3:
        for pair in (words[:2], words[-2:]):
            found += [" ".join(pair), " ".join(pair).lower()]
    meaning = {v: k for k, v in ACRONYMS.items()}
    whole = low.strip()
    found += [ACRONYMS.get(whole) or meaning.get(whole) or ""]
    found += [low.replace(w, ACRONYMS[w]) for w in low.split() if w in ACRONYMS]
    start = next((s for s in QUESTION_STARTS if low.startswith(s)), None)
    if start:
        found.append(query[len(start) :].strip().rstrip("?"))
    return list(dict.fromkeys(v for v in found if v))[:MAX_VARIANTS]


def variants_table(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, position, variant) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, i, v) for q in batch[query] for i, v in enumerate(query_variants(q or ""))]
            yield pd.DataFrame(rows, columns=["query", "position", "variant"])

    return queries.select(query).mapInPandas(run, "query string, position long, variant string")
