"""File scans and what changed since the last index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN = ("md", "markdown", "txt")
NOTES = ("md", "markdown")
CLI = ("md", "txt")
LIBRARY = ("md", "txt", "rs", "py", "js", "ts", "toml", "yaml", "yml", "json")


def _pattern(extensions: tuple[str, ...]) -> str:
    """A pattern of file names with these extensions, in any case."""
    cased = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*.{" + ",".join(cased) + "}"


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...] = MARKDOWN, least_bytes: int = 0, source: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """(path, doc_id, mtime, full_path, content) of the files under ``root``, or of those of ``paths`` alone.

    path is relative to the root; doc_id is the path without its extension, / as ::, after the source's name if given. Names,
    times and lengths come from the listing; a file is read only if its content (bytes) is asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _pattern(extensions))
    files = reader.load(paths if paths is not None else root).where(F.col("length") >= least_bytes)
    base = F.lit(root.rstrip("/").removeprefix("file://"))
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    relative = F.substring(bare, F.length(base) + 2, F.length(bare)) if root.startswith(("/", "file:")) else F.col("path")
    stem = F.regexp_replace(F.replace(relative, F.lit("/"), F.lit("::")), r"\.[^.:]*$", "")
    named = F.concat(F.lit(f"{source}::"), stem) if source else stem
    mtime = F.unix_micros("modificationTime") / 1e6
    return files.select(relative.alias("path"), named.alias("doc_id"), mtime.alias("mtime"), F.col("path").alias("full_path"), "content")


def with_text(files: DataFrame) -> DataFrame:
    """``files`` of ``listed`` with text for bytes: null where they aren't UTF-8."""
    return files.withColumn("content", F.try_validate_utf8(F.col("content").cast("string")))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = MARKDOWN, least_bytes: int = 0, source: str | None = None) -> DataFrame:
    """(path, doc_id, content, mtime) of the text files under ``root``; those that aren't UTF-8 are left out."""
    found = with_text(listed(spark, root, extensions, least_bytes, source))
    return found.select("path", "doc_id", "content", "mtime").where("content is not null")


#: Up to so many files are read by their names; of more, the whole folder is.
MOST_PATHS = 10_000


def read_some(spark: SparkSession, root: str, chosen: DataFrame, **of) -> DataFrame:
    """(path, doc_id, mtime, full_path, content) of the files of ``listed`` that ``chosen`` names (full_path), and of no others.

    Spark's listing of files is on the driver in any case, and so are the names of some of them.
    """
    names = [r["full_path"] for r in chosen.select("full_path").limit(MOST_PATHS + 1).collect()]
    if len(names) > MOST_PATHS:
        return with_text(listed(spark, root, **of).join(chosen.select("full_path"), "full_path", "left_semi"))
    if not names:
        return with_text(listed(spark, root, **of).limit(0))
    return with_text(listed(spark, root, paths=names, **of))


def delta(disk: DataFrame, held: DataFrame, slack: float = 0.5) -> DataFrame:
    """(doc_id, state): new, changed (modified more than ``slack`` seconds after it was indexed), deleted or same."""
    joined = disk.select("doc_id", "mtime").join(held.select("doc_id", "indexed"), "doc_id", "full_outer")
    state = F.when(F.col("indexed").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when(F.col("mtime") > F.col("indexed") + slack, "changed")
    return joined.select("doc_id", state.otherwise("same").alias("state"))


def under(held: DataFrame, prefix: str, path: str = "file_path") -> DataFrame:
    """Rows whose path starts with the prefix; pushed down to the scan."""
    return held.where(F.col(path).startswith(prefix))


def needs_update(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Files (cache_key, mtime) that the cache doesn't have with the same time to a millisecond."""
    known = cache.select("cache_key", F.col("last_modified").alias("m_"))
    joined = files.join(known, "cache_key", "left")
    return joined.where(F.col("m_").isNull() | (F.abs(F.col("mtime") - F.col("m_")) > 0.001)).drop("m_")


def reindex_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("new", "added"), ("changed", "reindexed"), ("deleted", "pruned"), ("same", "skipped"))], F.count("*").alias("checked"))
