"""Exact dedup by a log-structured merge index.

Rows enter memtables (batches by a hash of the identifier). A memtable flushes one row per digest, sorted by digest, into
a run: Parquet files cut by ranges of digests, with minima, maxima and a Bloom filter of the digest, and a bit filter of all
its digests. Compaction merges runs level by level, ``fanout`` at a time, each digest keeping its smallest identifier and the
sum of its counts; a digest that no other run's filter has passes as it is, so only those that runs may share are shuffled.
A row whose digest has another keeper is a hit; it is a copy only if its text equals the keeper's byte by byte.

The smallest identifier stays; for "the largest doc_id stays" the identifier is the negated doc_id, so ids are integers.

Defined cases: a null text counts as empty; a null doc_id comes last among identifiers (a group without any doc_id has the
keeper null); repeated rows with one doc_id are one group, of which ``dedup`` marks each row that has the keeper's doc_id as
kept and ``without_copies`` leaves one, by the hash of the whole row; texts of any length are hashed and compared whole; an
empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import ascii_lower, bit_filter, marked, maybe_in, scratch_dir, stored, temp_name

FANOUT = 4
#: A group of more than one row in so many goes by broadcast; there can't be more such groups than this.
HOT_GROUPS = 1000
#: Bits of a run's filter at most: 4 MB for each of the ``fanout`` runs that are compacted at once.
RUN_BITS = 1 << 25


#: Files have Bloom filters of a size that fits their rows; the default would be a megabyte each.
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def sha256(text: Column) -> Column:
    """SHA-256 (hexadecimal) of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


class MergeIndex:
    """Sorted runs of (digest, ident, n) in the shared scratch folder, each with its filter."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.schema = "digest binary, ident long, n long"
        self._filters: dict[str, tuple[DataFrame, int]] = {}

    def flush(self, rows: DataFrame, memtables: int = 1) -> None:
        """Adds (digest, ident, n) rows as ``memtables`` runs of level 0."""
        table = F.pmod(F.xxhash64("ident"), F.lit(memtables))
        merged = rows.groupBy(table.alias("run"), "digest").agg(F.min("ident").alias("ident"), F.sum("n").alias("n"))
        self.schema = merged.select("digest", "ident", "n").schema
        path = f"{self.path}/l0-{len(self.levels[0])}"
        out = merged.repartitionByRange("run", "digest").sortWithinPartitions("run", "digest")
        out.write.partitionBy("run").options(**BLOOM).parquet(path)
        self.levels[0] += [f"{path}/run={k}" for k in range(memtables)]

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _there(self, paths: Sequence[str]) -> list[str]:
        jvm, found = self.spark.sparkContext._jvm, []
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            if place.getFileSystem(conf).exists(place):
                found.append(path)
        return found

    def filter_of(self, run: str) -> tuple[DataFrame, int]:
        """The bit filter of a run's digests, made once and stored beside it."""
        if run not in self._filters:
            maps, bits = bit_filter(self._read([run]), "digest", RUN_BITS)
            self._filters[run] = stored(maps, "filter"), bits
        return self._filters[run]

    def _contested(self, run: str, others: Sequence[str]) -> DataFrame:
        """A run's rows with contested_: whether the filter of any of the other runs may have the digest."""
        rows, flags = self._read([run]), []
        for k, other in enumerate(others):
            rows = marked(rows, "digest", self.filter_of(other), f"in_{k}")
            flags.append(F.coalesce(F.col(f"in_{k}"), F.lit(False)))
        return rows.select("digest", "ident", "n", reduce(Column.__or__, flags).alias("contested_"))

    def _merge(self, runs: Sequence[str], path: str) -> str:
        rows = [self._contested(run, [r for r in runs if r != run]) for run in runs]
        rows = reduce(DataFrame.unionByName, rows)
        alone = rows.where("not contested_").drop("contested_")
        merged = rows.where("contested_").groupBy("digest").agg(F.min("ident").alias("ident"), F.sum("n").alias("n"))
        out = alone.unionByName(merged).repartitionByRange("digest").sortWithinPartitions("digest")
        out.write.options(**BLOOM).parquet(path)
        return path

    def compact(self) -> DataFrame:
        """Merges all runs, ``fanout`` at a time, and gives the last run: one row per digest."""
        level = 0
        runs = self._there([r for level in self.levels for r in level])
        while len(runs) > 1:
            merged = []
            for k in range(0, len(runs), self.fanout):
                some = runs[k : k + self.fanout]
                merged.append(self._merge(some, f"{self.path}/l{level + 1}-{k // self.fanout}") if len(some) > 1 else some[0])
            runs, level = merged, level + 1
        self.levels = [runs]
        return self._read(runs) if runs else self.spark.createDataFrame([], self.schema)

    def lookup(self, digests: Sequence) -> DataFrame:
        """The rows of some digests in the runs as they are: literals, so the files' filters apply."""
        runs = self._there([r for level in self.levels for r in level])
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._read(runs).where(F.col("digest").isin(*digests))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = True, memtables: int = 4, digest=sha256) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 (of the normalised text); of equal texts (A-Z lower-cased) one stays.

    Only rows whose digest more than one row has are joined back. Groups so large that there can't be more than HOT_GROUPS of
    them go by broadcast, so that no task gathers a large group; the rest by a shuffle of the rows that a filter leaves.
    """
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    place = temp_name(df, "digest_")
    return _judged(df.withColumn(place, F.unhex(digest(body))), df, key, text, place, largest, memtables, digest)


def decisions(df: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = True, memtables: int = 4) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row: the columns of ``dedup`` without carrying the rows about.

    Ids and digests are stored once, and texts are read once more only where digests repeat.
    """
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    place = temp_name(df, "digest_")
    facts = stored(df.select(key, F.unhex(sha256(body)).alias(place)), "digests")
    found = _judged(facts, df, key, text, place, largest, memtables, sha256)
    return dedup(df.select(key, text), key, text, largest, memtables).drop(text) if found is None else found


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """The rows that dedup keeps, as they are; of several with the keeper's id and text, the one with the least hash.

    Rows that a bit filter of the dropped and the tied ones surely doesn't have aren't shuffled.
    """
    sha = sha256(ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    mark = temp_name(df, "row_key_")
    row_key = F.xxhash64(F.col(key), F.unhex(sha))
    decided = stored(decisions(df, key, text, largest).select("kept", F.xxhash64(F.col(key), F.unhex("text_sha256")).alias("row_key"), F.col(key).alias("gone_id"), "text_sha256"), "decided")
    gone = decided.where("not kept").select("row_key", "gone_id", "text_sha256").distinct()
    tied = decided.where("kept").groupBy("row_key", "gone_id", "text_sha256").count().where("count > 1").drop("count")
    doubt = stored(gone.withColumn("tied", F.lit(False)).unionByName(tied.withColumn("tied", F.lit(True))), "doubt")
    rows = marked(df.withColumn(mark, row_key), mark, bit_filter(doubt, "row_key"), temp_name(df, "doubtful_"))
    flag = rows.columns[-1]
    sure = rows.where(~F.coalesce(F.col(flag), F.lit(False))).select(df.columns)
    names = {c: temp_name(rows, "met_" + c) for c in doubt.columns}
    doubt = doubt.select([F.col(c).alias(n) for c, n in names.items()])
    same = rows[mark].eqNullSafe(doubt[names["row_key"]]) & rows[key].eqNullSafe(doubt[names["gone_id"]]) & (sha == doubt[names["text_sha256"]])
    # an outer join: the optimizer would move an anti join below the filter and so shuffle every text
    met = rows.where(F.col(flag)).join(doubt, same, "left")
    stay = met.where(F.col(names["tied"]).isNull()).select(df.columns)
    several = met.where(F.col(names["tied"]))
    least = F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("row")
    one = several.groupBy(mark, names["gone_id"], names["text_sha256"]).agg(least).select("row.*")
    return sure.unionByName(stay).unionByName(one)


def _judged(rows: DataFrame, df: DataFrame, key: str, text: str, place: str, largest: bool, memtables: int, digest) -> DataFrame | None:
    """``rows`` (with a binary digest in the column ``place``) with keep_id, group_size, kept and text_sha256 instead of it.

    None if two texts have one digest and ``rows`` hasn't the texts to tell them apart.
    """
    sign = -1 if largest else 1
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    index = MergeIndex(df.sparkSession)
    index.flush(rows.select((F.col(key) * sign).cast("long").alias("ident"), F.col(place).alias("digest"), F.lit(1).cast("long").alias("n")), memtables)
    run = index.compact()
    total = run.agg(F.sum("n")).first()[0] or 0
    d = temp_name(rows, "held_digest_")
    found = run.where("n > 1").select(F.col("digest").alias(d), (F.col("ident") * sign).alias("keep_id"), F.col("n").alias("group_size"))
    repeated = stored(found, "repeated")
    hot = F.col("group_size") > max(1, total // HOT_GROUPS)
    cold_filter = bit_filter(repeated.where(~hot), d)

    kinds = temp_name(rows, "kind_")
    with_hot = rows.join(F.broadcast(repeated.where(hot)), F.col(place) == F.col(d), "left").drop(d)
    with_hot = marked(with_hot, place, cold_filter, kinds)
    in_cold = F.col("group_size").isNull() & F.coalesce(F.col(kinds), F.lit(False))
    cold = with_hot.where(in_cold).drop("keep_id", "group_size").join(repeated.where(~hot), F.col(place) == F.col(d), "left").drop(d)
    out = with_hot.where(~in_cold).unionByName(cold).drop(kinds)
    out = out.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})

    members = df.select(F.col(key).alias("id"), F.unhex(digest(body)).alias("m"), body.alias("body"))
    members = maybe_in(members, "m", bit_filter(repeated, d))
    # equal texts are those of which the least and the greatest are the same; both are found map-side first
    clashes = members.groupBy("m").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low != high").select("m")
    clashes = stored(clashes, "clashes")
    if not clashes.isEmpty():
        if text not in rows.columns:
            return None
        out = _regrouped(out, members, clashes, place, sign, text)
    sha = F.lower(F.hex(place)) if digest is sha256 else F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256)
    return out.withColumns({"kept": F.col(key).eqNullSafe(F.col("keep_id")), "text_sha256": sha}).drop(place)


def _regrouped(out: DataFrame, members: DataFrame, clashes: DataFrame, place: str, sign: int, text: str) -> DataFrame:
    """Groups texts that share a digest with another text by the texts themselves; ``out`` has the texts."""
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    those = members.join(clashes, "m", "left_semi")
    m, b, keep, n = (temp_name(out, f"regrouped_{x}_") for x in "mbkn")
    groups = those.groupBy(F.col("m").alias(m), F.col("body").alias(b)).agg((F.min(F.col("id") * sign) * sign).alias(keep), F.count("*").alias(n))
    met = out.join(groups, (F.col(place) == F.col(m)) & (body == F.col(b)), "left")
    met = met.withColumns({"keep_id": F.when(F.col(n).isNotNull(), F.col(keep)).otherwise(F.col("keep_id")), "group_size": F.coalesce(n, "group_size")})
    return met.drop(m, b, keep, n)
