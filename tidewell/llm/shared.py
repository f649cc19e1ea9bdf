"""What the operators of this subpackage have in common: scratch tables, word patterns, prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Buckets into which each group is cut for running totals; bounds the offset table at groups x BUCKETS rows.
BUCKETS = 4096

_scratch: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session inside ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a temporary folder serves a local master, whose executors are threads of this process; on a cluster
    it is an error, since executors wouldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{base.rstrip('/')}/tidewell-{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _scratch[path] = spark
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    with suppress(Exception):
        jvm = _scratch.pop(path).sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(_hadoop_conf(jvm)).delete(place, True)


def _hadoop_conf(jvm):
    return jvm.org.apache.spark.SparkContext.getOrCreate().hadoopConfiguration()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def temp_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, by appending underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Where no other character has a lower-case form, the built-in ``lower`` does just that."""
    cased = text.rlike(r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]")
    return F.when(cased, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_start(df: DataFrame, group: str, value: str, order: list[str], out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows of a group are ordered by a hash bucket of ``order`` and then by ``order``. Each bucket is summed by its own
    window, and bucket totals (at most groups x buckets rows) give each bucket its offset, so no task ever holds a group.
    """
    bucket, offset, mine, at, sum_ = (temp_name(df, n) for n in ("bucket_", "offset_", "group_", "at_bucket_", "sum_bucket_"))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = df.groupBy(F.col(group).alias(mine), F.col(bucket).alias(at)).agg(F.sum(value).alias(sum_))
    before = Window.partitionBy(mine).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(mine, at, F.coalesce(F.sum(sum_).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = df.join(totals, df[group].eqNullSafe(totals[mine]) & (df[bucket] == totals[at]))
    return joined.withColumn(out, F.col(out) + F.col(offset)).drop(bucket, at, offset, mine)


#: A bit filter has at most this many bits; it is sent to all executors, so this bounds it at 16 MB.
MOST_BITS = 1 << 27


def bit_filter(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """A filter of the hashes of ``column``: (rows of 4 KB bitmaps by bucket, number of bits), of bounded size."""
    bits = 1 << 15
    while bits < min(most_bits, 32 * keys.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    marks = keys.select(F.shiftright(place, 15).cast("int").alias("bucket_f"), place.bitwiseAND(F.lit(32767)).alias("bit_f"))
    return marks.groupBy("bucket_f").agg(F.bitmap_construct_agg("bit_f").alias("map_f")), bits


def maybe_in(df: DataFrame, column: str, made: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose ``column`` may be among the keys of a bit filter: all that are, and few that aren't. No shuffle of ``df``."""
    flag = temp_name(df, "maybe_")
    return marked(df, column, made, flag).where(flag).drop(flag)


def surely_not_in(df: DataFrame, column: str, made: tuple[DataFrame, int]) -> DataFrame:
    """The other rows, nulls included."""
    flag = temp_name(df, "maybe_")
    return marked(df, column, made, flag).where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def marked(df: DataFrame, column: str, made: tuple[DataFrame, int], flag: str) -> DataFrame:
    """Adds ``flag``: whether a bit filter may have ``column``; false or null where it surely hasn't."""
    maps, bits = made
    bucket, held = temp_name(df, flag + "bucket_"), temp_name(df, flag + "map_")
    maps = maps.select(F.col("bucket_f").alias(bucket), F.col("map_f").alias(held))
    place = F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(bits)))
    bit = place.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(held, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mark = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit.bitwiseAND(F.lit(7)) + 1).cast("int"))
    joined = df.join(F.broadcast(maps), F.shiftright(place, 15).cast("int") == F.col(bucket), "left")
    return joined.withColumn(flag, byte.bitwiseAND(mark) != 0).drop(bucket, held)
