"""A corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed to targets, texts become tokens.

Each stage takes the rows its predecessor kept and returns rows with the same columns, the last one tokens instead of texts.
Between stages rows are written as Parquet to the shared folder and read again.

Defined cases: null and empty texts aren't toxic, are copies of each other, are no near copies, and are never taken by the mix,
which has their words only; rows with a null doc_id or source are rows like others (near copies are told by doc_id, so rows
without one stay); texts of any length are read whole; of repeated rows the copies stage leaves one; empty tables give an empty
result, and without labels nothing is toxic; extra columns are carried to the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from tidewell.llm.queries import fold_of, table
from tidewell.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words of a block of the mix: most documents stay in one piece.
MIX_BLOCK = 1024
#: Bytes of a batch of rows on their way to Python. A batch is held several times, in the JVM and in its worker.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in batches of BATCH_BYTES, unless it has been told to send smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)b?$", spark.conf.get(name))
    if now is None or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Columns of ``docs`` that an operator would replace, renamed; and how to name them back."""
    back = {}
    for column in docs.columns:
        if column.lower() in names:
            back[f"own__{column}"] = column
            docs = docs.withColumnRenamed(column, f"own__{column}")
    return docs, back


def _back(df: DataFrame, columns: list[str], back: dict[str, str]) -> DataFrame:
    names = {v: k for k, v in back.items()}
    return df.select([F.col(names.get(c, c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score 0.5 or more go. Learns from labelled rows of the folds that op9 learns from."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(fold_of("doc_id", 5) != 0), labels.where(fold_of("doc_id", 5) != 0))
    apart, back = _apart(docs, "score")
    return _back(toxicity.score(apart, model).where("score < 0.5"), docs.columns, back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 with shingles of five words and a similarity of 0.8: the smallest doc_id of each group stays."""
    _small_batches(spark)
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the mix's pieces as rows; a document that is taken twice comes twice."""
    apart, back = _apart(docs, "out_shard", "slot")
    mixed = mixing.mixed_documents(apart, block=MIX_BLOCK)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.char_length("text").cast("long"))
    return _back(mixed, docs.columns, back)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids and their number instead of texts; other columns stay."""
    _small_batches(spark)
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    kept = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens")]
    return encoded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]

#: The mix draws by Spark's 64-bit hash and the tokens follow from merges, neither of which SQL has.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
