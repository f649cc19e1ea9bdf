"""Byte-level BPE encoding and decoding.

Each match of the split pattern is a word; a word's bytes are merged by rank, least rank first and leftmost among equals,
until no neighbouring pieces form a ranked piece. Distinct words are folded once for each worker (a bounded table of
words), then looked up. Decoding concatenates the binary pieces of the ids.

Defined cases: null and empty texts have no tokens (empty strings are hashed); texts and words of any length are encoded
whole (long words merge by a heap); repeated rows are encoded one by one; an empty table gives an empty result; extra
columns are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.arrow import add_columns

#: Distinct words that a worker holds; the table is emptied when full.
WORDS_HELD = 400_000
#: Words of more bytes than this merge by a heap.
SHORT = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64(piece) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word after all merges."""
    if word in ranks:
        return [word]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    while len(pieces) > 1:
        best, at = None, -1
        for i in range(len(pieces) - 1):
            rank = get(pieces[i] + pieces[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges with a heap of (rank, place): n log n in the word's length."""
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n:
            both = piece[i] + piece[j]
            rank = ranks.get(both)
            if rank is not None:
                heapq.heappush(heap, (rank, i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if piece[i] is None or right[i] >= n or piece[i] + piece[right[i]] != both:
            continue
        gone = right[i]
        piece[i], piece[gone] = both, None
        right[i] = right[gone]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [p for p in piece if p is not None]


class Codec:
    """Encodes texts to ids and decodes them; picklable, and opened by each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.named = {str(rank): piece for piece, rank in ranks.items()}
        self.words: dict[str, str] = {}

    def word(self, word: str) -> str:
        found = " ".join([str(self.ranks[p]) for p in fold(word.encode("utf-8", "surrogatepass"), self.ranks)])
        if len(self.words) >= WORDS_HELD:
            self.words.clear()
        if len(word) <= SHORT:
            self.words[word] = found
        return found

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by a space."""
        held, fresh = self.words.get, self.word
        return " ".join([held(w) or fresh(w) for w in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def decode_joined(self, joined: str) -> bytes:
        named = self.named
        return b"".join([named[i] for i in joined.split()])


def _codec(df: DataFrame, ranks: dict[bytes, int], pattern: str):
    """Ships the ranks (as many as the vocabulary has) and gives what opens a codec in a task."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks)
    return lambda: Codec(shipped.value, pattern)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the ids of each text."""
    opened = _codec(df, ranks, pattern)

    def make():
        codec = opened()
        return lambda column: [[codec.encode(value or "") for value in column.to_pylist()]]

    return add_columns(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def encode_digest(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``df`` but for the text, with n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded again)."""
    opened = _codec(df, ranks, pattern)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        codec = opened()

        def work(column: pa.Array) -> list:
            counts, ids, decoded = [], [], []
            for value in column.to_pylist():
                joined = codec.encode_joined(value or "")
                counts.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode_joined(joined)).hexdigest())
            return [counts, ids, decoded]

        return work

    return add_columns(df, text, new, make, keep_text=False)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for."""
    opened = _codec(df, ranks, ".")
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened()
        for batch in batches:
            values = [codec.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)
