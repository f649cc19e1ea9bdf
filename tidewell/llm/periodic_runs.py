"""Periodic runs of words by the runs theorem, and texts without their repetitions.

Every run (a maximal stretch that repeats with its smallest period at least twice) has a Lyndon root that is the longest Lyndon
word at its start under the order of words or under the reversed one. Longest Lyndon words end at the next smaller value of the
inverse suffix array; each is extended to both sides by longest common extensions, minima of LCP arrays (of the words and of the
words backwards) that a sparse table gives. So 2n candidates give all runs.

Documents are joined into one array with a separator behind each, smaller than all words and different from all others, so no
extension leaves its document. A run of at least ``LEAST`` words has LEAST / 2 words that occur twice; documents without such a
repetition have no runs and no suffix arrays are made for them (equal hashes of different words only make more).

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; whole texts of any length; rows with
equal or null ids are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.arrow import add_columns
from tidewell.llm.shared import temp_name

#: Words of the shortest run; words that are searched at once, whole documents at least.
LEAST, AT_ONCE = 12, 1 << 17

FIELDS = ("n_runs", "start", "length", "period", "exponent_milli")
DIGESTS = ("runs_sha256", "collapsed_sha256")


# ---- suffix arrays


def repeated(codes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the documents in which some ``size`` words may occur twice: all in which they do, and hardly any other."""
    if len(codes) < size:
        return np.zeros(0, dtype=np.int64)
    n = len(codes) - size + 1
    hashes = owner[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        hashes = (hashes ^ (codes[k : k + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, dtype=np.int64)
    place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return np.unique(owner[:n][twice[place] == hashes])


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(inverse suffix array, [(length, ranks of the stretches of that length)]) by doubling; codes end in the least, once.

    A rank is the place of the first of its group in sorted order, so only groups that aren't alone are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes)
    new = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [(1, rank)], 1
    while True:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            return rank, levels
        after = open_ + length
        key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = open_[order], key[order]
        group = rank[at]
        place = np.arange(len(at))
        head = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), place, 0))
        part = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), place, 0))
        rank = rank.copy()
        rank[at] = group + part - head
        length *= 2
        levels.append((length, rank))


def lcp_array(inverse: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """[r]: the common length of the suffixes of ranks r - 1 and r; [0] = 0."""
    n = len(inverse)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[inverse] = np.arange(n)
    a, b, out = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(n, dtype=np.int64)
    for length, rank in reversed(levels):
        equal = rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
        equal &= (a < n) & (b < n)
        step = np.where(equal, length, 0)
        a, b, out[1:] = a + step, b + step, out[1:] + step
    return out


class Minima:
    """Least values of stretches by a sparse table, and the next smaller value behind each place."""

    def __init__(self, values: np.ndarray):
        self.tables, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each stretch [start, end), which isn't empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), dtype=np.int64)
        for k in np.unique(level):
            at, table = np.flatnonzero(level == k), self.tables[k]
            out[at] = np.minimum(table[start[at]], table[end[at] - (1 << int(k))])
        return out

    def next_smaller(self) -> np.ndarray:
        """For each place the first later one of a smaller value; the end if there is none."""
        values = self.tables[0]
        n = len(values)
        at = np.arange(1, n + 1)
        for k in range(len(self.tables) - 1, -1, -1):
            table = self.tables[k]
            open_ = np.flatnonzero(at + (1 << k) <= n)
            go = open_[table[at[open_]] > values[open_]]
            at[go] += 1 << k
        return at


class Extension:
    """Longest common extensions to the right of pairs of places."""

    def __init__(self, codes: np.ndarray):
        self.inverse, levels = suffix_ranks(codes)
        self.minima = Minima(lcp_array(self.inverse, levels))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different places a and b."""
        x, y = self.inverse[a], self.inverse[b]
        return self.minima.least(np.minimum(x, y) + 1, np.maximum(x, y) + 1)


def runs_of(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of at least ``least`` numbers, in order of starts and periods.

    ``codes`` are words from 0 on, and negative separators, each but once and the last of all at the end.
    """
    n = len(codes)
    forward = Extension(codes)
    backward = Extension(np.concatenate((codes[:-1][::-1], codes[-1:])))
    reversed_order, _ = suffix_ranks(np.where(codes >= 0, codes.max() - codes, codes))
    roots = []
    for inverse in (forward.inverse, reversed_order):
        root_end = Minima(inverse).next_smaller()
        i = np.flatnonzero((codes >= 0) & (root_end < n))
        roots.append(i * (n + 1) + root_end[i] - i)
    i, p = np.divmod(np.unique(np.concatenate(roots)), n + 1)
    if not len(i):
        return np.zeros((0, 3), dtype=np.int64)
    right = i + p + forward.common(i, i + p)
    # the place before i is n - 1 - i backwards; before the first place there is nothing
    left = i.copy()
    inner = np.flatnonzero(i > 0)
    left[inner] -= backward.common(n - 1 - i[inner], n - 1 - i[inner] - p[inner])
    length = right - left
    long_ = length >= np.maximum(2 * p, least)
    # a run's start and period tell its length
    _, first = np.unique(left[long_] * (n + 1) + p[long_], return_index=True)
    return np.stack((left[long_], length[long_], p[long_]), axis=1)[first]


# ---- documents


def tail_repeated(words: list, key: str) -> list:
    """The words of a document, with a tail that repeats a short stretch of its own if the hash of its id says so."""
    h = zlib.crc32(key.encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def encoded(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): words as numbers from 0 on, and a separator behind each document: the last one's is the least."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    flat = pa.array([w for d in documents for w in d], type=pa.binary())
    words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    codes = np.empty(int(ends[-1]), dtype=np.int64)
    codes[ends - 1] = -1 - np.arange(len(documents))
    inside = np.ones(len(codes), dtype=bool)
    inside[ends - 1] = False
    codes[inside] = words
    return codes, starts


def runs_by_document(documents: list[list[bytes]], least: int = LEAST) -> dict[int, np.ndarray]:
    """Number of a document: its runs (start, length, period); documents without runs aren't there."""
    documents_ = [(k, d) for k, d in enumerate(documents) if len(d) >= least]
    if not documents_:
        return {}
    codes, starts = encoded([d for _, d in documents_])
    # a run holds some least // 2 words twice
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    some = repeated(codes, owner, least // 2)
    if not len(some):
        return {}
    if len(some) < len(starts):
        codes, starts = encoded([documents_[k][1] for k in some])
    found = runs_of(codes, least)
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] -= starts[owner]
    return {documents_[some[k]][0]: found[owner == k] for k in np.unique(owner)}


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that no run holds behind its first period."""
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    return [words[i] for i in kept]


def find_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", alter: bool = False, least: int = LEAST, collapsed_text: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds n_runs, the longest run (start, length, period, exponent_milli), runs (all of them), the digests runs_sha256 and
    collapsed_sha256, and with ``collapsed_text`` that text. ``alter``: each document as ``tail_repeated`` has it."""
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    new = [T.StructField(n, T.LongType()) for n in FIELDS] + [T.StructField(n, T.StringType()) for n in DIGESTS] + [T.StructField("runs", T.ArrayType(run))]
    new += [T.StructField("collapsed_text", T.StringType())] if collapsed_text else []
    both, name = temp_name(documents, "key_text_"), F.coalesce(F.col(key).cast("string"), F.lit(""))
    keyed = documents.withColumn(both, F.concat(F.char_length(name).cast("string"), F.lit("\n"), name, F.coalesce(F.col(text), F.lit(""))))
    keyed = keyed if keep_text else keyed.drop(text)

    def make():
        def work(column: pa.Array) -> list:
            keys, words = [], []
            for size, _, rest in (t.partition("\n") for t in column.to_pylist()):
                keys.append(rest[: int(size)])
                words.append(rest[int(size) :].encode().split())
            if alter:
                words = [tail_repeated(w, k) for w, k in zip(words, keys, strict=True)]
            found: dict[int, np.ndarray] = {}
            first, held = 0, 0
            for k, w in enumerate(words):
                held += len(w) + 1
                if held >= AT_ONCE or k + 1 == len(words):
                    part = runs_by_document(words[first : k + 1], least)
                    found |= {first + i: r for i, r in part.items()}
                    first, held = k + 1, 0
            out: list[list] = [[] for _ in new]
            for k, w in enumerate(words):
                row = _row(w, found.get(k))
                for values, value in zip(out, row, strict=False):
                    values.append(value)
            return out

        return work

    return add_columns(keyed, both, new, make, keep_text=False)


def _row(words: list, runs: np.ndarray | None) -> tuple:
    if runs is None or not len(runs):
        best, listed, kept = (0, None, None, None, None), [], words
    else:
        longest = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        best = (len(runs), *longest, 1000 * longest[1] // longest[2])
        listed, kept = runs.tolist(), collapsed(words, runs)
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in listed)
    text = b" ".join(kept)
    structs = [{"start": a, "length": n, "period": p} for a, n, p in listed]
    return (*best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), structs, text.decode())
