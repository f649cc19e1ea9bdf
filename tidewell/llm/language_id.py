"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs off to its character n-grams, longest
first: the first length of which any n-gram is known gives the mean of their log frequencies. A text's score is the sum
over its words; the best language's posterior is the reported score. A word is a run of letters; a very long one (scripts
without spaces) counts stretch by stretch of STRETCH letters, each with all n-grams that begin in it.

The model is fitted on a bounded sample of labelled texts (``sample`` documents by hash, of ``size`` bytes together) and keeps
every word and every n-gram of them.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts and runs of any length are read whole; of
languages with equal totals the first by name is predicted; repeated rows are scored one by one; an empty table gives an empty
result; with no labelled text every text is ``und``; extra columns are kept (``lang_pred`` and ``score`` replace namesakes).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.arrow import add_columns
from tidewell.llm.samples import fitting, turn
from tidewell.llm.shared import stored

UNKNOWN = "und"
LONGEST = 5
#: Words that a worker remembers the scores of; the table is emptied when full.
HELD = 200_000
#: Letters of a stretch: an unseen run of letters counts once for each of its stretches.
STRETCH = 64
WORD = r"\p{L}+"
LETTERS = regex.compile(WORD)
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20


@dataclass
class Table:
    """Entries and the log frequency of each in each language."""

    entries: list[str]
    logs: np.ndarray

    def index(self) -> dict[str, int]:
        return {entry: i for i, entry in enumerate(self.entries)}


@dataclass
class BackoffModel:
    languages: list[str]
    words: Table
    grams: list[Table]  # by length - 1


class Scorer:
    """A model opened by a worker: rows of one matrix for known words, then for unseen ones as they come."""

    def __init__(self, model: BackoffModel):
        self.languages = model.languages
        self.known = len(model.words.entries)
        self.rows = np.zeros((self.known + HELD + 1, len(model.languages)))
        self.rows[: self.known] = model.words.logs
        self.at = model.words.index()
        self.first, self.used = self.known, self.known
        self.unseen: list[str] = []
        self.grams = [(t.index(), t.logs) for t in model.grams]

    def _add(self, word: str) -> int:
        if self.used >= len(self.rows):
            raise OverflowError("more unseen words in a text than are held")
        self.rows[self.used] = self.back_off(word)
        self.at[word] = self.used
        self.unseen.append(word)
        self.used += 1
        return self.used - 1

    def back_off(self, word: str) -> np.ndarray:
        """The scores of an unseen run of letters: the sum over its stretches."""
        padded = f" {word} "
        out = np.zeros(len(self.languages))
        for start in range(0, max(1, len(word)), STRETCH):
            # a last stretch has the closing blank as well
            end = start + STRETCH if start + STRETCH < len(word) else len(padded)
            out += self._stretch(padded, start, end)
        return out

    def _stretch(self, padded: str, start: int, end: int) -> np.ndarray:
        for n in range(min(LONGEST, len(padded)), 0, -1):
            index, logs = self.grams[n - 1]
            known = [index[g] for g in [padded[i : i + n] for i in range(start, min(end, len(padded) - n + 1))] if g in index]
            if known:
                return logs[known].mean(axis=0)
        return np.zeros(len(self.languages))

    def _forget(self) -> None:
        for word in self.unseen:
            del self.at[word]
        self.unseen.clear()
        self.used = self.known

    def total(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros(len(self.languages))
        for start in range(0, len(tokens), HELD):
            part = tokens[start : start + HELD]
            if self.used + len(part) > len(self.rows):
                self._forget()
            get, add = self.at.get, self._add
            found = [get(w, -1) for w in part]
            if min(found) < 0:
                found = [i if i >= 0 else get(w, -1) if w in self.at else add(w) for i, w in zip(found, part, strict=True)]
            out += self.rows[found].sum(axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        tokens = LETTERS.findall((text or "").lower())
        if not tokens or not self.languages:
            return UNKNOWN, 0.0
        total = self.total(tokens)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _logs(counted: pd.DataFrame, languages: list[str]) -> Table:
    """Smoothed log frequencies of all entries counted (lang, entry, n)."""
    entries = sorted(counted["entry"].unique().tolist())
    at = pd.Series(np.arange(len(entries)), index=entries)
    found = np.full((len(entries), len(languages)), 0.5)
    found[at[counted["entry"]].to_numpy(), pd.Index(languages).get_indexer(counted["lang"])] += counted["n"].to_numpy()
    totals = found.sum(axis=0) + 0.5 * len(entries)
    return Table(entries, np.log(found / totals) if entries else found)


def grams_of(words: DataFrame) -> DataFrame:
    """(size, lang, entry, n): all n-grams of counted words (lang, entry, n), blanks before and after each word."""
    padded = F.concat(F.lit(" "), F.col("entry"), F.lit(" "))
    # long runs are cut into overlapping pieces first, since a substring costs as much as what stands before it
    cut = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("entry") + 1, F.lit(STRETCH)), lambda i: F.substring(padded, i + 1, F.lit(STRETCH + LONGEST - 1)))).alias("piece"))
    each = cut.withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))))
    last = F.least(F.lit(STRETCH - 1), F.char_length("piece") - F.col("size"))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    made = each.select("size", "lang", "n", F.explode(F.transform(starts, lambda i: F.substring("piece", i + 1, F.col("size")))).alias("entry"))
    return made.groupBy("size", "lang", "entry").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> BackoffModel:
    """Counts the words and n-grams of a sample of labelled texts in Spark: those with the least hashes of their ids, at most
    ``sample`` of them, of at most ``size`` bytes together, long texts last (``samples.turn``)."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    order = [F.xxhash64("key"), F.col("key"), F.col("bytes_"), F.col("hash")]
    facts = labelled.select("key", F.octet_length("text").alias("bytes_"), F.xxhash64("text", "lang").alias("hash")).orderBy(*turn(size), *order).limit(sample)
    fits = fitting(facts, size, sample, order).select(F.col("key").alias("key_"), F.col("hash").alias("hash_")).distinct()
    part = labelled.join(F.broadcast(fits), F.col("key").eqNullSafe(F.col("key_")) & (F.xxhash64("text", "lang") == F.col("hash_")))
    tokens = part.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("entry"))
    words = stored(tokens.groupBy("lang", "entry").agg(F.count("*").alias("n")), "words")
    counted = words.toArrow().to_pandas()
    languages = sorted(counted["lang"].unique().tolist())
    grams = grams_of(words).toArrow().to_pandas()
    tables = [_logs(grams[grams["size"] == size], languages) for size in range(1, LONGEST + 1)]
    return BackoffModel(languages, _logs(counted, languages), tables)


def identify(df: DataFrame, model: BackoffModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def make():
        held = Scorer(shipped.value)

        def work(column: pa.Array) -> list:
            found = [held.predict(value) for value in column.to_pylist()]
            return [[x for x, _ in found], [s for _, s in found]]

        return work

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return add_columns(df, text, new, make, keep_text)
