"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are all words of the labelled sample and their beginnings. A term's weight is (1 + log tf) * idf * (FLOOR + log(1 + chi)),
chi being the chi-squared statistic of the term and the labels: every term counts, and more so if it goes with a label.
Each labelled text is an example, a unit vector. The index keeps each term's postings and its largest weight in each block of
examples. A text's blocks are visited by falling upper bound (the sum of block maxima times the text's weights) until the
bound is below the k-th best cosine, so the neighbours are exact. Neighbours vote with a weight that grows as their distance
falls; votes are calibrated by isotonic regression on the examples, each scored without itself. The neighbours are the
evidence.

Fitted on a bounded sample of labelled documents: at most ``sample`` rows by hash, of ``size`` bytes together.

Defined cases: null texts and texts without a term have no neighbours and score the toxic share of such texts in the sample;
texts of any length are read whole; examples of equal cosine count in the index's order; repeated rows are scored one by one;
an empty table gives an empty result; without toxic or without clean labels every text scores the toxic share, without any
labels 0; extra columns are kept (``score`` and ``evidence`` replace namesakes).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.arrow import SLICE_ROWS, add_columns
from tidewell.llm.samples import labelled_sample

TOKEN = regex.compile(r"\p{L}+")
#: Lengths of the word beginnings that are terms besides the words.
BEGINNINGS = (4, 6)
FLOOR = 0.05
BLOCK = 64
#: Terms of one example in so many are rows of a matrix.
DENSE = 8
NEIGHBOURS = 15
#: Votes weigh 1 / (distance + NEAR).
NEAR = 0.05
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20


def terms_of(word: str) -> list[str]:
    return ["=" + word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def unit(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The unit TF-IDF vector's weights at ``terms``; term frequencies are damped by a logarithm."""
    found = (1 + np.log(counts)) * weights[terms]
    norm = float(np.sqrt((found * found).sum()))
    return found / norm if norm else found


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after another, and the place of each one's range."""
    lengths = ends - starts
    of = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(of)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(of) else of, of


class BlockMaxIndex:
    """Postings of unit vectors by term, with the largest weight of each term in each block of examples.

    Terms that one example in DENSE or more has are rows of a matrix instead: their share of all cosines is one product.
    """

    def __init__(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.size, self.n_blocks = len(vectors), -(-len(vectors) // block)
        self.block = block
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) * DENSE >= max(1, len(vectors)))
        self.row = np.full(n_terms, -1, np.int64)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.matrix = np.zeros((len(common), self.size))
        self.matrix[self.row[term[dense]], example[dense]] = weight[dense]
        term, weight, example = term[~dense], weight[~dense], example[~dense]
        order = np.lexsort((example, term))
        self.term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        # a run is a term's postings in one block
        key = self.term.astype(np.int64) * max(1, self.n_blocks) + self.example // block
        self.run_start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.run_end = np.concatenate([self.run_start[1:], [len(key)]]) if len(key) else self.run_start
        self.run_block = self.example[self.run_start] // block
        self.run_top = np.maximum.reduceat(self.weight, self.run_start) if len(key) else np.zeros(0)
        self.first_run = np.searchsorted(self.term[self.run_start], np.arange(n_terms + 1))
        self.block_start = np.arange(0, max(1, self.size), block)

    def common(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosine of each vector with each example."""
        asked = np.zeros((len(vectors), len(self.matrix)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            asked[i, row[row >= 0]] = weights[row >= 0]
        return asked @ self.matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0 (cosines, examples), largest first; ties by example."""
        if not self.size:
            return np.zeros(0), np.zeros(0, np.int64)
        scores = self.common([(terms, weights)])[0] if common is None else common.copy()
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        runs, of = _ranges(self.first_run[terms], self.first_run[terms + 1])
        if 0 <= without < self.size:
            scores[without] = -1.0
        # what a block's examples have already, and at most from its runs
        bound = np.maximum.reduceat(scores, self.block_start) + np.bincount(self.run_block[runs], weights=self.run_top[runs] * weights[of], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        visited = np.zeros(self.n_blocks, bool)
        done, step, least = 0, max(2, 2 * k // self.block + 2), 0.0
        while done < len(order):
            more = order[done : done + step]
            more = more[bound[more] >= max(least - 1e-12, 1e-300)]
            if not len(more):
                break
            wanted = np.zeros(self.n_blocks, bool)
            wanted[more] = True
            visited |= wanted
            some = np.flatnonzero(wanted[self.run_block[runs]])
            at, which = _ranges(self.run_start[runs[some]], self.run_end[runs[some]])
            scores += np.bincount(self.example[at], weights=self.weight[at] * weights[of[some]][which], minlength=self.size)
            if 0 <= without < self.size:
                scores[without] = -1.0
            held = np.where(np.repeat(visited, self.block)[: self.size], scores, 0.0)
            least = float(np.partition(held, -k)[-k]) if self.size > k else 0.0
            done, step = done + step, 4 * step
        scores = np.where(np.repeat(visited, self.block)[: self.size], scores, 0.0)
        best = np.flatnonzero(scores > 0 if least <= 0 else scores >= least)
        best = best[np.lexsort((best, -scores[best]))][:k]
        return scores[best], best


@dataclass
class ToxicModel:
    """Terms with their weights, and the examples: ids, labels and vectors."""

    share: float
    bare_share: float
    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    idents: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    curve: tuple[list[float], list[float]] = field(default_factory=lambda: ([0.0, 1.0], [0.0, 1.0]))


def vote(cosines: np.ndarray, labels: np.ndarray) -> float:
    weights = 1 / (np.maximum(0.0, 1 - cosines) + NEAR)
    return float((weights * labels).sum() / weights.sum())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """The rising step curve of least squares as points to interpolate between."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2] or blocks[-2][0] / blocks[-2][2] == blocks[-1][0] / blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[2] for b in blocks], [min(1.0, max(0.0, b[1] / b[2])) for b in blocks]


class Counts:
    """Terms of texts and how often each has them."""

    def __init__(self, terms: dict[str, int]):
        self.words = {t[1:]: i for t, i in terms.items() if t[0] == "="}
        self.beginnings = [(n, {t[:-1]: i for t, i in terms.items() if t[-1] == "*" and len(t) == n + 1}) for n in BEGINNINGS]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at: list[int | None] = []
        many: list[int] = []
        counted = Counter(TOKEN.findall(text.lower()))
        at += map(self.words.get, counted)
        many += counted.values()
        for n, known in self.beginnings:
            longer = [(w[:n], k) for w, k in counted.items() if len(w) > n]
            at += [known.get(w) for w, _ in longer]
            many += [k for _, k in longer]
        found = np.array([-1 if i is None else i for i in at], np.int64)
        if not len(found) or found.max() < 0:
            return np.zeros(0, np.int64), np.zeros(0)
        held = found >= 0
        terms, where = np.unique(found[held], return_inverse=True)
        return terms, np.bincount(where, weights=np.array(many, float)[held])


class Scorer:
    """A model opened by a worker."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.index = BlockMaxIndex(model.vectors, len(model.weights))
        self.counts = Counts(model.terms)

    def score(self, texts: Sequence[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """The score of each text, and its neighbours as (cosine, example)."""
        counted = [self.counts.of(text or "") for text in texts]
        vectors = [(terms, unit(terms, counts, self.model.weights)) for terms, counts in counted]
        common = self.index.common(vectors) if self.index.size else None
        out: list[tuple[float, list[tuple[float, int]]]] = []
        for i, (terms, weights) in enumerate(vectors):
            cosines, near = self.index.nearest(terms, weights, common=common[i]) if len(terms) and common is not None else ((), ())
            if not len(near):
                out.append((self.model.bare_share, []))
                continue
            voted = vote(cosines, self.model.labels[near])
            out.append((float(np.interp(voted, *self.model.curve)), list(zip(cosines.tolist(), near.tolist(), strict=True))))
        return out


def term_weights(seen: np.ndarray, bad_seen: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Weights of terms from the numbers of documents and of toxic documents that have them."""
    n = float(bad + good)
    idf = np.log((n + 1) / (seen + 1)) + 1
    gap = bad_seen * (good - (seen - bad_seen)) - (seen - bad_seen) * (bad - bad_seen)
    chi = n * gap * gap / (float(bad * good) * seen * (n - seen + 0.5))
    return idf * (FLOOR + np.log1p(chi))


def learn(idents: list, labels: list[int], texts: list[str]) -> ToxicModel:
    """The model of labelled texts."""
    y = np.array(labels, dtype=np.int64)
    bad, good = int(y.sum()), int((1 - y).sum())
    share = bad / len(y) if len(y) else 0.0
    if not bad or not good:
        return ToxicModel(share, share)
    terms: dict[str, int] = {}
    for text in texts:
        for word in dict.fromkeys(TOKEN.findall(text.lower())):
            for t in terms_of(word):
                terms.setdefault(t, len(terms))
    counter = Counts(terms)
    counted = [counter.of(text) for text in texts]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t, _ in counted])
    flat = np.concatenate([t for t, _ in counted]) if terms else np.zeros(0, np.int64)
    seen, bad_seen = (np.bincount(flat, weights=w, minlength=len(terms)) for w in (np.ones(len(flat)), y[owner].astype(float)))
    weights = term_weights(seen, bad_seen, bad, good)
    vectors = [unit(t, c, weights) for t, c in counted]
    # examples that share their heaviest terms stand together, which keeps block maxima tight
    heaviest = [tuple(t[np.lexsort((t, -v))[:3]].tolist()) for (t, _), v in zip(counted, vectors, strict=True)]
    order = [i for i in sorted(range(len(texts)), key=lambda i: (y[i], heaviest[i], str(idents[i]))) if len(counted[i][0])]
    bare = [int(y[i]) for i in range(len(texts)) if not len(counted[i][0])]
    model = ToxicModel(share, (sum(bare) + share) / (len(bare) + 1), terms, weights)
    model.idents, model.labels = [idents[i] for i in order], y[order].astype(float)
    model.vectors = [(counted[i][0], vectors[i]) for i in order]
    index = BlockMaxIndex(model.vectors, len(weights))
    votes, truth = [], []
    for i, (t, v) in enumerate(model.vectors):
        common = index.common(model.vectors[i : i + SLICE_ROWS]) if i % SLICE_ROWS == 0 else common
        cosines, near = index.nearest(t, v, without=i, common=common[i % SLICE_ROWS])
        if len(near):
            votes.append(vote(cosines, model.labels[near]))
            truth.append(model.labels[i])
    if votes:
        model.curve = isotonic(np.array(votes), np.array(truth))
    return model


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ToxicModel:
    """Fits on a sample of at most ``sample`` labelled documents of at most ``size`` bytes together."""
    rows = labelled_sample(documents, labels, key, text, label, sample, size).orderBy("key_", "label_", F.xxhash64("text_")).collect()
    return learn([r["key_"] for r in rows], [r["label_"] for r in rows], [r["text_"] for r in rows])


def score(df: DataFrame, model: ToxicModel, text: str = "text", keep_text: bool = True, evidence: bool = False) -> DataFrame:
    """Adds score; with ``evidence`` also the neighbours, structures of doc_id, cosine and label."""
    new = [T.StructField("score", T.DoubleType())]
    if evidence:
        new.append(T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shipped.value)
        idents, labels = scorer.model.idents, scorer.model.labels

        def work(column: pa.Array) -> list:
            found = scorer.score(column.to_pylist())
            made: list = [[s for s, _ in found]]
            if evidence:
                made.append([[{"doc_id": idents[i], "cosine": c, "label": int(labels[i])} for c, i in near] for _, near in found])
            return made

        return work

    return add_columns(df, text, new, make, keep_text)
