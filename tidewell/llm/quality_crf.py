"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features (letter case, symbols, punctuation, repeats, length) and those of the lines before
and after it give each label a score, and neighbouring labels a score of their own. Forward-backward gives each line's
marginal; a document's quality is the mean of its lines' marginals weighted by length, calibrated on the training rows.

The field is fitted on a bounded sample of labelled documents (``sample`` rows by hash, of ``size`` bytes together), all lines
of a document carrying its label. Features are computed on whole slices of text as byte arrays.

Defined cases: null texts and texts without a word have the score of an empty text (0); texts of any length are read whole;
repeated rows are scored one by one; an empty table gives an empty result; without labels of both kinds every text scores
the share of good labels; extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.arrow import add_columns
from tidewell.llm.samples import labelled_sample

GAPS = b" \t\n\x0b\x0c\r"
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32 << 20
_GROUPS = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".,;:'\"()-?",
    "bang": b"!",
    "symbol": b"#*$%&<>@^~_=+\\/`{}[]",
    "pipe": b"|",
    "other": bytes(range(128, 256)),
}
FEATURES = [*_GROUPS, "words", "word_length", "next_word_same", "distinct", "line_again", "short", "caps_word"]
N = len(FEATURES)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(chars)] = 1
    return out


TABLES = {name: _table(chars) for name, chars in _GROUPS.items()}
GAP_TABLE = _table(GAPS).astype(bool)
#: A fixed random number for each byte, for hashes of words.
BYTE_NUMBERS = np.random.RandomState(7).randint(1, 1 << 62, 256).astype(np.uint64) | np.uint64(1)


@dataclass
class Lines:
    """Lines with a word, of the documents of a slice: features, bytes and document of each."""

    features: np.ndarray
    length: np.ndarray
    document: np.ndarray
    n_documents: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def line_features(column: pa.Array) -> Lines:
    texts = column.to_pylist()
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    ends_of_documents = np.cumsum([len(e) + 1 for e in encoded])
    line_end = np.flatnonzero(data == 10)
    gap = GAP_TABLE[data]
    word_start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    word_end = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    line_of_word = np.searchsorted(line_end, word_start)
    n_words = np.bincount(line_of_word, minlength=len(line_end))
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    sums = lambda values: np.add.reduceat(values, line_start) if len(values) else np.zeros(0)
    counts = {name: sums(t[data]).astype(float) for name, t in TABLES.items()}

    # words as numbers: the sum of their bytes' numbers, each mixed with its place in the word
    lead = word_start[0] if len(word_start) else len(data)
    place = np.arange(lead, len(data)) - np.repeat(word_start, np.diff(np.concatenate([word_start, [len(data)]])))
    numbers = BYTE_NUMBERS[data[lead:]] + place.astype(np.uint64) * _MULTIPLIER
    numbers = np.where(gap[lead:], np.uint64(0), _mix(numbers))
    running = np.concatenate([[np.uint64(0)], np.cumsum(numbers, dtype=np.uint64)])
    word = running[word_end - lead] - running[word_start - lead] if len(word_start) else np.zeros(0, np.uint64)
    same_next = np.zeros(len(word))
    same_next[1:] = (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    repeats = np.bincount(line_of_word, weights=same_next, minlength=len(line_end))
    keyed = _mix(word ^ (line_of_word.astype(np.uint64) * _MULTIPLIER))
    _, first = np.unique(keyed, return_index=True)
    distinct = np.bincount(line_of_word[first], minlength=len(line_end))
    capital = (TABLES["upper"][data[word_start]] > 0) if len(word_start) else np.zeros(0)
    capitals = np.bincount(line_of_word, weights=capital, minlength=len(line_end))

    document = np.searchsorted(ends_of_documents, line_end, side="right")
    line_sum = np.zeros(len(line_end), np.uint64)
    if len(word):
        order = np.arange(len(word)) - np.concatenate([[0], np.cumsum(n_words)[:-1]])[line_of_word]
        running = np.concatenate([[np.uint64(0)], np.cumsum(_mix(word + order.astype(np.uint64) * _MULTIPLIER), dtype=np.uint64)])
        upto = np.cumsum(n_words)
        line_sum = running[upto] - running[upto - n_words]
    keep = n_words > 0
    line_key = _mix(line_sum ^ (document.astype(np.uint64) * _MULTIPLIER))
    _, first, inverse = np.unique(line_key[keep], return_index=True, return_inverse=True)
    kept_at = np.flatnonzero(keep)
    again = np.zeros(len(line_end))
    again[kept_at] = np.bincount(inverse, minlength=len(first))[inverse] > 1 if len(kept_at) else 0

    w = np.maximum(n_words, 1)
    letters = counts["lower"] + counts["upper"] + counts["other"] + 1
    length = (line_end - line_start).astype(float)
    out = np.stack(
        [
            counts["lower"] / letters,
            counts["upper"] / letters,
            np.minimum(counts["digit"] / w, 3),
            np.minimum(counts["stop"] / w, 2),
            np.minimum(counts["bang"] / w, 2),
            np.minimum(counts["symbol"] / w, 3),
            np.minimum(counts["pipe"] / w, 2),
            counts["other"] / letters,
            np.log1p(n_words) / 5,
            np.minimum(length / w, 30) / 10,
            repeats / w,
            distinct / w,
            again,
            (n_words < 5).astype(float),
            capitals / w,
        ],
        axis=1,
    )
    return Lines(out[keep], length[keep], document[keep], len(texts))


def with_neighbours(x: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same document, and ones."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (document[1:] == document[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


@dataclass
class Field:
    """unary: the weight of each feature for "good" against "bad"; pair[a, b]: the score of label b after a."""

    unary: np.ndarray
    pair: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


def _chains(document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]])) if len(document) else np.zeros(0, int)
    lengths = np.diff(np.concatenate([starts, [len(document)]]))
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def forward_backward(score: np.ndarray, pair: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "good", expected label pairs, and the sum of log normalisers; all chains advance together."""
    n = len(score)
    node = np.stack([np.zeros(n), score], axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    starts, lengths = _chains(document)
    live = lambda t: starts[: np.searchsorted(-lengths, -t, side="left")]  # noqa: E731  chains longer than t
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    forward[starts] = node[starts]
    for t in range(1, lengths[0]):
        at = live(t) + t
        forward[at] = node[at] + np.logaddexp(forward[at - 1, :1] + pair[0], forward[at - 1, 1:] + pair[1])
    for t in range(lengths[0] - 1, 0, -1):
        at = live(t) + t
        ahead = node[at] + backward[at]
        backward[at - 1] = np.logaddexp(pair[:, 0] + ahead[:, :1], pair[:, 1] + ahead[:, 1:])
    ends = starts + lengths - 1
    total = np.logaddexp(forward[ends, 0], forward[ends, 1])
    of = np.empty(n)
    of[np.concatenate([np.arange(s, s + k) for s, k in zip(starts, lengths, strict=True)])] = np.repeat(total, lengths)
    good = np.exp(forward[:, 1] + backward[:, 1] - of)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(document[1:] == document[:-1]) + 1
    if len(inner):
        ahead = node[inner] + backward[inner] - of[inner][:, None]
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = np.exp(forward[inner - 1, a] + pair[a, b] + ahead[:, b]).sum()
    return good, pairs, float(total.sum())


def train(x: np.ndarray, document: np.ndarray, label: np.ndarray, length: np.ndarray, rounds: int = 100, decay: float = 1e-3) -> Field:
    """Maximum likelihood with all lines of a document carrying its label; classes weigh the same."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = with_neighbours((x - centre) / spread, document)
    field = Field(np.zeros(z.shape[1]), np.zeros((2, 2)), centre, spread)
    share = np.bincount(label, minlength=2) / len(label)
    weight = 0.5 / share[label]
    inner = document[1:] == document[:-1]
    true_pairs = np.bincount(2 * label[1:][inner] + label[:-1][inner], minlength=4).reshape(2, 2).T.astype(float)
    theta, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        good, pairs, _ = forward_backward(z @ theta[:-4], theta[-4:].reshape(2, 2), document)
        gradient = np.concatenate([z.T @ (weight * (label - good)) / len(z), ((true_pairs - pairs) / len(z)).ravel()]) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.unary, field.pair = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def _weighted(field: Field, x: np.ndarray, document: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """The length-weighted mean of each document's marginals; NaN without lines."""
    z = with_neighbours((x - field.centre) / field.spread, document)
    good, _, _ = forward_backward(z @ field.unary, field.pair, document)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(document, weights=good * length, minlength=n) / np.bincount(document, weights=length, minlength=n)


def calibrate(raw: np.ndarray, label: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope and offset of the logistic curve from raw quality (centred at one half) to the label; slope above 0."""
    x, slope, offset = raw - 0.5, 4.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        h = p * (1 - p) + 1e-6
        g = np.array([((label - p) * x).sum() - 1e-2 * slope, (label - p).sum()])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope + np.clip(step[0], -2, 2), offset + np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(slope), 1e-3), float(offset)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Field:
    """Fits the field on a sample of at most ``sample`` labelled documents of at most ``size`` bytes together."""
    rows = labelled_sample(documents, labels, key, text, label, sample, size)
    new = [T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("lengths", T.ArrayType(T.FloatType()))]

    def make():
        def work(column: pa.Array) -> list:
            found = line_features(column)
            cut = np.searchsorted(found.document, np.arange(found.n_documents + 1))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return [[found.features[a:b].ravel().tolist() for a, b in spans], [found.length[a:b].tolist() for a, b in spans]]

        return work

    # as Arrow: some bytes a number, however many lines there are
    got = add_columns(rows, "text_", new, make, keep_text=False).orderBy("key_", "label_", F.xxhash64("lengths")).toArrow().combine_chunks()
    truth = np.array(got["label_"].to_pylist(), dtype=int)
    if len(set(truth.tolist())) < 2:
        share = float(truth.mean()) if len(truth) else 0.5
        return Field(np.zeros(3 * N + 1), np.zeros((2, 2)), np.zeros(N), np.ones(N), constant=share)
    flat = lambda name: pc.list_flatten(got[name]).to_numpy().astype(float)
    x, length = flat("x").reshape(-1, N), flat("lengths")
    document = np.repeat(np.arange(len(truth)), pc.list_value_length(got["lengths"]).to_numpy())
    field = train(x, document, truth[document], length)
    raw = np.nan_to_num(_weighted(field, x, document, length, len(truth)), nan=0.0)
    field.slope, field.offset = calibrate(raw, truth)
    return field


def score(df: DataFrame, field: Field, text: str = "text", keep_text: bool = True, lines: bool = False) -> DataFrame:
    """Adds score; with ``lines`` also line_good, the marginal of each line that has a word."""
    new = [T.StructField("score", T.DoubleType())]
    if lines:
        new.append(T.StructField("line_good", T.ArrayType(T.DoubleType())))

    def make():
        def work(column: pa.Array) -> list:
            found = line_features(column)
            raw = _weighted(field, found.features, found.document, found.length, found.n_documents)
            if field.constant is not None:
                out = np.full(found.n_documents, field.constant)
            else:
                out = 1 / (1 + np.exp(-np.clip(field.slope * (raw - 0.5) + field.offset, -500, 500)))
            made = [np.where(np.isnan(raw), 0.0, out).tolist()]
            if lines:
                z = with_neighbours((found.features - field.centre) / field.spread, found.document)
                good = forward_backward(z @ field.unary, field.pair, found.document)[0]
                cut = np.searchsorted(found.document, np.arange(found.n_documents + 1))
                made.append([good[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)])
            return made

        return work

    return add_columns(df, text, new, make, keep_text)
