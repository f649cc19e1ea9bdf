"""Operators 6 to 10: round trips, brute force and held-out accuracy on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, components, jaccard_join, language_id, quality_crf, toxicity

SCHEMA = "doc_id long, text string, score string"
ODD = [(1, None, "x"), (2, "", "x"), (3, "  \n\t ", "x"), (4, "word", "x"), (5, "Ünï çødé 漢字 \U0001f600 1234", "x"), (5, "word", "y"), (None, "no id", "z"), (7, "a" * 20000 + " " + "b " * 9000, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


# ---- 6


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, public_tokenizers.PATTERN, encoding


def test_ids_are_the_librarys(odd, tokenizer):
    ranks, pattern, encoding = tokenizer
    for r in byte_bpe.encode(odd, ranks, pattern).collect():
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "")
    for r in byte_bpe.decode(byte_bpe.encode(odd, ranks, pattern), ranks).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    texts = {r[1] or "" for r in ODD}
    for r in byte_bpe.encode_digest(odd, ranks, pattern).collect():
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    assert byte_bpe.encode(odd.limit(0), ranks, pattern).count() == 0


def test_long_and_short_words_merge_alike(tokenizer):
    ranks, pattern, encoding = tokenizer
    generator = random.Random(3)
    for size in (1, 5, 47, 48, 49, 50, 300):
        word = "".join(generator.choice("abcdeé0 -ing") for _ in range(size))
        assert byte_bpe.Codec(ranks, pattern).encode(word) == encoding.encode_ordinary(word)
        assert byte_bpe._fold_long(word.encode(), ranks) == [p for p in _plain_fold(word.encode(), ranks)]


def _plain_fold(word, ranks):
    pieces = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in ranks]
        if not pairs:
            return pieces
        _, i = min(pairs)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]


# ---- 7


def made_quality(n=240):
    generator = random.Random(5)
    word = lambda: "".join(generator.choice("aeioulnrst") for _ in range(generator.randint(2, 8)))
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        lines = [" ".join(word() for _ in range(generator.randint(6, 20))).capitalize() + "." for _ in range(generator.randint(1, 6))]
        if bad:
            lines = [" ".join(w.upper() + "!!" for w in line.split()) if i % 2 else " ".join(w + "$$$" for w in line.split()) for line in lines]
        rows.append((i, "\n".join(lines), int(not bad)))
    return rows


def test_quality_held_out(spark, odd):
    rows = made_quality()
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    field = quality_crf.fit(docs.where("doc_id % 4 != 2"), labels.where("doc_id % 4 != 2"))
    truth = {i: y for i, _, y in rows}
    found = quality_crf.score(docs.where("doc_id % 4 = 2"), field, lines=True).collect()
    assert np.mean([(r["score"] >= 0.7) == truth[r["doc_id"]] for r in found]) > 0.95
    assert all(len(r["line_good"]) == r["text"].count("\n") + 1 for r in found)
    scored = quality_crf.score(odd, field).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0 for r in scored if not (r["text"] or "").strip())
    one = quality_crf.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality_crf.score(docs, one).collect()} == {1.0}


def test_forward_backward_by_enumeration():
    generator = np.random.RandomState(0)
    document = np.repeat([0, 1, 2], [4, 1, 3])
    score, pair = generator.randn(8), generator.randn(2, 2)
    good, pairs, total = quality_crf.forward_backward(score, pair, document)
    expected, expected_pairs, logs = np.zeros(8), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(document == d)
        weights = {}
        for code in range(2 ** len(at)):
            y = [(code >> i) & 1 for i in range(len(at))]
            weights[tuple(y)] = np.exp(sum(score[a] * v for a, v in zip(at, y)) + sum(pair[p, q] for p, q in zip(y, y[1:])))
        z = sum(weights.values())
        logs += np.log(z)
        for y, w in weights.items():
            expected[at] += np.array(y) * w / z
            for p, q in zip(y, y[1:]):
                expected_pairs[p, q] += w / z
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs) and np.isclose(total, logs)


def plain_features(text):
    """The features of each line with a word, character by character."""
    kept = []
    for line in (text or "").split("\n"):
        words = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
        if words:
            kept.append((line.encode(), [w.encode() for w in words]))
    out = []
    for line, words in kept:
        count = {name: sum(c in chars for c in line) for name, chars in quality_crf._GROUPS.items()}
        n, letters = len(words), count["lower"] + count["upper"] + count["other"] + 1
        capped = [min(count["digit"] / n, 3), min(count["stop"] / n, 2), min(count["bang"] / n, 2), min(count["symbol"] / n, 3), min(count["pipe"] / n, 2)]
        out.append([
            count["lower"] / letters, count["upper"] / letters, *capped, count["other"] / letters, math.log1p(n) / 5, min(len(line) / n, 30) / 10,
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, float([w for _, w in kept].count(words) > 1), float(n < 5), sum(65 <= w[0] <= 90 for w in words) / n,
        ])
    return out


def test_line_features_by_plain_python():
    import pyarrow as pa

    texts = ["A line of Words here.\na line | of ## words!!\n\n \t\nWords Words words words 12 3", None, "", "é ü\né ü\nx", "one", "\n\n", "tail \x0b gap\x1cjoined\n" + "word " * 50 + "\nA line of Words here."]
    found = quality_crf.line_features(pa.array(texts))
    expected = [(i, f) for i, t in enumerate(texts) for f in plain_features(t)]
    assert found.document.tolist() == [i for i, _ in expected] and np.allclose(found.features, [f for _, f in expected])


def test_a_training_step_and_the_calibration_by_hand():
    generator = np.random.RandomState(2)
    document, label = np.repeat([0, 1, 2, 3], [3, 2, 1, 2]), np.repeat([1, 0, 0, 1], [3, 2, 1, 2])
    x = generator.randn(8, quality_crf.N)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    rows = []
    for i in range(8):
        near = [z[j] if 0 <= j < 8 and document[j] == document[i] else np.zeros(quality_crf.N) for j in (i - 1, i + 1)]
        rows.append([*z[i], *near[0], *near[1], 1.0])
    # at weights of nought every label is as likely as the other, and so is every pair
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    unary = np.array(rows).T @ (weight * (label - 0.5)) / 8
    pairs = np.zeros((2, 2))
    for i in range(1, 8):
        if document[i] == document[i - 1]:
            pairs[label[i - 1], label[i]] += 1
            pairs -= 0.25
    field = quality_crf.train(x, document, label, np.ones(8), rounds=1)
    step = lambda g: 0.1 * g / (np.abs(g) + 1e-8)
    assert np.allclose(field.unary, step(unary), atol=1e-6) and np.allclose(field.pair, step(pairs / 8), atol=1e-6)
    raw, truth = generator.rand(60), generator.randint(0, 2, 60)
    slope, offset = quality_crf.calibrate(raw, truth)
    loss = lambda a, b: np.log1p(np.exp(-(2 * truth - 1) * (a * (raw - 0.5) + b))).sum() + 0.5e-2 * a * a
    best = min(((loss(a, b), a, b) for a in np.linspace(-8, 8, 161) for b in np.linspace(-4, 4, 81)))
    assert slope == 1e-3 and best[1] <= 0.05 or loss(slope, offset) <= best[0] + 1e-9


# ---- 8

SAID = {
    "en": "the cat and the dog went to the house with a friend that was there",
    "de": "der hund und die katze gingen mit einem freund zu dem haus das dort war",
    "fr": "le chien et le chat sont avec un ami dans la maison qui est là",
}


def test_language(spark, odd):
    generator = random.Random(1)
    rows = [(i, " ".join(generator.sample(SAID[lang].split(), 8)), lang) for i in range(90) for lang in [list(SAID)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 4 != 2"))
    found = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(found[i]["lang_pred"] == lang and 0 <= found[i]["score"] <= 1 for i, _, lang in rows)
    unseen = spark.createDataFrame([(1, "hundehaus freundin katzen")], "doc_id long, text string")
    assert language_id.identify(unseen, model).first()["lang_pred"] == "de"
    edge = language_id.identify(odd, model).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in edge if not any(c.isalpha() for c in r["text"] or ""))
    nothing = language_id.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_language_model_by_recount(spark):
    """Every word and n-gram of the sample is counted, those of long runs too."""
    texts = [("Abc abd-abc", "x"), ("zz Éa\u0301 " + "q" * 70 + "rs" * 40, "y"), ("abc", "y")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    words, grams = {"x": collections.Counter(), "y": collections.Counter()}, [{"x": collections.Counter(), "y": collections.Counter()} for _ in range(5)]
    for text, lang in texts:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words[lang][w] += 1
            for n in range(1, 6):
                grams[n - 1][lang].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    for table, counts in zip([model.words, *model.grams], [words, *grams]):
        entries = sorted(set(counts["x"]) | set(counts["y"]))
        assert table.entries == entries and model.languages == ["x", "y"]
        for j, lang in enumerate("xy"):
            total = sum(counts[lang].values()) + len(entries)
            assert np.allclose(table.logs[:, j], [math.log((counts[lang][e] + 0.5) / total) for e in entries])


def test_ties_and_samples(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "ab", "w")], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert {r["lang_pred"] for r in language_id.identify(df, model).collect()} == {"w"}
    none = language_id.fit(df, size=1)
    assert none.languages == [] and language_id.fit(df, sample=1).languages in (["x"], ["w"])


def test_language_of_a_long_run(spark):
    rows = [(i, x, lang) for i, (x, lang) in enumerate([("abab abba baab", "one"), ("xyxy yxxy xxyy", "two")] * 5)]
    rows.append((99, "b" * 64 + "q" * 200, "one"))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "ab" * 32 + "xy" * 10_000)], "doc_id long, text string")
    assert language_id.identify(asked, model).first()["lang_pred"] == "two"
    assert "q" in model.grams[0].entries


def test_backoff_takes_the_longest_known_grams():
    table = lambda d: language_id.Table(list(d), np.array([v for v in d.values()], dtype=float).reshape(len(d), 2))
    grams = [table({"a": [-1, -2]}), table({"ab": [-3, -1], "bc": [-5, -1]}), table({}), table({}), table({})]
    scorer = language_id.Scorer(language_id.BackoffModel(["x", "y"], table({"known": [-1, -9]}), grams))
    assert scorer.back_off("abc").tolist() == [-4, -1] and scorer.back_off("qa").tolist() == [-1, -2] and scorer.back_off("q").tolist() == [0, 0]
    assert scorer.predict("known") [0] == "x" and scorer.predict("abc")[0] == "y"


# ---- 9


def made_toxic(n=300):
    generator = random.Random(9)
    calm = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame") for b in ("um", "sum", "or", "et", "ta", "na")]
    rude = ["vexler", "grumbo", "snarfit"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [generator.choice(calm) for _ in range(30)]
        if toxic:
            for _ in range(4):
                words[generator.randrange(30)] = generator.choice(rude)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark, odd):
    rows = made_toxic()
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 7 != 0"), labels.where("doc_id % 7 != 0"))
    truth = {i: y for i, _, y in rows}
    found = toxicity.score(docs.where("doc_id % 7 = 0"), model, evidence=True).collect()
    assert all((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in found)
    assert all(e["label"] == truth[e["doc_id"]] for r in found for e in r["evidence"])
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(r["score"] < 0.5 for r in scored)
    assert toxicity.fit(docs, labels.where("toxic = 0")).share == 0


def random_vectors(generator, n, terms=40, each=5):
    made = []
    for _ in range(n):
        at = np.sort(generator.choice(terms, each, replace=False))
        made.append((at, toxicity.unit(at, generator.randint(1, 5, each).astype(float), np.ones(terms))))
    return made


def test_nearest_by_brute_force():
    generator = np.random.RandomState(4)
    vectors = random_vectors(generator, 300)
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    for trial, (at, q) in enumerate(random_vectors(generator, 40)):
        asked, without = dict(zip(at, q)), trial if trial % 2 else -1
        scores = [(sum(asked.get(t, 0) * w for t, w in zip(*v)), i) for i, v in enumerate(vectors) if i != without]
        expected = sorted((x for x in scores if x[0] > 0), key=lambda x: (-round(x[0], 10), x[1]))[:15]
        cosines, near = index.nearest(at, q, without=without)
        assert np.allclose(cosines, [x for x, _ in expected])
        # among equal cosines at the end any may stand
        assert {i for i, c in zip(near, cosines) if c > cosines[-1] + 1e-9} == {i for x, i in expected if x > expected[-1][0] + 1e-9}


def test_blocks_are_skipped_only_below_the_bound(monkeypatch):
    generator = np.random.RandomState(1)
    groups = [np.arange(g * 10, g * 10 + 5) for g in range(30)]
    vectors = [(g, toxicity.unit(g, generator.randint(1, 9, 5).astype(float), np.ones(300))) for g in groups for _ in range(20)]
    index = toxicity.BlockMaxIndex(vectors, 300, block=20)
    cosines, near = index.nearest(groups[7], toxicity.unit(groups[7], np.ones(5), np.ones(300)))
    assert set(near.tolist()) <= set(range(140, 160)) and len(near) == 15


def test_toxicity_model_by_hand():
    """Weights, vectors, leave-one-out votes and the calibrated score in plain Python."""
    rows = made_toxic(40)
    model = toxicity.learn([i for i, _, _ in rows], [y for _, _, y in rows], [t for _, t, _ in rows])
    bad = sum(y for *_, y in rows)
    seen, bad_seen, counted = collections.Counter(), collections.Counter(), {}
    for i, text, y in rows:
        c = collections.Counter()
        for w in text.split():
            c["=" + w] += 1
            for n in (4, 6):
                if len(w) > n:
                    c[w[:n] + "*"] += 1
        counted[i] = c
        seen.update(c.keys())
        bad_seen.update(c.keys() if y else ())
    assert set(model.terms) == set(seen)
    n, good = len(rows), len(rows) - bad

    def weight(t):
        d, a = seen[t], bad_seen[t]
        gap = a * (good - d + a) - (d - a) * (bad - a)
        return (math.log((n + 1) / (d + 1)) + 1) * (0.05 + math.log1p(n * gap * gap / (bad * good * d * (n - d + 0.5))))

    vectors = {}
    for i, c in counted.items():
        v = {t: (1 + math.log(k)) * weight(t) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    label = {i: y for i, _, y in rows}

    def voted(v, without=None):
        cosines = sorted(((sum(x * v.get(t, 0) for t, x in u.items()), j) for j, u in vectors.items() if j != without), reverse=True)[:15]
        w = [(1 / (1 - min(c, 1) + 0.05), label[j]) for c, j in cosines if c > 0]
        return sum(a * y for a, y in w) / sum(a for a, _ in w)

    x, y = model.curve
    votes = {i: voted(vectors[i], i) for i in vectors}
    # least squares: every level is the mean of the labels that fall on it
    for low, level in zip(x, y):
        assert 0 <= level <= 1 and any(abs(v - low) < 1 for v in votes.values())
    scorer = toxicity.Scorer(model)
    for i, text, _ in rows[:10]:
        assert scorer.score([text])[0][0] == pytest.approx(np.interp(voted(vectors[i]), x, y), abs=1e-6)


# ---- 10


def copies(seed, bases=5, each=8):
    generator = random.Random(seed)
    rows = []
    for b in range(bases):
        n = generator.choice([3, 8, 30, 90, 200])
        base = [f"w{generator.randrange(5000)}" for _ in range(n)]
        for _ in range(each):
            words = list(base)
            for _ in range(generator.randint(0, max(1, n // 20))):
                words[generator.randrange(n)] = f"x{generator.randrange(5000)}"
            rows.append(" ".join(words))
    generator.shuffle(rows)
    return rows


def tuples(text, k):
    """The shingles of a text as tuples of words, without the operator's own code."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", lowered) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def check_components(df, k, num):
    found = jaccard_join.jaccard_components(df, k=k, num=num).collect()
    rows = sorted({(r["doc_id"], r["text"]) for r in df.where("doc_id is not null").collect()}, key=lambda x: (x[0], x[1] or ""))
    sets = [tuples(t, k) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = find(i), find(rows[y][0])
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == {i: find(i) for i in root}
    sizes = collections.defaultdict(set)
    for (i, _), x in zip(rows, sets):
        sizes[i].add(len(x))
    assert all(r["n_shingles"] in sizes[r["doc_id"]] for r in found if r["doc_id"] is not None)
    return found


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_components(spark, k, num):
    rows = [(i + 1, t) for i, t in enumerate(copies(k))] + [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "ONE two"), (None, "one two")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, first string, component string, n_shingles int")
    found = {r["doc_id"]: r for r in check_components(df, k, num)}
    assert found[900]["n_shingles"] == 0 and found[903]["n_shingles"] == 1 and found[904]["component_id"] == 903 and found[None]["component_id"] is None
    kept = {r["doc_id"] for r in jaccard_join.one_of_each(df, k=k, num=num).collect()}
    assert kept == {i for i, r in found.items() if i is None or r["component_id"] == i}


@pytest.mark.parametrize("rounds", [4, 0])
def test_large_regions_split(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard_join, "REGION_BYTES", 4000)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    rows = [(i + 1, t) for i, t in enumerate(copies(11, bases=3, each=16))]
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)


def test_documents_that_share_a_passage(spark):
    """Strangers leave before regions are made, linked documents never do; a passage most documents share is hot."""
    generator = random.Random(8)
    word = lambda: f"u{generator.randrange(10**6)}"
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(120)] + passage)) for i in range(400)]
    rows += [(1000 + i, " ".join(passage + [word()] * (i % 2))) for i in range(6)] + [(2000 + i, rows[i][1] + " tail") for i in range(0, 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(df, 3, 90)
    check_components(df, 5, 80)
    few = jaccard_join._promising(df.select(F.col("doc_id").alias("id"), "text"), 5, jaccard_join.Threshold(80, 100))
    assert few.count() < 60


def test_linked_sets_share_smallest_hashes():
    """However the hashes of what differs lie, each of two linked sets has as many of the other's as it counts on."""
    generator = random.Random(12)
    for trial in range(3000):
        limit = jaccard_join.Threshold(generator.choice([80, 90]), 100)
        base = [generator.randrange(10**6) for _ in range(generator.choice([1, 3, 9, 10, 11, 19, 50, 99, 100, 130]))]
        low, high = generator.choice([(0, 10**6), (0, 1000), (-(10**6), 0)])
        sets = []
        for _ in range(2):
            s = set(base)
            for _ in range(generator.randint(0, 1 + len(base) // 7)):
                if generator.random() < 0.7:
                    s.add(generator.randint(low, high) + 10**6)
                elif len(s) > 1:
                    s.remove(generator.choice([min(s), max(s), generator.choice(sorted(s))]))
            sets.append(np.array(sorted(s), dtype=np.int64))
        both = len(np.intersect1d(*sets))
        if both and limit.linked(both, len(sets[0]) + len(sets[1]) - both):
            (a, need_a), (b, need_b) = (jaccard_join.smallest_hashes(s, limit) for s in sets)
            assert len(np.intersect1d(a, b)) >= max(need_a, need_b) >= 1


def test_small_sets_of_strangers_share_no_region(spark):
    generator = random.Random(4)
    rows = [(i, " ".join(f"v{generator.randrange(10**6)}" for _ in range(8))) for i in range(400)]
    sets = [jaccard_join.shingle_set(t, 5) for _, t in rows]
    sigs, owner = jaccard_join.signatures(sets, jaccard_join.Threshold(80, 100))
    held = collections.defaultdict(set)
    for sig, o in zip(sigs.tolist(), owner.tolist()):
        held[sig].add(o)
    assert max(map(len, held.values())) == 1


def test_very_long_texts_link(spark):
    words = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:28_500])), (3, " ".join(words[:20_000])), (4, " ".join(reversed(words)))]
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)


def test_cells_hold_all_links_of_any_metric_space():
    generator = random.Random(6)
    limit = jaccard_join.Threshold(80, 100)
    for trial in range(40):
        base = [set(generator.sample(range(200), 40)) for _ in range(3)]
        sets = []
        for _ in range(60):
            s = set(generator.choice(base))
            for _ in range(generator.randint(0, 20)):
                s.symmetric_difference_update({generator.randrange(400)})
            sets.append(s)
        d = np.array([[1 - len(p & s) / len(p | s) for s in sets] for p in sets[:5]])
        *cells, outside = [set(c.tolist()) for c in limit.cells(d)]
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    assert any({i, j} <= c for c in [*cells, outside])


def test_hot_texts(spark):
    rows = [(i + 1, "same text that many rows have again and again") for i in range(120)] + [(500, "Same text that many rows have again and again")]
    found = check_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {r["component_id"] for r in found} == {1}


def test_linked_sets_share_a_signature():
    generator = random.Random(2)
    for trial in range(60):
        limit, n = jaccard_join.Threshold(generator.choice([80, 90]), 100), generator.choice([1, 4, 9, 11, 40, 200])
        base = {generator.getrandbits(64) for _ in range(n)}
        sets = []
        for _ in range(6):
            s = set(base)
            for _ in range(generator.randint(0, 1 + n // 8)):
                s.symmetric_difference_update({generator.choice(sorted(base))} if generator.random() < 0.5 else {generator.getrandbits(64)})
            sets.append(np.array(sorted(s), dtype=np.uint64))
        sig, owner = jaccard_join.signatures(sets, limit)
        held = collections.defaultdict(set)
        for s, o in zip(sig.tolist(), owner.tolist()):
            held[o].add(s)
        for i in range(6):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if inter and limit.linked(inter, len(sets[i]) + len(sets[j]) - inter):
                    assert held[i] & held[j]


def test_linked_sets_share_a_signature_that_is_not_left_out():
    """Whichever signatures are frequent; and of a passage that all have, strangers keep nothing in common."""
    generator = random.Random(13)
    for trial in range(60):
        limit, n = jaccard_join.Threshold(generator.choice([80, 90]), 100), generator.choice([9, 11, 25, 40, 200])
        base = {generator.getrandbits(64) for _ in range(n)}
        sets = []
        for _ in range(6):
            s = set(base)
            for _ in range(generator.randint(0, 1 + n // 8)):
                s.symmetric_difference_update({generator.choice(sorted(base))} if generator.random() < 0.5 else {generator.getrandbits(64)})
            sets.append(np.array(sorted(s), dtype=np.uint64))
        known = np.unique(jaccard_join.signatures(sets, limit)[0])
        known = known[np.array([generator.random() < 0.7 for _ in known], dtype=bool)]
        hot = (known, np.array([generator.randint(3, 6) for _ in known], dtype=np.int64))
        sig, owner = jaccard_join.signatures(sets, limit, hot)
        held = [set(sig[owner == i].tolist()) for i in range(6)]
        for i in range(6):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if inter and limit.linked(inter, len(sets[i]) + len(sets[j]) - inter):
                    assert held[i] & held[j]
    limit, passage = jaccard_join.Threshold(80, 100), {generator.getrandbits(64)}
    strangers = [np.array(sorted(passage | {generator.getrandbits(64) for _ in range(60)}), dtype=np.uint64) for _ in range(300)]
    found, times = np.unique(jaccard_join.signatures(strangers, limit)[0], return_counts=True)
    hot = (found[times > 3], times[times > 3])
    assert np.unique(jaccard_join.signatures(strangers, limit, hot)[0], return_counts=True)[1].max() <= 3


def test_regions_that_pivots_do_not_tell_apart_stay_whole(spark):
    """Near copies of one text, all as far from each other: cells would hold each of them many times over."""
    generator = random.Random(14)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        for place in generator.sample(range(100), 4 + i % 5):
            words[place] = f"x{generator.randrange(10**6)}"
        rows.append((1, i, " ".join(words)))
    df = spark.createDataFrame(rows, "region long, id long, text string")
    _, again = jaccard_join._split(df, jaccard_join.Threshold(90, 100), 3, 10)
    held = again.collect()
    assert 0 < len(held) <= len(rows) and {r["whole"] for r in held} == {True} and {r["region"] for r in held} == {1}


def test_equal_texts_link_by_the_first(spark):
    words = " ".join(f"v{i}" for i in range(60))
    rows = [(10 + i, words) for i in range(40)] + [(5, words + " tail"), (70, "another text of some words")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r["a"], r["b"]) for r in jaccard_join._copies(df).collect()} == {(10 + i, 10) for i in range(1, 40)}
    check_components(df.withColumnRenamed("id", "doc_id"), 3, 90)


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(0, 12)] + [(100, 200), (200, 150), (7, 7), (300, 100)]
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[i] for i in range(13)} == {0} and {found[i] for i in (100, 150, 200, 300)} == {100}


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in made_toxic(60)]
    rows += [(100 + i, rows[1][1].upper(), "en", "s0", 1) for i in range(3)] + [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    base = " ".join(f"near{i}" for i in range(80))
    rows += [(300 + i, base.replace(f"near{40 + i} ", f"other{i} "), "en", "s2", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, _, y in made_toxic(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i, _, y in made_toxic(60) if y}
    assert not (toxic & kept[0]) and 1 in kept[0]
    assert 102 in kept[1] and not ({1, 100, 101} & kept[1])
    assert 300 in kept[2] and not ({301, 302} & kept[2])
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("lengths,size,kept", [([5000] + [10] * 40, 800, 40), ([5000] * 20, 800, 0), ([300, 700] * 10, 800, 2), ([10] * 100, 800, 80)])
def test_samples_skip_long_texts(spark, lengths, size, kept):
    """Wherever the long text is in the order of hashes, the others stay in the sample."""
    from tidewell.llm.samples import labelled_sample

    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    order = [r["doc_id"] for r in rows.orderBy(F.xxhash64("doc_id")).collect()]
    # the first length goes to the first id by hash
    documents = spark.createDataFrame([(i, "x" * n) for i, n in zip(order, lengths)], "doc_id long, text string")
    labels = documents.select("doc_id", F.lit(1).alias("toxic"))
    found = labelled_sample(documents, labels, "doc_id", "text", "toxic", 1000, size).collect()
    assert len(found) == kept and sum(len(r["text_"]) for r in found) <= size


@pytest.mark.parametrize("size,known", [(4000, True), (100, False)])
def test_language_is_learned_beside_a_long_text(spark, size, known):
    texts = [("the house and the garden", "en"), ("das haus und der garten", "de")] * 40
    rows = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id long, text string, lang string")
    first = rows.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long = rows.withColumn("text", F.when((F.col("doc_id") == first) | F.lit(not known), F.repeat("text", F.lit(1000))).otherwise(F.col("text")))
    found = language_id.identify(rows, language_id.fit(long, size=size)).collect()
    assert all(r["lang_pred"] == (r["lang"] if known else "und") for r in found)
