"""Operators 12 and 13 against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import periodic_runs, pii

SCHEMA = "doc_id long, text string, spans string, n_runs int, start string, past string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- 12

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    doubled = [int(d) if k % 2 == 0 else 2 * int(d) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and passes_luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(kind, *m.span()) for kind, pattern in BASE.items() for m in re.finditer(pattern, text) if valid(kind, m[0])]


@pytest.mark.parametrize("alphabet", ["a@.b-", "12 -+().3", "1234567890. ", "a1.@+ é-()0", "0.25", "+1 (2) 5-"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    chance, find = random.Random(alphabet), pii.Finder()
    for _ in range(4000):
        text = "".join(chance.choice(alphabet) for _ in range(chance.randint(0, 60)))
        assert find(text)[0] == base_spans(text), text


@pytest.mark.parametrize(
    "text,more",
    [
        ('a token = "04dbebab91ab85687d33" b', ["04dbebab91ab85687d33"]),
        ("PASSWORD: hunter2hunter2.", ["hunter2hunter2."]),
        ("the token of thanks: nothing here", []),
        ("tokens = 12345678", []),
        ("IBAN GB82 WEST 1234 5698 7654 32 and more", ["GB82 WEST 1234 5698 7654 32"]),
        ("IBAN GB82 WEST 1234 5698 7654 33", []),
        ("account no: 12-345-678; paid", ["12-345-678"]),
        ("on account of 3 things", []),
        ("see https://joe:pass@host.org/x. then", ["https://joe:pass@host.org/x"]),
        ("see https://www.host.org/licenses/x-2.0, then", []),
        ("https://host.org/?a=1&email=x%40y.org", ["https://host.org/?a=1&email=x%40y.org"]),
        ("write to jo.doe [at] mail [dot] org now", ["jo.doe [at] mail [dot] org"]),
        ("look (at) this", []),
        ("mailto:jö@host.org", ["jö@host.org"]),
        ("mail joe@host.org", []),
        ("", []),
    ],
)
def test_further_spans(text, more):
    found = pii.Finder()(text)[1]
    assert [text[a:b] for _, a, b in found] == more


def test_pii_query(spark):
    long = "word " * 40_000 + "joe@host.org " + "x" * 100_000
    rows = [(1, "é joe@host.org, +1 (017) 555-7713; 4845168114407329 at 10.0.0.1 and 999.1.1.1"), (1, "joe@host.org"), (2, None), (3, ""), (None, 'token="abcdef123456"'), (4, long)]
    documents = spark.createDataFrame([(*r, "old", 1, "s", "p") for r in rows], SCHEMA)
    found = pii.find_pii(documents, redacted=True).collect()
    assert len(found) == len(rows)
    for r in found:
        text = r["text"] or ""
        truth = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in truth)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x == k for x, _, _ in truth) for k in BASE]
        assert set(filter(None, said.split(","))) <= set(filter(None, r["spans"].split(",")))
        assert r["start"] == "s" and r["past"] == "p"
    by = {(r["doc_id"], r["text"]): r for r in found}
    assert by[1, rows[0][1]]["redacted"] == "é [email], [phone]; [card] at [ip] and 999.1.1.1"
    assert by[None, rows[4][1]]["spans"] == "account:7:19" and by[2, None]["redacted"] is None
    assert pii.find_pii(documents.limit(0)).count() == 0


# ---- 13


def brute_runs(words, least=12):
    """All maximal stretches with each period, of which those with a smaller period are left out."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(2 * q, least):
                part = words[i : i + length]
                if not any(part[r:] == part[: length - r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_tail(words, doc_id):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_collapsed(words, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_are_all_runs():
    chance = random.Random(7)
    for _ in range(250):
        documents = []
        for _ in range(chance.randint(1, 5)):
            letters, n = chance.choice([1, 2, 3, 6]), chance.randint(0, 60)
            words = [b"%d" % chance.randrange(letters) for _ in range(n)]
            if n and chance.random() < 0.5:
                words += (words[-chance.randint(1, 9) :] * 6)[: chance.randint(0, 40)]
            documents.append(words)
        for least in (2, 12):
            found = periodic_runs.runs_by_document(documents, least)
            for k, words in enumerate(documents):
                assert list(map(tuple, found[k].tolist() if k in found else [])) == brute_runs(words, least)


def test_runs_query(spark):
    chance = random.Random(3)
    rows = [(1, "a b " * 9), (2, None), (3, ""), (None, "x " * 30), (None, None), (4, "one two\tthree\x0b\nfour \x1c five " * 4 + "end"), (4, "one two three"), (5, "long " * 3 + "text of words " * 3000)]
    # ids whose hash calls for a repeated tail are among these
    rows += [(k, " ".join(chance.choice("abcdefgh") * 2 for _ in range(chance.randint(1, 80)))) for k in range(100, 180)]
    rows += [(7, "same words again and again here")] * 3
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k) > 3
    documents = spark.createDataFrame([(*r, "old", 1, "s", "p") for r in rows], SCHEMA).repartition(3)
    found = periodic_runs.find_runs(documents, alter=True, collapsed_text=True).collect()
    assert len(found) == len(rows)
    for r in found:
        words = brute_tail(WORD.findall(r["text"] or ""), r["doc_id"])
        runs = brute_runs(words) if len(words) < 1000 else [(r["start"], r["length"], r["period"])]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(runs) or len(words) >= 1000
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        if len(words) < 1000:
            assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
            text = " ".join(brute_collapsed(words, runs))
            assert r["collapsed_text"] == text and r["collapsed_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["past"] == "p" and r["spans"] == "old"
    assert (3, 9000, 3) in [(r["start"], r["length"], r["period"]) for r in found]
    assert periodic_runs.find_runs(documents.limit(0)).count() == 0
    plain = {r["doc_id"]: r["n"] for r in periodic_runs.find_runs(documents).where("doc_id = 1").select("doc_id", F.size("runs").alias("n")).collect()}
    assert plain == {1: 1}
