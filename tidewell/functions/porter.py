"""The Porter stemmer (M. F. Porter, 1980), as published, and a column function of it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWELS and not (c == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# The suffix tables of the published steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
        if cut is not None and _vowel(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in tokens:
        yield batch.map(lambda ts: [stem(t) for t in ts])
