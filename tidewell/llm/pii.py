"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, schemes, plus signs, dots between digits, digits, and cues that
announce an identifier. From each anchor a small parser expands to the boundaries and validates what it finds.

Base kinds are the leftmost matches, one after the other, of fixed patterns, whether or not an earlier match was valid:

- ``email``: from an at-sign to the left over the characters of a name, to the right over a name with a dot;
- ``ip``: from a dot between digits to the left over digits, to the right over three more numbers; all at most 255;
- ``card``: from a digit over digits that single spaces or hyphens part; 13 to 19 digits that pass Luhn's check;
- ``phone``: from a plus sign; 9 to 15 digits.

Further kinds, which the anchors allow and the patterns don't have:

- ``account``: what stands behind a cue (token, secret, password, key, account, IBAN, passport, ...) with "=" or ":" or, for a
  bank account, a space: a quoted or unbroken value, validated by the cue: a secret has 8 characters or more with a digit, an
  IBAN passes its check sum, an account or passport number has 6 digits or more;
- ``url``: an address with a scheme that carries a user's name, or a key or address in its query; mailto: with an address that
  the base pattern doesn't have is an ``email`` too;
- ``email`` written as name [at] host [dot] tld or name (at) host (dot) tld.

Spans are in code points, end exclusive. Defined cases: null and empty texts have none; whole texts of any length; rows with
null or equal ids are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.arrow import add_columns

# The kinds in their order, and the patterns of the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url")
NAME = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Cues of secrets, of numbers, of bank accounts.
SECRETS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "api key", "access_key", "access key", "private_key", "client_secret", "bearer")
NUMBERS = ("account", "acct", "passport", "ssn", "tax id", "customer id", "user id", "user_id")
BANK = ("iban",)
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
AT_WORDS = ("[at]", "(at)")

SECRET_VALUE = re.compile(r"""(?:["'])?\s?[=:]\s?(?:"([^"\s]{8,})"|'([^'\s]{8,})'|([A-Za-z0-9_~+/.=-]{8,}))""")
NUMBER_VALUE = re.compile(r"""(?:\x20(?:no|nr|number|#))?\.?\x20?[=:#]\x20?([A-Za-z]{0,3}[0-9](?:[\x20-]?[0-9]){5,})(?![0-9A-Za-z])""", re.I)
IBAN_VALUE = re.compile(r"\x20?[=:]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ADDRESS = re.compile(r"""[^\s"'<>|\\^`{}]+""")
SPELT = re.compile(r"\x20?([A-Za-z0-9-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]+)+)", re.I)
KEYED = re.compile(r"[?&](?:email|e-mail|user|username|token|key|api_key|apikey|password|phone)=[^&#]{3,}", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    value = value.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    anchors = [("@", "at"), ("+", "plus")]
    anchors += [(f"{a}.{b}", "dot") for a in "0123456789" for b in "0123456789"]
    anchors += [(f"{a}{s}{b}", "digits") for a in "0123456789" for b in "0123456789" for s in ("", " ", "-")]
    anchors += [(w, "secret") for w in SECRETS] + [(w, "number") for w in NUMBERS] + [(w, "iban") for w in BANK]
    anchors += [(w, "scheme") for w in SCHEMES] + [(w, "spelt") for w in AT_WORDS]
    for word, kind in anchors:
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def folded(text: str) -> str:
    """A-Z lower-cased, so that cues match in any case and places stay."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class Finder:
    """Finds spans in a text; ``base`` and ``more`` are (kind, start, end) in order of kinds and starts."""

    def __init__(self):
        self.anchors = automaton()
        self.parsers: dict[str, Callable[[str, int, int], None]] = {
            "at": self._email,
            "dot": self._ip,
            "digits": self._card,
            "plus": self._phone,
            "secret": self._secret,
            "number": self._number,
            "iban": self._iban,
            "scheme": self._url,
            "spelt": self._spelt,
        }

    def __call__(self, text: str) -> tuple[list[Span], list[Span]]:
        self.base: list[Span] = []
        self.more: list[Span] = []
        self.past = dict.fromkeys(self.parsers, 0)
        for last, (kind, size) in self.anchors.iter(folded(text)):
            start = last + 1 - size
            # an anchor inside what its parser has already read starts nothing
            if start >= self.past[kind]:
                self.parsers[kind](text, start, last + 1)
        order = {k: i for i, k in enumerate(KINDS)}
        ends = {k: [b for kind, _, b in self.base if kind == k] for k in BASE}
        starts = {k: [a for kind, a, _ in self.base if kind == k] for k in BASE}

        def covered(kind: str, start: int, end: int) -> bool:
            """Whether a base span of the kind, which come in order and apart from each other, has a place in common with this one."""
            at = bisect_right(ends.get(kind, []), start)
            return kind in starts and at < len(starts[kind]) and starts[kind][at] < end

        more = sorted({s for s in self.more if not covered(*s)}, key=lambda s: (order[s[0]], s[1], s[2]))
        return sorted(self.base, key=lambda s: (order[s[0]], s[1])), more

    # ---- base kinds

    def _email(self, text: str, start: int, end: int) -> None:
        first = start
        while first > self.past["at"] and NAME.match(text, first - 1):
            first -= 1
        found = DOMAIN.match(text, start) if first < start else None
        if found:
            self.base.append(("email", first, found.end()))
            self.past["at"] = found.end()

    def _ip(self, text: str, start: int, end: int) -> None:
        first = start
        while first > self.past["dot"] and "0" <= text[first - 1] <= "9":
            first -= 1
        if found := IP.match(text, first):
            self.past["dot"] = found.end()
            if all(int(n) <= 255 for n in found[0].split(".") if len(n.lstrip("0")) <= 3) and all(len(n.lstrip("0")) <= 3 for n in found[0].split(".")):
                self.base.append(("ip", first, found.end()))

    def _card(self, text: str, start: int, end: int) -> None:
        found = CARD.match(text, start)
        self.past["digits"] = found.end()
        digits = found[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            self.base.append(("card", start, found.end()))

    def _phone(self, text: str, start: int, end: int) -> None:
        if found := PHONE.match(text, start):
            self.past["plus"] = found.end()
            if 9 <= sum("0" <= c <= "9" for c in found[0]) <= 15:
                self.base.append(("phone", start, found.end()))

    # ---- further kinds

    def _alone(self, text: str, start: int) -> bool:
        """A cue begins a word."""
        return start == 0 or not text[start - 1].isalnum()

    def _secret(self, text: str, start: int, end: int) -> None:
        found = SECRET_VALUE.match(text, end) if self._alone(text, start) else None
        if found:
            at = next(k for k in (1, 2, 3) if found[k] is not None)
            if any(c.isdigit() for c in found[at]):
                self.more.append(("account", *found.span(at)))
                self.past["secret"] = found.end()

    def _number(self, text: str, start: int, end: int) -> None:
        found = NUMBER_VALUE.match(text, end) if self._alone(text, start) else None
        if found:
            self.more.append(("account", *found.span(1)))

    def _iban(self, text: str, start: int, end: int) -> None:
        found = IBAN_VALUE.match(text, end) if self._alone(text, start) else None
        if not found:
            return
        first, last = found.span(1)
        # words that follow may look like more of the number: the longest part that passes is it
        for cut in range(last, first + 14, -1):
            if text[cut - 1] != " " and (cut == len(text) or not text[cut].isalnum()) and iban_holds(text[first:cut]):
                self.more.append(("account", first, cut))
                return

    def _url(self, text: str, start: int, end: int) -> None:
        found = ADDRESS.match(text, end)
        if not found:
            return
        value = found[0].rstrip(".,;:!?)]")
        last = end + len(value)
        if text[start:end].lower() == "mailto:":
            if "@" in value:
                self.more.append(("email", end, end + len(value.partition("?")[0])))
        elif "@" in value.partition("/")[0] or KEYED.search(value):
            self.more.append(("url", start, last))
        self.past["scheme"] = last

    def _spelt(self, text: str, start: int, end: int) -> None:
        first = start - 1 if start and text[start - 1] == " " else start
        last = first
        while first > 0 and NAME.match(text, first - 1):
            first -= 1
        found = SPELT.match(text, end)
        if found and first < last and ("dot" in found[1].lower() or "." in found[1]):
            self.more.append(("email", first, found.end(1)))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted([*base, *more], key=lambda s: (order[s[0]], s[1], s[2]))


def find_pii(documents: DataFrame, text: str = "text", keep_text: bool = True, redacted: bool = False) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base spans), base_sha256 of the base spans and spans, all of them; with
    ``redacted`` also the text in which each span is replaced by its kind in brackets."""
    new = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    new += [T.StructField("redacted", T.StringType())] if redacted else []

    def make():
        find = Finder()

        def work(column: pa.Array) -> list:
            out: list[list] = [[] for _ in new]
            for body in column.to_pylist():
                base, more = find(body or "")
                every = merged(base, more)
                row = [sum(k == kind for k, _, _ in base) for kind in BASE]
                row += [hashlib.sha256(told(base).encode()).hexdigest(), told(every)]
                if redacted:
                    row.append(None if body is None else without(body, every))
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            return out

        return work

    return add_columns(documents, text, new, make, keep_text=keep_text)


def without(text: str, spans: list[Span]) -> str:
    """``text`` with spans replaced by their kinds; of spans that overlap the first and longest gives the name."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
