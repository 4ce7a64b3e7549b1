"""Personal data and secrets: expressions propose, checksums and entropy confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import groupby
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.rows import each, map_text, small_batches

#: Kinds whose spans are always kept, in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
#: Kinds that this method adds, listed after the others.
MORE = ("iban", "national_id", "local_phone", "secret")
#: Words near a span that speak for its kind (lower case).
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "tax", "national"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "api-key", "apikey", "password", "passwd", "pwd", "auth", "authorization", "bearer", "credential", "credentials"),
}
#: What a span scores before and with a context word, and what an added kind needs.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3, "local_phone": 0.2, "secret": 0.3}
BONUS, NEEDED, NEAR = 0.4, 0.6, 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run is entered at its first digit only and never given back, so long runs take linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
#: What a name is set to; fixed values: keys that are known by how they begin. No value has an upper bound; a run is entered at its start only.
_VALUE = re.compile(r"[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_.~-]{16,}+)")
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)?"
)
#: Marks of a private key's block, and the lines of one that has no end.
_BEGIN, _END = (re.compile(rf"-----{mark} [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----") for mark in ("BEGIN", "END"))
_KEY_LINES = re.compile(r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{1,15}={1,2})?")
_WORD = re.compile(r"[a-z-]+")
#: Bits a character that a secret value has at least; words have letters only, so it has a digit and a letter too.
ENTROPY = 3.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    left = 0
    for c in moved:
        left = int(f"{left}{int(c, 36)}") % 97
    return left == 1


def entropy(s: str) -> float:
    """Bits a character, by the value's own characters."""
    return -sum(n / len(s) * log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def _iban(m: re.Match) -> int | None:
    """Where the code ends: a match may have taken in upper-case words behind it, which go until the checksum is right."""
    for end in [len(m[0]), *(i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]:
        code = m[0][:end].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            return m.start() + end
    return None


def _emails(text: str):
    """Leftmost matches that don't overlap, found from their @, in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1 if start == at else max(floor, start)
        at = text.find("@", max(at + 1, m.end() if m else 0))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _key_blocks(text: str):
    """Private keys from their BEGIN to their END line; where another BEGIN or nothing follows, as far as lines of a key go."""
    begins = list(_BEGIN.finditer(text))
    ends = [m.end() for m in _END.finditer(text)] if begins else []
    for m, after in zip(begins, [*(m.start() for m in begins[1:]), len(text)], strict=False):
        k = bisect_left(ends, m.end())
        if k < len(ends) and ends[k] <= after:
            yield m.start(), ends[k]
        else:
            yield m.start(), _KEY_LINES.match(text, m.end(), after).end()


def propose(text: str):
    """(kind, start, end) that passed its kind's validator."""
    for a, b in _emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if end := _iban(m):
            yield "iban", m.start(), end
    for kind, p in (("national_id", _NATIONAL), ("local_phone", _LOCAL_PHONE)):
        for m in p.finditer(text):
            yield kind, m.start(), m.end()
    for a, b in _key_blocks(text):
        yield "key_block", a, b
    for m in _KNOWN.finditer(text):
        yield "known_secret", m.start(), m.end()
    for m in _VALUE.finditer(text):
        v = m[1]
        if any("0" <= c <= "9" for c in v) and any(c.isalpha() for c in v) and entropy(v) >= ENTROPY:
            yield "secret", m.start(1), m.end(1)


class _Union:
    """Spans as runs in order that don't meet."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, spans) -> None:
        runs: list[list[int]] = []
        for a, b in sorted([*zip(self.starts, self.ends, strict=True), *((s[1], s[2]) for s in spans)]):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        self.starts, self.ends = [r[0] for r in runs], [r[1] for r in runs]


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans with their scores, by kind as listed, then start.

    Base kinds stay at any score. An added kind stays if it reaches NEEDED and overlaps no
    span that is kept already; a secret may overlap base kinds. Whole keys are spans, whatever their length.
    """
    kept: list[tuple[str, int, int, float]] = []
    # what is kept so far, all of it and what was added; a pattern's own matches don't overlap
    every, added = _Union(), _Union()
    for pattern, found in groupby(propose(text), key=lambda p: p[0]):
        kind, new = "secret" if pattern in ("key_block", "known_secret") else pattern, []
        # digits of a secret may look like a base kind; that doesn't save the rest of it
        taken = added if kind == "secret" else every
        for _, a, b in found:
            near = ["key"] if kind != pattern else _WORD.findall(text[max(0, a - NEAR) : a].lower()) + _WORD.findall(text[b : b + NEAR].lower())
            score = min(1.0, SCORE[kind] + BONUS * any(w in CONTEXT[kind] for w in near))
            if kind in BASE or score >= NEEDED and not taken.meets(a, b):
                new.append((kind, a, b, score))
        kept += new
        every.add(new)
        if kind not in BASE:
            added.add(new)
    order = {k: i for i, k in enumerate(BASE + MORE)}
    return sorted(kept, key=lambda s: (order[s[0]], s[1]))


def mask(text: str, spans) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text (offsets in code points, end exclusive), their scores, counts of the
    base kinds, and the masked text. One pass, no shuffle.

    A null text counts as empty and gives no span; null ids and repeated rows are passed on.
    """

    def one(text: str):
        spans = find(text)
        base = [s for s in spans if s[0] in BASE]
        n = [sum(s[0] == k for s in base) for k in BASE]
        return (*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [s[3] for s in spans], mask(text, spans))

    cols = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>, masked string"
    return map_text(docs, lambda: each(one), cols, id_col, text_col)


def masked_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked; a null text stays null, an empty one empty, and
    null ids and repeated rows stay."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask(t, find(t)))

    return small_batches(docs).withColumn(text_col, masked(F.col(text_col)))
