"""Personal data with source offsets, disguised spellings included.

Plain identifiers (e-mail, IP, card, phone) are found by four patterns on the text itself.
Disguised ones are found by transducers that rewrite pieces of the text (look-alike letters,
spelled digits, written-out "at" and "dot") and remember which characters every rewritten one
came from; the same patterns then run on the rewritten text and matches that touch a rewritten
piece are mapped back. A mapped span that overlaps a plain one is dropped: plain ones stay.

Offsets count code points, the end is exclusive. Defined results: null and empty texts have no
spans. Extra columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind (place in KINDS), end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, and the Latin ones.
_LIKE = (
    "аеорсухіјѕԁԛһԝ"
    "АВЕКМНОРСТУХІЈЅ"
    "οανρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "ıɡ․。．‐‑‒–−﹣"
)
_LATIN = "aeopcyxijsdqhw" "ABEKMHOPCTYXIJS" "oavpikABEZHIKMNOPTYX" "ig..." "------"
_MAP = dict(zip(_LIKE, _LATIN, strict=True))
# Digits written out, in four languages.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4",
    "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "|".join(sorted(_DIGITS, key=len, reverse=True))
_POINT = r"(?:dot|point|punkt|punto)"
# Runs of four and more spelled digits, with what may stand between them. Points inside a run
# (as in a spelled address) are rewritten by the rule for points.
_SPELLED = re.compile(rf"(?<!\w)(?:{_DIGIT})(?:[\s,.-]{{1,3}}(?:{_POINT}\s+)?(?:{_DIGIT})){{3,}}(?!\w)", re.I)
_SPELLED_PLUS = re.compile(r"(?<!\w)plus\s+$", re.I)
_ONE_DIGIT = re.compile(rf"{_DIGIT}", re.I)
_BETWEEN = re.compile(rf"[\s,.-]+(?:({_POINT})\s+)?", re.I)
_AT = re.compile(r"\s*[(\[{<]\s*(?:at|@|arroba|ät|chez)\s*[)\]}>]\s*", re.I)
_HELD_POINT = rf"[(\[{{<]\s*(?:{_POINT}|\.)\s*[)\]}}>]"
_DOT = re.compile(rf"\s*{_HELD_POINT}\s*", re.I)
# Without brackets only words count that are no ordinary words around here.
_BARE_POINT = r"(?:dot|punkt|punto)"
# A bare "at" or "arroba" counts only before a name, not an article, with a written-out or bracketed point.
_BARE_AT = re.compile(rf"(?<=\w)\s+(?:at|arroba)\s+(?!(?:the|a|an|this|that|his|her|its|their|our|your|my|some|any|every|no)\s)(?=[\w-]+(?:(?:\s+{_BARE_POINT}\s+|\s*{_HELD_POINT}\s*|\.)[\w-]+)*(?:\s+{_BARE_POINT}\s+|\s*{_HELD_POINT}\s*)[\w-])", re.I)
_BARE_DOT = re.compile(rf"(?<=\w)\s+{_BARE_POINT}\s+(?=\w)", re.I)
# Cheap signs that a text may hold a disguise at all.
_FOREIGN = re.compile("[" + re.escape(_LIKE) + "​-‍⁠­﻿！-～٠-٩۰-۹①-⑳⁰-₉\U0001d400-\U0001d7ff]")
_BRACKETED = re.compile(rf"[(\[{{<]\s*(?:at|@|arroba|ät|chez|{_POINT}|\.)\s*[)\]}}>]", re.I)
_WRITTEN_DOT = re.compile(rf"\s{_POINT}\s", re.I)
_INVISIBLE = frozenset("​‌‍⁠­﻿")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ascii_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with the longest name before it and domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[Span]:
    """Spans of undisguised identifiers by start, then kind."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _ascii_digits(m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_ascii_digits(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


class Rewritten:
    """A text after some transducers, with the source range of every character."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges of the current text; edits are in order and do not overlap."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for lo, hi, new in edits:
            text.append(self.text[at:lo])
            start += self.start[at:lo]
            end += self.end[at:lo]
            changed += self.changed[at:lo]
            text.append(new)
            start += [self.start[lo]] * len(new)
            end += [self.end[hi - 1]] * len(new)
            changed += [True] * len(new)
            at = hi
        self.text = "".join([*text, self.text[at:]])
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]
        self.changed = changed + self.changed[at:]


def fold_lookalikes(r: Rewritten) -> None:
    edits = []
    for m in _FOREIGN.finditer(r.text):
        c = m.group()
        new = "" if c in _INVISIBLE else _MAP.get(c) or unicodedata.normalize("NFKC", c)
        if not c in _MAP and len(new) == 1 and unicodedata.decimal(new, None) is not None:
            new = str(unicodedata.decimal(new))
        edits.append((m.start(), m.end(), new))
    r.replace(edits)


def fold_spelled_digits(r: Rewritten) -> None:
    edits = []
    for m in _SPELLED.finditer(r.text):
        plus = _SPELLED_PLUS.search(r.text, max(0, m.start() - 8), m.start())
        at, out = m.start(), "+" if plus else ""
        while at < m.end():
            digit = _ONE_DIGIT.match(r.text, at)
            if digit is None:
                break
            # The longest spelling that ends at a boundary; the pattern made sure of one.
            out += _DIGITS[digit.group().lower()]
            between = _BETWEEN.match(r.text, digit.end(), m.end())
            if between is None:
                break
            out += "." if between.group(1) else ""
            at = between.end()
        edits.append((plus.start() if plus else m.start(), m.end(), out))
    r.replace(edits)


def fold_at_and_dot(r: Rewritten) -> None:
    r.replace([(m.start(), m.end(), "@") for m in _BARE_AT.finditer(r.text)])
    r.replace([(m.start(), m.end(), "@") for m in _AT.finditer(r.text)])
    r.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(r.text)])
    # Bare points only next to an at sign or between digits: elsewhere they are words.
    edits = []
    for m in _BARE_DOT.finditer(r.text):
        word = re.search(r"[\w.@%+-]*\Z", r.text[max(0, m.start() - 80) : m.start()]).group()
        chained = bool(edits) and edits[-1][1] <= m.start() and " " not in r.text[edits[-1][1] : m.start()]
        after = re.match(r"[\w.-]+@", r.text[m.end() : m.end() + 80])
        if "@" in word or chained or after or (word[-1:].isdigit() and r.text[m.end()].isdigit()):
            edits.append((m.start(), m.end(), "."))
    r.replace(edits)


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans only found after rewriting, mapped back to the source."""
    foreign = _FOREIGN.search(text) is not None
    spelled = _SPELLED.search(text) is not None
    written = _BRACKETED.search(text) is not None or _WRITTEN_DOT.search(text) is not None
    if not (foreign or spelled or written):
        return []
    r = Rewritten(text)
    if foreign:
        fold_lookalikes(r)
    fold_spelled_digits(r)
    fold_at_and_dot(r)
    taken = sorted((s, e) for s, _, e in plain)
    found = []
    for s, kind, e in plain_spans(r.text):
        if not any(r.changed[s:e]):
            continue
        lo, hi = r.start[s], r.end[e - 1]
        near = bisect_right(taken, (hi,)) - 1
        if near >= 0 and taken[near][1] > lo:
            continue
        found.append((lo, kind, hi))
    return found


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with the plain spans counted by kind and digested, and all spans.

    ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` count plain spans; ``spans`` lists plain
    and disguised ones as ``kind:start:end`` by start, then kind.
    """
    names = [f"n_{k}" for k in KINDS]

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            numbers, digests, spans = [[] for _ in KINDS], [], []
            for x in batch:
                text = x.as_py() or ""
                plain = plain_spans(text)
                for k, column in enumerate(numbers):
                    column.append(sum(s[1] == k for s in plain))
                digests.append(hashlib.sha256(_written(plain).encode()).hexdigest())
                spans.append(_written(sorted(plain + disguised_spans(text, plain))))
            yield pa.StructArray.from_arrays(
                [*[pa.array(n, pa.int64()) for n in numbers], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                [*names, "base_sha256", "spans"],
            )

    results = [*names, "base_sha256", "spans"]
    return docs.drop(*results).withColumn("_found", judge(F.col("text"))).select("*", "_found.*").drop("_found")


def redact(text: str, spans: str) -> str:
    """``text`` with every span of ``spans`` replaced by its kind in angle brackets."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
