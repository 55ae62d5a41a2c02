"""Personal data in plain and disguised form, with spans in the source text.

Plain identifiers are found by fixed patterns on the text as it stands. Then a chain of transducers rewrites disguises (look-alike letters,
zero-width characters, "at" and "dot" in words, spelled digits) while carrying, for each output character, the source characters it stands
for. The same patterns run over the rewritten text and their spans are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# What the patterns accept, and how disguises are written.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOK_ALIKE = dict(zip("аВсԁеҽһіјӏорԛѕԝхуᴀʙᴄΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανАСЕНІЈКМОРЅТХ", "aBcdeehijlopqswxyabcABEZHIKMNOPTYXoavACEHIJKMOPSTX", strict=True))
_HIDDEN = "­​‌‍⁠﻿"
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
           "nine": "9"}
_REPEATS = {"double": 2, "triple": 3}

_NUMBER = "|".join([*_DIGITS, *_REPEATS])
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\x20-]+)?(?:(?:{_NUMBER})(?:[\x20,-]+|[\x20]+(?:dot|point)[\x20]+)){{3,}}(?:{_NUMBER})(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"plus|dot|point|{_NUMBER}", re.I)
_BRACKETED = re.compile(r"\x20?(?:\[\x20?(at|dot)\x20?\]|\(\x20?(at|dot)\x20?\)|\{\x20?(at|dot)\x20?\}|<\x20?(at|dot)\x20?>)\x20?", re.I)
_WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++(?:\x20dot\x20[A-Za-z0-9_%+-]++)*+)(\x20at\x20|@)"
                     r"([A-Za-z0-9-]++(?:(?:\x20dot\x20|\.)[A-Za-z0-9-]++)++)", re.I)

_AT_HOST = re.compile(r"\x20at\x20[a-z0-9-]+\.[a-z0-9-]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the identifiers written plainly; linear in the text."""
    found, past = [], 0
    at = text.find("@")
    while at >= 0:
        start = past + len(text[past:at].rstrip(_LOCAL))
        past = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            past = m.end()
        at = text.find("@", past)
    if m := re.search("[0-9]", text):
        first = m.start()
        for m in _IP.finditer(text, first):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, first):
            if 14 <= m.end() - m.start() and 14 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, max(0, first - 1)):
            if 10 <= len(_only_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Traced:
    """A text together with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by the string, for disjoint edits in order. What stands for several characters covers all of them."""
        if not edits:
            return
        starts = list(range(len(self.text))) if self.starts is None else self.starts
        ends = list(range(1, len(self.text) + 1)) if self.ends is None else self.ends
        text, new_starts, new_ends, at = [], [], [], 0
        for a, b, put in edits:
            text += [self.text[at:a], put]
            new_starts += starts[at:a] + [starts[a]] * len(put)
            new_ends += ends[at:a] + [ends[b - 1]] * len(put)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = new_starts + starts[at:], new_ends + ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _fold(char: str) -> str:
    """The ASCII character that ``char`` imitates, '' for hidden ones, ``char`` itself otherwise. Accented letters stay."""
    if char in _HIDDEN:
        return ""
    if char in _LOOK_ALIKE:
        return _LOOK_ALIKE[char]
    if (digit := unicodedata.digit(char, None)) is not None and char.isdecimal():
        return str(digit)
    flat = unicodedata.normalize("NFKC", char)
    return flat if len(flat) == 1 and flat.isascii() and flat.isprintable() else char


class _Folds(dict):
    def __missing__(self, char: str) -> str:
        self[char] = _fold(char)
        return self[char]


_FOLDS = _Folds()
_WIDE = re.compile(r"[^\x00-\x7fÀ-ɏ]")


def _spelled(text: str) -> str:
    out, times = [], 1
    for part in (m[0].lower() for m in _SPELLED_PART.finditer(text)):
        if part in _REPEATS:
            times = _REPEATS[part]
            continue
        out.append("+" if part == "plus" else "." if part in ("dot", "point") else _DIGITS[part] * times)
        times = 1
    return "".join(out)


def rewritten(text: str) -> Traced:
    """The text after all transducers; untouched texts come back without a trace."""
    traced = Traced(text)
    if not text.isascii():
        traced.rewrite([(m.start(), m.end(), put) for m in _WIDE.finditer(text) if (put := _FOLDS[m[0]]) != m[0]])
    low = traced.text.lower()
    if "dot" in low or "at" in low:
        traced.rewrite([(m.start(), m.end(), "@" if (m[1] or m[2] or m[3] or m[4]).lower() == "at" else ".") for m in _BRACKETED.finditer(traced.text)])
    low = traced.text.lower()
    if " dot " in low or " at " in low and _AT_HOST.search(low):
        edits = []
        for m in _WORDED.finditer(traced.text):
            at = [(m.start(2), m.end(2), "@")] if m[2] != "@" else []
            dots = [(m.start() + d.start(), m.start() + d.end(), ".") for d in re.finditer(r"\x20dot\x20", m[0], re.I)]
            edits += sorted(at + dots)
        traced.rewrite(edits)
    if any(w in low for w in _DIGITS):
        traced.rewrite([(m.start(), m.end(), _spelled(m[0])) for m in _SPELLED.finditer(traced.text)])
    return traced


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain spans, all spans). A disguised span is added unless a plain one of its kind covers it."""
    plain = plain_spans(text)
    traced = rewritten(text)
    if traced.starts is None:
        return plain, plain
    added = set()
    for start, kind, end in plain_spans(traced.text):
        a, b = traced.source(start, end)
        if not any(k == kind and s <= a and b <= e for s, k, e in plain):
            added.add((a, kind, b))
    return plain, sorted({*plain, *added})


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        plain, spans = [], []
        for text in batch:
            base, every = find_spans(text.as_py() or "")
            plain.append(_written(base))
            spans.append(_written(base if every is base else every))
        yield pa.StructArray.from_arrays([pa.array(plain, pa.string()), pa.array(spans, pa.string())], ["base", "spans"])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): plain identifiers and all identifiers of each row, as ``kind:start:end`` in code points of the source text.

    Null and empty texts have none. Overlapping spans of different kinds are all listed, equal ones once. Repeated rows are scanned each;
    other columns are ignored; rows without an id keep their null id.
    """
    found = docs.select("doc_id", F.arrow_udf(_scan, "base string, spans string")(F.col("text")).alias("found"))
    return found.select("doc_id", "found.base", "found.spans")

