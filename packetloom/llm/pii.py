"""Personal data with offsets kept: identifiers are found in the text as it stands and in a normalised form of it, whose
spans map back to source characters.

Chained transducers make the normalised form. Each rewrites some stretches of its input and says for every character that
it writes from which source characters it comes, so a span of the last output is a span of the source:

1. look-alike characters become ASCII, invisible ones vanish;
2. disguised "dot" becomes a mark, which ends as ".";
3. runs of spelled digits ("four one two ..."), marks between them included, become digits;
4. disguised "at" becomes "@".

Each reads what the one before it wrote, and is skipped only for texts that lack what its pattern needs.

Identifiers of the source itself ("base") are leftmost, non-overlapping per kind: e-mail addresses, IPv4 addresses with parts up to
255, cards of 16 to 19 digits that pass Luhn, phone numbers of 8 to 15 digits after "+". Spans that only the normalised form
shows are added where they overlap no base span; those of different kinds may overlap one another, as base spans may. Offsets count code points, ends
exclusive. Null texts are empty and have no spans; whole texts are read, in time that grows with their length (by a factor of its logarithm at most);
repeated rows give repeated results; an empty table gives no rows. ``scan`` reads the key and the text alone; ``redact`` passes all other columns on.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import map_arrow, texts

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from each, so only run starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the identifiers, by kind and then start."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# Letters of other scripts that look like ASCII letters, and the letters they look like: fixed values.
_LOOK_ALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁɡһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοι", "ABESIJKMHOPCTYXaesijopcyxdghlABEZHIKMNOPTYXvoi", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
# Every other script's digits and the compatibility forms of ASCII come from Unicode's own tables.
_ODD = re.compile("[" + "".join(_LOOK_ALIKE) + _INVISIBLE + "²³¹٠-٩۰-۹०-९‐-―⁰-⁹①-⑨﹒﹫！-～\U0001d400-\U0001d7ff]")


@lru_cache(4096)
def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOK_ALIKE:
        return _LOOK_ALIKE[c]
    if "‐" <= c <= "―":
        return "-"
    form = unicodedata.normalize("NFKC", c)
    if len(form) == 1 and form.isascii():
        return form
    d = unicodedata.digit(c, None)
    return c if d is None else str(d)


_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(_DIGITS) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:{_WORD}|[0-9]++)(?:[ ,-]{{1,2}}|\x00))+(?:{_WORD}|[0-9]++)(?![A-Za-z0-9])", re.I | re.A)
#: Fewer digits are prose, unless dots part them as in an address.
_LEAST = 6
_ONE = re.compile(_WORD, re.I | re.A)
_ITEM = re.compile(rf"{_WORD}|[0-9]+", re.I | re.A)
# A run of blanks is tried once, from its first one: bare words stand after a letter or digit, and the blanks around brackets are added by _disguised.
_OPEN, _SHUT = r"[\[({<][ \t]*", r"[ \t]*[\])}>]"
_DOT = re.compile(rf"{_OPEN}(?:dot|\.){_SHUT}|(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?=[A-Za-z0-9])", re.I | re.A)
_AT = re.compile(rf"{_OPEN}(?:at|@){_SHUT}|(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]++\x00)", re.I | re.A)
_BLANKS = re.compile(r"[ \t]*")
_HINT = re.compile(r"[\[({<][ \t]*(?:at|@|dot|\.)[ \t]*[\])}>]|[ \t]dot[ \t]", re.I | re.A)


class Traced:
    """A text and, for each of its characters, the source span it comes from."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> Traced:
        """The output of a transducer that writes, for each (start, end, new) in order, ``new`` instead of that stretch."""
        pieces, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        if not pieces:
            return self
        pieces.append(self.text[at:])
        return Traced("".join(pieces), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


def _disguised(pattern: re.Pattern, t: Traced, new: str) -> Iterator[tuple[int, int, str]]:
    """Places of a disguised sign, with the blanks around its brackets."""
    at = 0
    for m in pattern.finditer(t.text):
        a = m.start()
        while a > at and t.text[a - 1] in " \t":
            a -= 1
        at = _BLANKS.match(t.text, m.end()).end()
        yield a, at, new


def _digits_of(t: Traced) -> Iterator[tuple[int, int, str]]:
    for run in _SPELLED.finditer(t.text):
        if not _ONE.search(run[0]):
            continue
        items = [(run.start() + m.start(), run.start() + m.end(), _DIGITS.get(m[0].lower(), m[0])) for m in _ITEM.finditer(run[0])]
        if sum(len(d) for *_, d in items) >= _LEAST or run[0].count("\x00") >= 3:
            at = run.start()
            for a, b, d in items:
                if at < a and t.text[a - 1] != "\x00":  # what stands between digits vanishes
                    yield at, a, ""
                yield a, b, d
                at = b


_LETTERS = bytes(c | 32 if chr(c).isalpha() and c < 128 else 32 for c in range(256))
_DIGIT_WORDS = frozenset(w.encode() for w in _DIGITS)


def normalise(text: str, gated: bool = True) -> Traced:
    """All transducers in order. What a gate asks for is part of every match of the pattern it stands before."""
    t = Traced(text.replace("\x00", "\x01"))  # the mark is free; neither sign is part of an identifier
    if not gated or not text.isascii():
        t = t.rewrite((m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(t.text))
    words = set(t.text.encode("utf-8", "replace").translate(_LETTERS).split()) if gated else set()
    # a bare "at" counts only before a name that a disguised dot follows, so it needs a sign too
    signs = not gated or ((b"dot" in words or any(c in t.text for c in "[({<")) and _HINT.search(t.text) is not None)
    if signs:
        t = t.rewrite(_disguised(_DOT, t, "\x00"))
    if not gated or not _DIGIT_WORDS.isdisjoint(words):
        t = t.rewrite(_digits_of(t))
    if signs:
        t = t.rewrite(_disguised(_AT, t, "@"))
        t = t.rewrite((m.start(), m.end(), ".") for m in re.finditer("\x00", t.text))
    return t


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind's number, start, end, base) by kind and start."""
    base = find(text)
    out = [(*x, True) for x in base]
    t = normalise(text)
    if t.text != text:
        taken = sorted((s, e) for _, s, e in base)
        begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for kind, a, b in find(t.text):
            start, end = int(t.starts[a]), int(t.ends[b - 1])
            before = bisect_left(begins, end)  # base spans that begin ahead of this one's end
            if text[start:end] != t.text[a:b] and not (before and reach[before - 1] > start):
                out.append((kind, start, end, False))
        out.sort()
    return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, base), one row per row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "spans": [[{"kind": KINDS[k], "start": s, "end": e, "base": o} for k, s, e, o in spans_of(x)] for x in texts(b)]}

    return map_arrow(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, f"doc_id long, spans {SPANS}")


def redact_text(text: str) -> str:
    """Each identifier gives way to its kind in brackets; spans that overlap become one, of the first one's kind."""
    pieces, at = [], 0
    merged: list[list[int]] = []
    for kind, s, e, _ in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        pieces += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = e
    return "".join([*pieces, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its texts redacted and all columns kept; null texts stay null; ``n_chars``, if there, follows the text."""
    out = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            new = [None if x is None else redact_text(x) for x in b.column(text).to_pylist()]
            columns = {n: b.column(n) for n in b.schema.names} | {text: new}
            if "n_chars" in columns:
                columns["n_chars"] = [old if x is None else len(x) for x, old in zip(new, columns["n_chars"].to_pylist(), strict=True)]
            yield columns

    return map_arrow(df, run, out)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and number and text of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
