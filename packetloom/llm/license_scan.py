"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags over a text's words, and a
shunting-yard parser evaluates the expressions that follow tags.

A text's ASCII capitals are lowered; words are runs of ASCII letters, digits and all characters beyond ASCII. Phrases match
whole words that stand consecutively; places may overlap. Null texts are empty: no words, no places, score 0. Texts of
any length are scanned whole. Repeated rows give repeated results; an empty table gives no rows; only the key and text columns are read,
whatever other columns there are. Of expressions that cannot be parsed the permissive licences named count as labels, and their verdict is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import map_arrow, raw_texts

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: phrase: (label, how sure a reader can be that a licence is granted or reserved)
MORE_PHRASES = {
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "mit license": ("mit", 0.8),
    "apache license": ("apache", 0.8),
    "isc license": ("isc", 0.8),
    "boost software license": ("bsl", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "cc by": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.7),
    "creative commons attribution": ("cc-by", 0.8),
    "released into the public domain": ("public-domain", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAG = "spdx license identifier"
#: licences that the evaluation of an expression permits
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "0bsd", "unlicense", "zlib"}
SCHEMA = (
    "doc_id long, n_words long, places array<struct<label:string,word:long,base:boolean>>, "
    "expressions array<struct<expression:string,labels:array<string>,permitted:boolean>>, score double"
)

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAGGED = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD).split()


def parse_expression(text: str) -> list[str]:
    """Postfix form by shunting-yard; with binds before and, and before or. Raises ValueError if malformed.

    Reading stops, as a comment would, at the first token that cannot continue a complete expression.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what is due next
    for token in _TOKEN.findall(text):
        low = token.lower()
        if operand:
            if token == "(":
                stack.append("(")
            elif low in _BINDS or token == ")":
                raise ValueError(f"operand expected at {token}")
            else:
                out.append(low)
                operand = False
        elif low in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
    if operand:
        raise ValueError("the expression ends where an operand is due")
    while stack:
        if (op := stack.pop()) == "(":
            raise ValueError("a bracket is open")
        out.append(op)
    return out


def evaluate(postfix: list[str], permitted: set[str] = frozenset(PERMISSIVE)) -> tuple[set[str], bool]:
    """The licences named and whether the expression can be met by permitted ones alone; exceptions keep their licence's verdict."""
    stack: list[tuple[set[str], bool]] = []
    for x in postfix:
        if x in _BINDS:
            (lb, b), (la, a) = stack.pop(), stack.pop()
            stack.append((la, a) if x == "with" else (la | lb, a and b if x == "and" else a or b))
        else:
            stack.append(({x}, x.rstrip("+") in permitted))
    return stack[0]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *MORE_PHRASES, TAG}:
        hits = [(BASE_PHRASES[phrase], True, 0.95)] if phrase in BASE_PHRASES else []
        hits += [(MORE_PHRASES[phrase][0], False, MORE_PHRASES[phrase][1])] if phrase in MORE_PHRASES else []
        a.add_word(f" {phrase} ", (len(phrase) + 1, hits, phrase == TAG))
    a.make_automaton()
    return a


def scan_text(raw: bytes) -> tuple[int, list[dict], list[dict], float]:
    words = words_of(raw)
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, expressions, doubt, tagged = [], [], 1.0, False
    at = word = 0
    for end, (length, hits, tag) in _automaton().iter(flat):
        tagged |= tag
        start = end - length
        word, at = word + (flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)), start
        for label, base, sure in hits:
            places.append({"label": label, "word": word, "base": base})
            doubt *= 1 - sure
    if tagged:
        for m in _TAGGED.finditer(raw.decode("utf-8", "replace")):
            try:
                labels, ok = evaluate(parse_expression(m[1]))
            except ValueError:
                labels, ok = {x.lower() for x in _TOKEN.findall(m[1])} & PERMISSIVE, None
            expressions.append({"expression": m[1].strip(), "labels": sorted(labels), "permitted": ok})
            doubt *= 0.01
    places.sort(key=lambda p: (p["word"], p["label"], not p["base"]))
    return len(words), places, expressions, 1 - doubt


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: words, places of phrases (label, first word, whether it is a base phrase), tagged
    expressions with their licences and verdict, and a score that grows with the evidence for a licence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [scan_text(x) for x in raw_texts(b)]
            yield {"doc_id": b.column("doc_id"), **dict(zip(("n_words", "places", "expressions", "score"), zip(*found), strict=True))}

    return map_arrow(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """The base places of :func:`scan` summed up, all labels, the tagged expressions (each with its verdict, joined by "; ") and ``permitted``: whether
    permissive licences alone can meet all expressions, null where there is none or one cannot be parsed."""
    starts = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["word"])
    base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["label"])
    every = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    verdict = lambda e: F.when(e["permitted"], "permitted").when(~e["permitted"], "not permitted").otherwise("malformed")
    verdicts = F.transform("expressions", lambda e: e["permitted"])
    known = (F.size("expressions") > 0) & ~F.exists(verdicts, lambda v: v.isNull())
    return scanned.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(every).alias("labels"), "score",
        F.array_join(F.transform("expressions", lambda e: F.concat(e["expression"], F.lit(": "), verdict(e))), "; ").alias("expressions"),
        F.when(known, F.forall(verdicts, lambda v: v)).alias("permitted"),
    )
