"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item occurs in a document if some stretch of it is within the item's edit budget, ``rate`` of its length. By the q-gram lemma such
a stretch shares at least ``m + 1 - q * (k + 1)`` of the item's q-grams with it, on at most ``k + 1`` neighbouring diagonals. Q-grams of a document
that an item has are counted in diagonal bands that overlap by ``k``, so every such interval of diagonals lies in one of them; bands below
the bound are dropped, and the others are verified by an alignment confined to the band. Nothing within the budget is lost.

The lemma says nothing of more than ``m // q - 1`` edits, so that is the most an item gets: ``rate`` in full from 32 characters on, at times one edit
less from 10 to 31 (none up to 15). Items of fewer than ``q`` characters have to stand in the text as they are, not as part of a longer
word (scripts written without blanks have no such borders).

Texts compare in a normal form: capitals lowered, blanks and control characters as spaces, of a run of spaces one kept and of a run of any other
character at most ``RUN``; items lose spaces at their ends. So lines that are wrapped or ruled differently are alike, and long runs make no evidence.
Budgets and edits count in that form, positions are those of the source (code points, ends exclusive). Beyond that, grams that come often
cost time in proportion to their matches; texts are read in overlapping windows and matches ``MATCHES`` at a time, so memory is bounded, and
bands whose characters, as a bag, are too few for the item are not aligned.

Items are read in chunks of at most ``CHUNK_CHARS`` characters, one pass over the documents each, so what a task holds is bounded however large the
benchmark. Items without a visible character, null items and items with a null id take no part; null and empty documents match nothing; whole texts are
scanned; repeated rows give repeated results; an empty benchmark leaves all documents clean. ``find`` reads key and text alone, ``clean`` passes
all columns on, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import map_arrow, texts
from packetloom.session import Scratch

Q, RATE = 8, 0.1
RUN = 3
CHUNK_CHARS = 1 << 20
WINDOW, MATCHES = 1 << 15, 1 << 21
HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 22
# whether a character goes on a word that stands beside it: not in scripts without blanks, nor beyond the table
_JOINS = np.array([chr(c).isalnum() and not (0xE00 <= c < 0x10A0 or 0x1780 <= c < 0x1800 or 0x2E80 <= c < 0xA4D0 or 0xF900 <= c < 0xFB00) for c in range(0x20000)] + [False])


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normal form, and the source position of each."""
    low = text.lower()
    if len(low) != len(text):  # capitals are lowered where that is one character
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c < 32) | (c == 0xA0) | (c == 0x3000) | (c - 0x2000 < 11)] = 32
    same = np.append(False, c[1:] == c[:-1])[: len(c)]
    drop = same & (c == 32)
    if len(c) > RUN:
        longer = same.copy()  # as long as RUN characters before it are the same
        for k in range(1, RUN):
            longer[k:] &= same[:-k]
        longer[:RUN] = False
        drop |= longer
    at = np.flatnonzero(~drop)
    return c[at], at


def grams(c: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(c) - q + 1), np.uint64)
    wide = c.astype(np.uint64)
    for k in range(q):
        h *= _BASE
        h += wide[k : k + len(h)]
    return h * _SPREAD


@dataclass
class Items:
    """The q-gram index of a chunk of items."""

    ids: list[int]
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    width: np.ndarray  # of a band without its overlap
    hashes: np.ndarray  # sorted, distinct
    at: np.ndarray  # of a hash's first entry; one more entry than hashes
    item: np.ndarray
    pos: np.ndarray
    bits: np.ndarray
    bags: np.ndarray  # of each item, how often it has characters of each kind
    short: dict[int, dict[bytes, list[int]]]  # by length, then codes: the ids of items of fewer than q characters


def _bag(c: np.ndarray) -> np.ndarray:
    return np.bincount((c ^ c >> 6) & 63, minlength=64)


def index(items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Items:
    short: dict[int, dict[bytes, list[int]]] = {}
    trimmed = ((i, normal(t)[0]) for i, t in items)
    visible = [(i, c[int(c[0] == 32) : len(c) - int(c[-1] == 32)]) for i, c in trimmed if (c != 32).any()]
    for i, c in visible:
        if len(c) < q:
            short.setdefault(len(c), {}).setdefault(c.tobytes(), []).append(i)
    visible = [(i, c) for i, c in visible if len(c) >= q]
    codes = [c for _, c in visible]
    m = np.array([len(c) for c in codes], np.int64)
    k = np.minimum((m * rate).astype(np.int64), m // q - 1)
    bound = np.maximum(1, m + 1 - q * (k + 1))
    width = 1 << np.ceil(np.log2(k + 2)).astype(np.int64)
    per = [grams(c, q) for c in codes]
    h = np.concatenate(per) if per else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(per), dtype=np.int32), [len(x) for x in per])
    pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in per]) if per else np.empty(0, np.int32)
    order = np.argsort(h, kind="stable")
    hashes, at = np.unique(h[order], return_index=True)
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Items([i for i, _ in visible], codes, k, bound, width, hashes, np.append(at, len(h)), item[order], pos[order], bits, np.array([_bag(c) for c in codes]).reshape(-1, 64), short)


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits (and the start and end in ``doc``) that turn the item into a stretch of ``doc``, on diagonals low..high."""
    diag = np.arange(low, high + 1, dtype=np.int64)
    one, never = np.int64(1) << 32, np.int64(1) << 60
    drift = np.arange(len(diag), dtype=np.int64) * one
    # cost and start in one number: the smaller cost, then the earlier start, wins
    row = np.where((diag >= 0) & (diag <= len(doc)), diag, never)
    padded = np.concatenate([doc, [0]])
    for j, c in enumerate(item):
        i = j + diag
        inside = (i >= 0) & (i < len(doc))
        new = np.where(inside, row + (padded[np.where(inside, i, len(doc))] != c) * one, never)
        new[:-1] = np.minimum(new[:-1], np.where((i[:-1] + 1 >= 0) & (i[:-1] + 1 <= len(doc)), row[1:] + one, never))
        row = np.minimum(np.minimum.accumulate(new - drift) + drift, never)
    best = int(row.argmin())
    return int(row[best] >> 32), int(row[best] & (one - 1)), int(len(item) + diag[best])


def _search_short(every: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tool: Items) -> list[list[tuple[int, int, int, int]]]:
    """The hits of short items, which stand as they are and do not overlap one another of their item."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    joins = _JOINS[np.minimum(every, len(_JOINS) - 1)]
    for n, known in tool.short.items():
        mine = grams(np.frombuffer(b"".join(known), "<u4"), n)[::n]
        h = grams(every, n)
        at = np.flatnonzero(np.isin(h, mine))
        doc = np.searchsorted(starts + lengths, at, "right")
        inner, last = at > starts[doc], at + n < starts[doc] + lengths[doc]
        bound = inner & joins[at] & joins[at - 1] | last & joins[at + n - 1] & joins[np.minimum(at + n, len(every) - 1)]
        free = (at - starts[doc] + n <= lengths[doc]) & ~bound
        ends: dict[tuple[int, bytes], int] = {}
        for a, d in zip(at[free].tolist(), doc[free].tolist(), strict=True):
            code = every[a : a + n].tobytes()
            if code in known and ends.get((d, code), 0) <= (s := a - int(starts[d])):
                ends[d, code] = s + n
                out[d] += [(i, s, s + n, 0) for i in known[code]]
    return out


def _bands(every: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tool: Items, q: int) -> tuple[np.ndarray, int]:
    """Bands of texts, as (text * items + item) * bands + band, that hold as many different grams of the item as its bound asks for; and how many bands a pair has."""
    h = grams(every, q)
    near = np.flatnonzero(tool.bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    found = np.searchsorted(tool.hashes, h[near])
    found[found == len(tool.hashes)] = 0
    own = tool.hashes[found] == h[near]
    near, found = near[own], found[own]
    doc = np.searchsorted(starts + lengths, near, "right")
    whole = near - starts[doc] + q <= lengths[doc]  # grams that run on into the next text are none
    near, found, doc = near[whole], found[whole], doc[whole]
    size = np.array([len(c) for c in tool.codes], np.int64)
    bands, longest = int(lengths.max() + size.max()) // 2 + 2, int(size.max())
    n = tool.at[found + 1] - tool.at[found]
    total = np.cumsum(n)
    seen, a = np.empty(0, np.int64), 0
    while a < len(near):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MATCHES)))
        # one row for each place of the gram in an item
        m = n[a:b]
        entry = np.repeat(tool.at[found[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        of = np.repeat(doc[a:b], m)
        item, pos = tool.item[entry].astype(np.int64), tool.pos[entry].astype(np.int64)
        shift = np.repeat(near[a:b], m) - starts[of] - pos + size[item]  # diagonal, from 0 on
        width, budget = tool.width[item], tool.budget[item]
        band = shift // width
        back = (shift % width < budget) & (band > 0)
        key = ((of * len(size) + item) * bands + band) * longest + pos
        some = np.concatenate([key, key[back] - longest])
        whole_text = a == 0 and b == len(near)
        seen = np.unique(some if whole_text else np.concatenate([seen, some]))
        a = b
    key = seen // longest
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return key[counts >= tool.bound[key // bands % len(size)]], bands


def search(many: list[str], tool: Items, q: int = Q) -> list[list[tuple[int, int, int, int]]]:
    """For each text the (item, start, end, edits) that it holds; of overlapping places of an item the best, then first, one."""
    forms = [normal(t) for t in many]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in many]
    # longer texts are windows that overlap by the longest stretch an item may match
    overlap = int((np.array([len(c) for c in tool.codes]) + 2 * tool.budget).max()) if tool.codes else 0
    docs, of, offset = [], [], []
    for d, (c, _) in enumerate(forms):
        for at in range(0, max(1, len(c) - overlap), WINDOW):
            docs.append(c[at : at + WINDOW + overlap])
            of.append(d)
            offset.append(at)
    lengths = np.array([len(d) for d in docs], np.int64)
    if not lengths.sum():
        return out
    every = np.concatenate(docs)
    starts = np.cumsum(lengths) - lengths
    if tool.short:
        texts_ = np.concatenate([c for c, _ in forms])
        sizes = np.array([len(c) for c, _ in forms], np.int64)
        short = _search_short(texts_, np.cumsum(sizes) - sizes, sizes, tool)
    keys, bands = _bands(every, starts, lengths, tool, q) if len(tool.hashes) else (np.empty(0, np.int64), 1)
    done: dict[tuple[int, int], tuple[int, int]] = {}
    for key in keys.tolist():
        pair, b = divmod(key, bands)
        w, i = divmod(pair, len(tool.codes))
        k, item = int(tool.budget[i]), tool.codes[i]
        m = len(item)
        low = b * int(tool.width[i]) - m
        high = low + int(tool.width[i]) + k
        exact = done.get((w, i), (0, 0))
        if exact[0] <= low - k and high + k < exact[1]:
            continue  # all that begins here overlaps a place without edits that begins before
        left, right = max(0, low - k), min(int(lengths[w]), high + k + m + k)
        region = docs[w][left:right]
        if np.minimum(_bag(region), tool.bags[i]).sum() < m - k:
            continue
        edits, s, e = align(item, region, low - k - left, high + k - left)
        if edits <= k:
            out[of[w]].append((i, s + left + offset[w], e + left + offset[w], edits))
            if not edits:
                done[w, i] = s + left, e + left
    for d, hits in enumerate(out):
        kept: dict[int, list[tuple[int, int, int, int]]] = {}
        for x in sorted(set(hits), key=lambda x: (x[3], x[1], x[2])):
            mine = kept.setdefault(x[0], [])
            at = bisect_left(mine, (x[1],), key=lambda y: (y[1],))  # kept ones do not overlap, so two neighbours tell
            if (at == len(mine) or x[2] <= mine[at][1]) and (not at or mine[at - 1][2] <= x[1]):
                mine.insert(at, x)
        found = [(tool.ids[i], s, e, n) for mine in kept.values() for i, s, e, n in mine] + (short[d] if tool.short else [])
        source = forms[d][1]
        out[d] = sorted((i, int(source[s]), int(source[e - 1]) + 1, n) for i, s, e, n in found)
    return out


def chunks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in chunks of at most ``CHUNK_CHARS`` characters (a longer item is a chunk of its own), one partition of them at a time."""
    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where((F.char_length("text") > 0) & F.col("id").isNotNull()).distinct()
    part, size = [], 0
    for r in rows.toLocalIterator():
        if part and size + len(r["text"]) > CHUNK_CHARS:
            yield sorted(part)
            part, size = [], 0
        part.append((r["id"], r["text"]))
        size += len(r["text"])
    if part:
        yield sorted(part)


def find(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id and ``hits`` (item_id, start, end, edits) of the rows of ``df`` that hold items; other rows are left out."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for part in chunks(benchmark):
        tool = index(part, rate=rate)

        def run(batches: Iterator[pa.RecordBatch], tool: Items = tool) -> Iterator[dict]:
            for b in batches:
                hits = [[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in hit] for hit in search(texts(b), tool)]
                mask = [bool(x) for x in hits]
                yield {"doc_id": b.column("doc_id").filter(pa.array(mask, pa.bool_())), "hits": [x for x in hits if x]}

        some = map_arrow(rows, run, f"doc_id long, hits {HITS}")
        out = some if out is None else out.unionByName(some)
    return out if out is not None else df.sparkSession.createDataFrame([], f"doc_id long, hits {HITS}")


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``df``, all columns, that hold no item."""
    scratch = held = out = None
    for part in chunks(benchmark):
        tool = index(part, rate=rate)

        def run(batches: Iterator[pa.RecordBatch], tool: Items = tool) -> Iterator[dict]:
            for b in batches:
                kept = b.filter(pa.array([not x for x in search(texts(b, text), tool)], pa.bool_()))
                yield {n: kept.column(n) for n in kept.schema.names}

        if out is not None:  # a pass of its own for each chunk, so a task holds one index
            scratch = scratch or Scratch(df.sparkSession, "clean")
            df = scratch.keep(out, "clean")
            if held is not None:
                scratch.drop(held)
            held = df
        out = map_arrow(df, run, df.schema)
    return df if out is None else out
