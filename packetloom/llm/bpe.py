"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each partition's texts are split by the tokenizer's pattern into words. A word that is a token as a whole is that token. Any other one is parted where no
token of the vocabulary could reach across, which no merge does either, and the pieces that a Python worker does not know yet go to an
in-process DuckDB as rows (piece, position, token). A recursive query joins neighbours to the table of mergeable pairs and contracts each piece's
leftmost pair of the smallest rank, round by round, until none is left. Ordered aggregation gives the pieces' ids and, joined to the
vocabulary, the bytes they decode to. A text's ids and decoded bytes are its pieces' in order; the decoded bytes come from the ids alone.
Words and pieces are numbered as they are met, and what belongs to a number lies in arrays, so a text is a row of numbers until it is joined.

The same rule holds for words of every length. A round contracts later places of the smallest rank too, as far as no contraction before them makes a pair
of a still smaller rank, so long runs end in few rounds. Rows of all rounds stay with a recursive query, so one goes on for as many
rounds as ``QUERY_ROWS`` allows, and the next one takes up the pieces that are still open.

Null texts are empty and have no tokens; texts of any length are encoded whole; repeated rows give repeated results; an empty table gives no
rows. Only the key and text columns are read, whatever other columns there are; a null or repeated key is carried as it is.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import HELD, map_arrow, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
QUERY_BYTES = 1 << 18
QUERY_ROWS = 1_500_000
CACHE_BYTES = 48 << 20
WINDOW, _BITS = 8, 20
_NO_PAIR = 2_000_000_000
_BLOCK = 1 << 15

# t: rows of round i; p and q: the ends of a token and of the next one; r: what the pair of both becomes, times four, plus marks
# (2: a contraction may make a pair of a smaller rank; 1: it may do so beside another one of its kind)
_CONTRACT = f"""
with recursive t(i, w, p, q, tok, nxt, r) as (
  select 0, s.w, s.p, s.q, s.tok, s.nxt, coalesce(m.r, {_NO_PAIR}) from live s left join merges m on m.a = s.tok and m.b = s.nxt
  union all
  (with best as (select w, min(r) as r, arg_min(p, r::bigint * 4294967296 + p) as first from t where i < $rounds group by w having min(r) < {_NO_PAIR}),
   place as (select t.w, t.p, t.q, t.r, b.first from t join best b on t.w = b.w and t.r = b.r),
   later as (select * from place where r % 4 > 0 and p > first),
   stop as (select w, min(p) as p from (
      select w, p - 1 as p from later where r % 2 = 1
      union all select c.w, c.p from place c semi join later l on l.w = c.w join t on t.p = c.q join trouble x on x.r = c.r and x.after = t.nxt
      union all select c.w, c.p from place c semi join later l on l.w = c.w join t on t.q = c.p join trouble x on x.r = c.r and x.ahead = t.tok) group by w),
   follow as (select a.* from place a semi join place b on b.q = a.p),
   head as (select * from place anti join follow using (p)),
   chain as (select w, p, q, r, max(opens) over (order by p rows unbounded preceding) as p0
             from (select w, p, q, r, null as opens from follow union all select h.w, h.p, h.q, h.r, h.p from head h semi join follow f on f.p = h.q)),
   free as (select w, p, q, r from head union all select c.w, c.p, c.q, c.r from chain c join vocabulary v on v.id = c.r // 4 where c.p > c.p0 and (c.p - c.p0) % v.len = 0),
   hit as (select f.p, f.q, f.r // 4 as r from free f left join stop on stop.w = f.w where f.p <= coalesce(stop.p, f.p))
  select n.i + 1, n.w, n.p, n.q, n.tok, n.nxt, case when n.fresh then coalesce(m.r, {_NO_PAIR}) else n.r end
  from (select t.i, t.w, t.p, coalesce(nx.q, t.q) as q, coalesce(me.r, t.tok) as tok, coalesce(nx.r, t.nxt) as nxt, t.r, me.r is not null or nx.r is not null as fresh
        from t semi join best on t.w = best.w left join (select q as p, r from hit union all select p, null from hit) me on me.p = t.p left join hit nx on nx.p = t.q
        where me.p is null or me.r is not null) n
  left join merges m on n.fresh and m.a = n.tok and m.b = n.nxt)
)
select t.w, t.p, t.q, t.tok, t.nxt, t.i = $rounds as open from t join (select w, max(i) as i from t group by w) l on l.w = t.w and l.i = t.i
"""
_COLLECT = "select list(w order by p) as w, list(tok order by p) as ids, list(v.len order by p) as len, string_agg(v.hex, '' order by p) as decoded from done join vocabulary v on v.id = done.tok"


def _spread(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


class Lists:
    """Lists of numbers behind each other in one array, with the size of each."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size, self.at = flat, size, np.cumsum(size) - size

    def then(self, more: Lists) -> Lists:
        return Lists(np.concatenate([self.flat, more.flat]), np.concatenate([self.size, more.size]))

    def take(self, which: np.ndarray) -> Lists:
        """The lists of these numbers, in their order."""
        size = self.size[which]
        flat, done = np.empty(size.sum(), self.flat.dtype), 0
        for k in range(0, len(which), _BLOCK):
            n = size[k : k + _BLOCK]
            end = np.cumsum(n)
            total = int(end[-1])
            flat[done : done + total] = self.flat[np.repeat(self.at[which[k : k + _BLOCK]] - (end - n), n) + np.arange(total)]
            done += total
        return Lists(flat, size)

    def joined(self, first: np.ndarray) -> Lists:
        """One list of all from each first one on to the next."""
        return Lists(self.flat, np.diff(np.append(0, np.cumsum(self.size))[np.append(first, len(self.size))]))


def _lists(found: list[bytes], kind: str) -> Lists:
    flat = np.frombuffer(b"".join(found), kind)
    return Lists(flat, np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize)


class Met(dict):
    """Numbers of what was met, given as it is looked up, and for each number its ids and the bytes that these decode to."""

    def __init__(self):
        super().__init__()
        self.ids, self.decoded = _lists([], "<u4"), _lists([], "u1")
        #: the turn in which a number was last asked for
        self.used = np.zeros(0, np.int64)
        self.turn = 0

    def __missing__(self, x: str | bytes) -> int:
        self[x] = n = len(self)
        return n

    def new(self) -> list:
        """Those that have a number and nothing else yet."""
        return list(islice(self, len(self.used), None))

    def learn(self, ids: Lists, decoded: Lists) -> None:
        """What belongs to :meth:`new`."""
        self.ids, self.decoded = self.ids.then(ids), self.decoded.then(decoded)
        self.used = np.append(self.used, np.full(len(ids.size), self.turn))

    def take(self, which: np.ndarray) -> tuple[Lists, Lists]:
        self.used[which] = self.turn
        return self.ids.take(which), self.decoded.take(which)

    def next_turn(self, at_most: int) -> None:
        """Above so many bytes keep half of them, of what was asked for last, and all of the last turn."""
        held = 180 + 4 * self.ids.size + 2 * self.decoded.size  # with the keys and numbers as Python objects
        if held.sum() > at_most:
            last = np.argsort(-self.used, kind="stable")
            stay = np.zeros(len(self), bool)
            stay[last] = (np.cumsum(held[last]) <= at_most // 2) | (self.used[last] == self.turn)
            keys, stay = list(self), np.flatnonzero(stay)
            self.ids, self.decoded, self.used = self.ids.take(stay), self.decoded.take(stay), self.used[stay]
            self.clear()
            self.update((keys[k], i) for i, k in enumerate(stay.tolist()))
        self.turn += 1


class Codec:
    """One vocabulary in one Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = []
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None:
                    pairs.append((a, b, i))
        # for each length whether tokens begin so; of longer tokens every stretch of WINDOW bytes. A mark too many costs time and no more.
        self.marks = np.zeros((WINDOW + 1, 1 << _BITS), bool)
        stretches = list({t[k : k + WINDOW] for t in self.ranks if len(t) > 1 for k in range(max(1, len(t) - WINDOW + 1))})
        self.marks[[len(t) for t in stretches], _spread(np.array([int.from_bytes(t, "little") for t in stretches], np.uint64))] = True
        # what a token needs for a pair of a smaller rank than its own: the token after it or ahead of it
        trouble = [(a, b, None) for a, b, r in pairs if r < a] + [(b, None, a) for a, b, r in pairs if r < b]
        wary, lone = {x[0] for x in trouble}, {x[0] for x in trouble if x[0] in x[1:]}
        a, b, r = np.array(pairs, np.int32).T
        mark = lambda i: i << 2 | (i in wary) << 1 | (i in lone)
        tables = {
            "merges": {"a": a, "b": b, "r": np.array([mark(i) for i in r.tolist()], np.int32)},
            "vocabulary": {"id": pa.array(self.ranks.values(), pa.int32()), "hex": [x.hex() for x in self.ranks], "len": [len(x) for x in self.ranks]},
            "trouble": dict(zip(("r", "after", "ahead"), (pa.array(x, pa.int32()) for x in zip(*[(mark(i), *x) for i, *x in trouble] or [(-1, -1, -1)], strict=True)), strict=True)),
        }
        # nothing is spilled: a query's rows are bounded
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        for name, columns in tables.items():
            self._load(name, columns)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.forget()

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("source", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from source")
        self.db.unregister("source")

    def _ids(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of pieces that are not empty, and the bytes that these decode to, contracted and decoded by queries."""
        lengths = np.array([len(x) for x in pieces])
        starts = np.cumsum(lengths) - lengths
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.zeros(len(tok), bool)
        last[starts[1:] - 1] = last[-1] = True
        p = np.arange(len(tok), dtype=np.int64)
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        self._load("live", {"w": w, "p": p, "q": np.where(last, -1, p + 1), "tok": tok, "nxt": np.where(last, -1, np.append(tok[1:], -1)).astype(np.int32)})
        self._run("create or replace table done (w int, p bigint, tok int)")
        rows = len(tok)
        while rows:
            self._run("create or replace table reached as " + _CONTRACT, {"rounds": max(1, QUERY_ROWS // rows)})
            self._run("insert into done select w, p, tok from reached where not open")
            self._run("create or replace table live as select w, p, q, tok, nxt from reached where open")
            rows = self._run("select count(*) from live")[0][0]
        found = self.db.sql(_COLLECT).to_arrow_table()
        of, ids, size = (found.column(n).combine_chunks().values.to_numpy() for n in ("w", "ids", "len"))
        flat, decoded = ids.astype("<u4").tobytes(), bytes.fromhex(found.column("decoded")[0].as_py())
        first = np.searchsorted(of, np.arange(len(pieces) + 1))
        at, to = (first * 4).tolist(), np.append(0, np.cumsum(size, dtype=np.int64))[first].tolist()
        return [(flat[a:b], decoded[c:d]) for a, b, c, d in zip(at, at[1:], to, to[1:], strict=False)]

    def _run(self, sql: str, values: dict | None = None) -> list[tuple]:
        return self.db.execute(sql, values or {}).fetchall()

    def _parts(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The words' pieces, and which of these begins each word: no token reaches from one into the next."""
        raw = b"".join(words)
        n = len(raw)
        padded = np.frombuffer(raw + bytes(WINDOW), np.uint8)
        loads = np.ndarray(n, "<u8", padded, strides=(1,)).copy()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(n)
        reach = np.ones(n, np.int64)
        for k in range(2, WINDOW + 1):
            here = self.marks[k][_spread(loads & np.uint64((1 << 8 * k) - 1))]
            reach[here & (left >= k)] = k
        far = np.maximum.accumulate(reach + np.arange(n))  # the first byte that no token met so far reaches
        cut = np.append(np.flatnonzero(far[:-1] <= np.arange(1, n)) + 1, n)
        at = cut.tolist()
        return [raw[a:b] for a, b in zip([0, *at], at, strict=False)], np.searchsorted(cut, ends - lengths, "right")

    def learn(self) -> None:
        """Find the ids of the new words and what these decode to."""
        raws = list(map(str.encode, self.words.new()))
        whole = list(map(self.ranks.get, raws))
        rest = [raw for raw, i in zip(raws, whole, strict=True) if i is None]
        tokens = [i for i in whole if i is not None]
        ids, decoded = Lists(np.array(tokens, "<u4"), np.ones(len(tokens), np.int64)), _lists(list(map(self.bytes_of.__getitem__, tokens)), "u1")
        if rest:
            pieces, first = self._parts(rest)
            which = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
            new = self.pieces.new()
            found: list = [None] * len(new)
            batch, size = [], 0
            for k, n in enumerate(sorted(range(len(new)), key=lambda n: len(new[n])), 1):  # those of a query end in like rounds
                batch.append(n)
                size += len(new[n])
                if size >= QUERY_BYTES or k == len(new):
                    for n, x in zip(batch, self._ids([new[n] for n in batch]), strict=True):
                        found[n] = x
                    batch, size = [], 0
            self.pieces.learn(_lists([x for x, _ in found], "<u4"), _lists([x for _, x in found], "u1"))
            more, more_decoded = self.pieces.take(which)
            ids, decoded = ids.then(more.joined(first)), decoded.then(more_decoded.joined(first))
        parted = np.fromiter((i is None for i in whole), bool, len(whole))
        order = np.where(parted, len(tokens) + np.cumsum(parted), np.cumsum(~parted)) - 1
        self.words.learn(ids.take(order), decoded.take(order))

    def forget(self) -> None:
        """Drop what was learnt."""
        self.words, self.pieces = Met(), Met()

    def encode(self, many: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the bytes that these decode to."""
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of pairs, none in a cycle
        try:
            self.words.next_turn(CACHE_BYTES)
            self.pieces.next_turn(CACHE_BYTES)
            number, words = self.words.__getitem__, self.pattern.findall
            which = [np.fromiter(map(number, words(x)), np.int32) for x in many]
            self.learn()
            first = np.cumsum([0, *map(len, which)])[:-1]
            out = []
            for x in self.words.take(np.concatenate([*which, np.zeros(0, np.int32)])):
                x = x.joined(first)
                ends = np.append(0, np.cumsum(x.size) * x.flat.itemsize).tolist()
                raw = x.flat.tobytes()
                out.append([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
            return list(zip(*out, strict=True))
        except BaseException:
            self.forget()  # some have a number and nothing else
            raise
        finally:
            if collects:
                gc.enable()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of an id sequence, by an ordered aggregation."""
        if not ids:
            return b""
        tok = np.frombuffer(ids, "<u4").astype(np.int32)
        self.db.register("ids", pa.table({"pos": np.arange(len(tok)), "tok": tok}))
        out = self.db.execute("select string_agg(v.hex, '' order by pos), count(*) from ids join vocabulary v on v.id = tok").fetchall()[0]
        self.db.unregister("ids")
        if out[1] != len(tok):
            raise ValueError("an id is not in the vocabulary")
        return bytes.fromhex(out[0])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The worker's codec for a vocabulary file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    HELD["bpe"] = _codecs.clear
    return _codecs[path, pattern]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, joined) and decoded (the bytes they decode to) per row.

    ``vocabulary`` names a file of ranks among the public tokenizers, which every machine has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tool = codec(public_tokenizers.path(vocabulary), pattern)
        for b in batches:
            found = tool.encode(texts(b))
            yield {"doc_id": b.column("doc_id"), "ids": [x for x, _ in found], "decoded": [x for _, x in found]}

    return map_arrow(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, ids binary, decoded binary", slice_bytes=2 << 20, keeps="bpe")


def digest(encoded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of :func:`encode`'s columns, and those of its columns that ``more`` names."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
