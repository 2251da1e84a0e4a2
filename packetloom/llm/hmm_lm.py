"""Hidden Markov language model over whole words.

Tokens are words (runs of characters other than space and \\t..\\r, A-Z lowered) and one end per text. The model is class based: a hidden
state emits a class, the class emits the word. The ``OWN`` most frequent tokens are classes of their own; other words fall into ``BUCKETS``
classes by their ending, and within a class a word has the add-one share of its count. So

    P(text) = sum over state paths of prod P(state | state before) P(class | state) * prod P(word | class).

Word counts come from all training texts. Baum-Welch runs on all of them as well, over whole texts: each partition adds up expected starts, transitions and
emissions, the sums meet by key, and only the model (of fixed size) comes to the driver. For both training and scoring, texts are worked on in segments of
``SEGMENT`` tokens side by side; the segments' transfer matrices carry the exact forward and backward vectors over their borders, so
the length of a segment changes nothing but time.

Counts of the most frequent words (at most ``HOT`` of them) travel with the code; those of all other words are joined by word, so neither
frequent words nor the size of the vocabulary falls on one task. Which words are classes of their own does not depend on ``HOT``. Null texts are empty: one
end token. Texts of any length are whole. Repeated rows are rows of their own; rows with null keys count as the key "". An empty table gives no rows. Only
the key and text columns are read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import map_arrow, raw_texts
from packetloom.session import Scratch

OWN, BUCKETS, STATES = 1024, 256, 6
HOT = 1 << 17
SEGMENT, ROUNDS = 64, 3
END = b"\n"
FLUSH = 300_000
BATCH = 4096


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


@dataclass
class Counts:
    """What all scoring needs of the training counts: totals, the hot words' counts and the classes' sizes."""

    tokens: int
    types: int
    hot: dict[bytes, int]
    in_bucket: np.ndarray  # tokens and types of each bucket
    own: dict[bytes, int]

    @property
    def classes(self) -> int:
        return len(self.own) + BUCKETS

    def class_of(self, word: bytes) -> int:
        return self.own[word] if word in self.own else len(self.own) + bucket_of(word)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over a table (text): counted in each task first, so frequent words are a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for raw in raw_texts(b):
                seen.update(words_of(raw))
                seen[END] += 1
            if len(seen) > FLUSH:
                yield {"token": list(seen), "c": list(seen.values())}
                seen.clear()
        if seen:
            yield {"token": list(seen), "c": list(seen.values())}

    return map_arrow(texts, run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def gather(vocabulary: DataFrame) -> Counts:
    """Totals and the hot words: those above the lowest frequency step that at most ``HOT`` words reach. A few hundred steps, one row per
    bucket and the hot words come to the driver."""
    step = F.floor(F.log2("c") * 16).cast("int")
    fits, floor = 0, None
    for r in sorted(vocabulary.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        if fits + r["n"] > HOT:
            break
        fits, floor = fits + r["n"], r["s"]
    found = vocabulary.where(step >= floor if floor is not None else F.lit(False)).toArrow()
    hot = dict(zip(found.column("token").to_pylist(), found.column("c").to_pylist(), strict=True))
    if END not in hot:
        end = vocabulary.where(F.col("token") == F.lit(bytearray(END))).first()
        hot[END] = end["c"] if end else 0
    frequent = {bytes(r["token"]): r["c"] for r in vocabulary.orderBy(F.desc("c"), "token").limit(OWN).collect()}
    hot |= frequent
    own = {w: i for i, w in enumerate(frequent)}
    own.setdefault(END, len(own))
    ending = F.expr("substring(token, greatest(1, octet_length(token) - 1), 2)")
    inside = np.zeros((BUCKETS, 2))
    tokens = types = 0
    for r in vocabulary.groupBy((F.crc32(ending) % BUCKETS).alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        inside[r["b"]] = r["n"], r["v"]
        tokens, types = tokens + r["n"], types + r["v"]
    for w in own:
        if hot[w]:
            inside[bucket_of(w)] -= hot[w], 1
    return Counts(tokens, types, hot, inside, own)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    @staticmethod
    def initial(shares: np.ndarray, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        emit = shares * r.uniform(0.5, 1.5, (STATES, len(shares)))
        move = r.uniform(0.5, 1.5, (STATES, STATES)) + np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def flat_size(self) -> int:
        return STATES + STATES * STATES + self.emit.size

    @staticmethod
    def from_counts(flat: np.ndarray, classes: int) -> Model:
        s = STATES
        start, move, emit = flat[:s], flat[s : s + s * s].reshape(s, s), flat[s + s * s :].reshape(s, classes)
        share = lambda x, least: (x + least) / (x + least).sum(-1, keepdims=True)
        return Model(share(start, 0.1), share(move, 0.1), share(emit, 0.01))


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and text of each segment of texts that stand one after another, in order."""
    n = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[text] + k * SEGMENT, np.minimum(SEGMENT, lengths[text] - k * SEGMENT), text


def _transfers(model: Model, by_class: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the matrix from the states before it (at its first token, where it opens a text) to those at its last token, scaled, and the
    log10 of the scale."""
    s = STATES
    matrices, logs = np.empty((len(begin), s, s)), np.zeros(len(begin))
    for at in range(0, len(begin), BATCH):
        order = at + np.argsort(-size[at : at + BATCH], kind="stable")
        b, n, f = begin[order], size[order], opens[order]
        x = np.broadcast_to(np.eye(s), (len(order), s, s)).copy()
        for t in range(int(n[0])):
            m = int((n > t).sum())
            y = (x[:m].reshape(-1, s) @ model.move).reshape(m, s, s)
            if t == 0:
                y[f[:m]] = np.eye(s)
            y *= by_class[codes[b[:m] + t]][:, None, :]
            if t % 16 == 15:
                c = y.sum((1, 2))
                y /= c[:, None, None]
                logs[order[:m]] += np.log10(c)
            x[:m] = y
        matrices[order] = x
    return matrices, logs


def _ahead(model: Model, matrices: np.ndarray, text: np.ndarray, nth: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The states at each segment's last token given all up to there, and the sums that scale them; segments of a text follow one another."""
    after, sums = np.empty((len(text), STATES)), np.empty(len(text))
    state = np.empty((texts, STATES))
    for here in _by_place(nth):
        before = np.broadcast_to(model.start, (len(here), STATES)) if nth[here[0]] == 0 else state[text[here]]
        v = np.einsum("ns,nst->nt", before, matrices[here])
        sums[here] = v.sum(1)
        after[here] = state[text[here]] = v / sums[here, None]
    return after, sums


def _by_place(nth: np.ndarray) -> Iterator[np.ndarray]:
    """The first segments of all texts, their second ones, and so on."""
    order = np.argsort(nth, kind="stable")
    edges = np.flatnonzero(np.diff(nth[order], prepend=-1))
    yield from np.split(order, edges[1:])


def expected(model: Model, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions of whole texts, one after another in ``codes``; flat."""
    s, classes = STATES, model.emit.shape[1]
    begin, size, text = segments(lengths)
    nth = np.arange(len(text)) - np.searchsorted(text, text, "left")
    first, last = nth == 0, np.append(nth[1:] == 0, True)[: len(nth)]
    by_class = np.ascontiguousarray(model.emit.T)
    # states at the borders, for texts of several segments: given all before, and the chance of all behind
    before, behind = np.zeros((len(text), s)), np.ones((len(text), s))
    many = np.flatnonzero(~(first & last))
    if len(many):
        matrices, _ = _transfers(model, by_class, codes, begin[many], size[many], first[many])
        after, _ = _ahead(model, matrices, text[many], nth[many], len(lengths))
        follow = np.flatnonzero(~first[many])
        before[many[follow]] = after[follow - 1]
        for here in list(_by_place(nth[many]))[:0:-1]:
            v = np.einsum("nst,nt->ns", matrices[here], behind[many[here]])
            behind[many[here] - 1] = v / v.sum(1, keepdims=True)
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((s, classes))
    for at in range(0, len(begin), BATCH):
        order = at + np.argsort(-size[at : at + BATCH], kind="stable")
        b, n, f = begin[order], size[order], first[order]
        live = [int((n > t).sum()) for t in range(int(n[0]))]
        forward, emitted, scale = [], [], []
        for t, m in enumerate(live):
            e = by_class[codes[b[:m] + t]]
            a = (np.where(f[:, None], model.start, before[order] @ model.move) if t == 0 else forward[-1][:m] @ model.move) * e
            c = a.sum(1, keepdims=True)
            forward.append(a / c)
            emitted.append(e)
            scale.append(c)
        back = np.ones((0, s))
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            if m > len(back):  # segments that end here
                end = behind[order[len(back) : m]]
                back = np.concatenate([back, end / (forward[t][len(back) : m] * end).sum(1, keepdims=True)])
            gamma = forward[t] * back
            seen = codes[b[:m] + t]
            for k in range(s):
                emit[k] += np.bincount(seen, gamma[:, k], classes)
            ahead = emitted[t] * back / scale[t]
            if t:
                move += model.move * (forward[t - 1][:m].T @ ahead)
                back = ahead @ model.move.T
            else:
                start += gamma[f].sum(0)
                move += model.move * (before[order][~f].T @ ahead[~f])
    return np.concatenate([start, move.ravel(), emit.ravel()])


def log10_likelihood(model: Model, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 P(classes) of each text by the scaled forward recursion, exact over whole texts."""
    begin, size, text = segments(lengths)
    nth = np.arange(len(text)) - np.searchsorted(text, text, "left")
    matrices, logs = _transfers(model, np.ascontiguousarray(model.emit.T), codes, begin, size, nth == 0)
    _, sums = _ahead(model, matrices, text, nth, len(lengths))
    return np.bincount(text, np.log10(sums) + logs, len(lengths))


def code(texts: DataFrame, counts: Counts, train: Column) -> DataFrame:
    """Texts as classes, with what is known of their words here; words that are not hot are left in ``cold``."""
    total = np.log10(counts.tokens + counts.types + 1)
    share = np.log10(counts.in_bucket.sum(1) + 1)
    first_bucket, end_unseen = len(counts.own), counts.hot[END] == 0
    # columns instead of a dict: they are small to ship, and each task makes its dict of them
    words = list(counts.hot)
    classes = np.array([counts.class_of(w) for w in words], np.int64)
    logs = np.log10(np.array([counts.hot[w] for w in words], np.float64) + 1)
    inside = np.where(classes < first_bucket, 0.0, logs - share[np.maximum(classes - first_bucket, 0)])
    joined = pa.array(words, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table: dict[bytes, int] = {}
        for b in batches:
            if not table:
                table.update(zip(joined.to_pylist(), range(len(joined)), strict=True))
            lists = [[*words_of(raw), END] for raw in raw_texts(b)]
            n = np.array([len(x) for x in lists])
            first = np.cumsum(n) - n
            at = np.fromiter(map(table.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(n.sum()))
            cold = np.flatnonzero(at < 0)
            doc = np.searchsorted(first, cold, "right") - 1
            k, log, own = classes[at], logs[at], inside[at]
            rest: list[Counter[bytes]] = [Counter() for _ in lists]
            log[cold] = 0.0
            for i, d, f in zip(cold.tolist(), doc.tolist(), first[doc].tolist(), strict=True):
                w = lists[d][i - f]
                rest[d][w] += 1
                k[i] = first_bucket + bucket_of(w)
            own[cold] = -share[k[cold] - first_bucket]
            codes, ends = k.astype("<u2").tobytes(), (np.cumsum(n) * 2).tolist()
            yield {
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "codes": [codes[x:y] for x, y in zip([0, *ends], ends, strict=False)], "n_tokens": n,
                "known": n - np.bincount(doc, minlength=len(n)) - end_unseen, "base": np.add.reduceat(log, first) - total * n, "inside": np.add.reduceat(own, first),
                "cold": [[{"token": w, "n": c} for w, c in x.items()] for x in rest],
            }

    rows = texts.select("doc_id", (~train).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, codes binary, n_tokens long, known long, base double, inside double, cold array<struct<token:binary,n:long>>"
    return map_arrow(rows, run, schema).withColumn("rid", F.monotonically_increasing_id())


def _codes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raws = b.column("codes").to_pylist()
    return np.frombuffer(b"".join(raws), "<u2").astype(np.int64), np.array([len(x) // 2 for x in raws], np.int64)


def train_model(coded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the coded training texts."""
    shares = np.zeros(counts.classes)
    for w, i in counts.own.items():
        shares[i] = counts.hot.get(w, 0)
    shares[len(counts.own) :] = counts.in_bucket[:, 0]
    model = Model.initial((shares + 0.01) / (shares + 0.01).sum())
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[dict]:
            sums = np.zeros(model.flat_size())
            for b in batches:
                sums += expected(model, *_codes(b))
            at = np.flatnonzero(sums)
            yield {"k": at.astype(np.int32), "v": sums[at]}

        flat = np.zeros(model.flat_size())
        for r in map_arrow(coded.select("codes"), run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            flat[r["k"]] = r["v"]
        model = Model.from_counts(flat, counts.classes)
    return model


def score_corpus(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows of ``df`` that ``train`` (a condition on ``doc_id``) selects, and score all rows.

    Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (this model), both log10."""
    scratch = Scratch(df.sparkSession, "hmm")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    train = F.coalesce(train, F.lit(False))
    vocabulary = scratch.keep(count_tokens(rows.where(train).select("text")), "vocabulary")
    counts = gather(vocabulary)
    coded = scratch.keep(code(rows, counts, train), "coded")
    model = train_model(coded.where("not held_out"), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {n: b.column(n) for n in ("rid", "doc_id", "held_out", "n_tokens", "known", "base", "inside")} | {"path": log10_likelihood(model, *_codes(b))}

    scored = map_arrow(coded.drop("cold"), run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, path double")
    cold = coded.select("rid", F.explode("cold").alias("x")).select("rid", "x.token", "x.n")
    cold = cold.join(vocabulary, "token").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("cold_log"), F.sum("n").alias("cold_known"))
    extra = F.coalesce("cold_log", F.lit(0.0))
    return scored.join(cold, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("path") + F.col("inside") + extra).alias("score"),
    )
