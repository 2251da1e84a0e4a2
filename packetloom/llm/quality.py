"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network with calibrated output.

Each token has a sparse index vector of ones and minus ones, drawn from a hash of it; the vector of a token of the vocabulary is its index vector plus the
normalised sum of the index vectors of its neighbours in the training texts. A word gives up to three tokens: itself (or the mark of an unseen word, if it is
not in the vocabulary), its shape (runs of capitals, small letters and digits collapsed, other signs kept) and, if it repeats the word before it, a
mark. Stretches without blanks beyond ``PIECE`` characters count as words of that length, so texts in one run are read whole. A document is the
mean of its tokens' vectors over its words. The network has one hidden layer; its temperature is fitted on a part of the training rows that the
weights did not see.

The model is fitted on at most ``SAMPLE`` labelled texts, chosen by a hash of their keys; it never sees language, source or key. Executors count tokens, sum
contexts (in whole numbers, so in any order) and pool the texts; the ``VOCABULARY`` most frequent tokens, their contexts and one pooled vector a
text come to the driver, which trains the network: bounded by these parameters, whatever the length or number of the texts.

Scoring covers whole texts. Null texts are empty and score as a text without words. Without usable labels every score is 0.5, with labels of one kind
alone a constant. Repeated rows get equal scores, an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import as_schema, map_arrow, texts
from packetloom.llm.shingles import mix
from packetloom.session import Scratch

SAMPLE = 6000
VOCABULARY = 8192
WIDTH, HIDDEN, NONZERO, REACH = 128, 32, 8, 2
PIECE = 32
THRESHOLD = 0.3
REPEAT, UNSEEN = "\0repeat", "\0unseen"
_WORDS_KEPT = 100_000
_BLOCKS = 16
_PIECES = re.compile(rf"\S{{1,{PIECE}}}")


def words_of(text: str) -> list[str]:
    words = text.split()
    return words if not words or max(map(len, words)) <= PIECE else _PIECES.findall(text)


def shape(word: str) -> str:
    """A word's signs with runs of letters and digits collapsed: ``Hello,`` is ``Aa,``."""
    out = []
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "\0" + "".join(out)


def places(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed places of each token's NONZERO entries, and which of them are minus ones."""
    h = np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in tokens], np.uint64)
    u = np.stack([mix(h + np.uint64((k + 1) << 32)) for k in range(NONZERO)], 1)
    return (u >> np.uint64(8)).astype(np.int64) % WIDTH, np.where(u & np.uint64(1), 1, -1)


def index_vectors(tokens: list[str]) -> np.ndarray:
    """Tokens x WIDTH; entries that meet add up."""
    at, sign = places(tokens)
    flat = np.arange(len(tokens))[:, None] * WIDTH + at
    return np.bincount(flat.ravel(), sign.ravel(), len(tokens) * WIDTH).astype(np.int64).reshape(-1, WIDTH)


@dataclass
class Model:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None
    _ids: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _of(self, word: str) -> tuple[int, ...]:
        """Rows of a word's own tokens."""
        got = self._ids.get(word)
        if got is None:
            look = self.vocabulary.get
            got = (look(word, look(UNSEEN)), *(i for i in (look(shape(word)),) if i is not None))
            if len(self._ids) >= _WORDS_KEPT:
                self._ids.clear()
            self._ids[word] = got
        return got

    def pooled(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(WIDTH, np.float32)
        weights: Counter[int] = Counter()
        for w, n in Counter(words).items():
            for i in self._of(w):
                weights[i] += n
        if repeats := sum(map(eq, words, words[1:])):
            weights[self.vocabulary[REPEAT]] += repeats
        rows = np.fromiter(weights, np.int64, len(weights))
        return np.fromiter(weights.values(), np.float32, len(weights)) @ self.vectors[rows] / len(words)

    def score(self, many: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(many), self.constant)
        x = np.array([self.pooled(t) for t in many], np.float64).reshape(-1, WIDTH)
        return _sigmoid(_forward(self.layers, x)[1] / self.temperature)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ids": {}}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    return h, h @ c + d


def count_tokens(many: list[str]) -> Counter[str]:
    """Words and shapes of texts."""
    counts: Counter[str] = Counter()
    for t in many:
        counts.update(words_of(t))
    shapes: Counter[str] = Counter()
    for w, n in counts.items():
        shapes[shape(w)] += n
    return counts + shapes


def contexts_of(vocabulary: dict[str, int], many: list[str]) -> np.ndarray:
    """For each token the sum of the index vectors of the tokens up to REACH places before and after it."""
    at, sign = places(list(vocabulary))
    of: dict[str, tuple[int | None, int | None]] = {}
    near: list[np.ndarray] = []
    for t in many:
        words, line = words_of(t), []
        for k, w in enumerate(words):
            if w not in of:
                of[w] = vocabulary.get(w), vocabulary.get(shape(w))
            line += of[w]
            if k and w == words[k - 1]:
                line.append(vocabulary[REPEAT])
        ids = np.array([i for i in line if i is not None], np.int64)
        near += [ids[:-d] * len(vocabulary) + ids[d:] for d in range(1, REACH + 1) if len(ids) > d]
    # what comes together often is added once, times its number
    pair, n = np.unique(np.concatenate([np.empty(0, np.int64), *near]), return_counts=True)
    total = np.zeros(len(vocabulary) * WIDTH)
    for own, other in (divmod(pair, len(vocabulary)), divmod(pair, len(vocabulary))[::-1]):
        for k in range(NONZERO):
            total += np.bincount(own * WIDTH + at[other, k], sign[other, k] * n, len(total))
    return total.astype(np.int64).reshape(-1, WIDTH)


def word_vectors(index: np.ndarray, context: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(context.astype(np.float64), axis=1, keepdims=True)
    return (index / NONZERO**0.5 + 0.5 * context / np.where(size > 0, size, 1)).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> tuple[list[np.ndarray], float]:
    """Weights and temperature for pooled vectors with labels 0 and 1; the same for the same rows in the same order."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    scale = x[own].std() + 1e-9
    layers = [r.normal(0, 1 / (scale * WIDTH**0.5), (WIDTH, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    rates = [0.02 / (scale * WIDTH**0.5), 0.01, 0.01, 0.01]
    for _ in range(epochs):
        for part in np.array_split(r.permutation(own), max(1, len(own) // 128)):
            grads = gradients(layers, x[part], y[part])
            step += 1
            for k, gk in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                layers[k] = layers[k] - rates[k] * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    part = held if len(held) else own
    z = _forward(layers, x[part])[1]
    return layers, float(min(np.geomspace(0.25, 8, 61), key=lambda t: loss(z / t, y[part])))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(y * np.log(_sigmoid(z) + 1e-12) + (1 - y) * np.log(1 - _sigmoid(z) + 1e-12)))


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss, with weight decay."""
    h, z = _forward(layers, x)
    g = (_sigmoid(z) - y) / len(y)
    back = np.outer(g, layers[2]) * (1 - h**2)
    return [x.T @ back + 1e-5 * layers[0], back.sum(0), h.T @ g + 1e-4 * layers[2], np.array([g.sum()])]


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key has the remainder of the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def chosen_rows(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(key, label, text), at most ``sample`` rows: one for each chosen key, reduced before the shuffle however often the key comes."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(F.col(key), 5) != 0)).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__label"))
        .orderBy(F.xxhash64(F.col("__key").cast("string"), F.lit("fit")), "__key").limit(sample)
    )
    raw = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = df.select(F.col(key).alias("__key"), raw).join(F.broadcast(chosen), "__key")
    return rows.groupBy("__key", "__label").agg(F.min(F.struct(F.crc32(F.col("text").cast("binary")).alias("c"), "text")).alias("x")).select("__key", "__label", "x.text")


def fit_on(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on rows of ``df`` whose label is 0 or 1 and whose key's remainder modulo 5 is not 0, at most ``sample`` of them.

    Of several labels of one key the smallest counts; of several texts the one with the smallest checksum and then text."""
    scratch = Scratch(df.sparkSession, "quality")
    rows = scratch.keep(chosen_rows(df, labels, key, text, label, sample), "rows")
    kinds = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Model({}, np.zeros((0, WIDTH), np.float32), constant=(kinds.get(1, 0) + 1) / (sum(kinds.values()) + 2))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter[str] = Counter()
        for b in batches:
            seen += count_tokens(texts(b))
            if len(seen) > _WORDS_KEPT:
                yield {"token": list(seen), "n": list(seen.values())}
                seen.clear()
        yield {"token": list(seen), "n": list(seen.values())}

    marks = [REPEAT, UNSEEN]
    counts = map_arrow(rows.select("text"), tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where(~F.col("token").isin(marks))
    frequent = counts.orderBy(F.desc("n"), "token").limit(VOCABULARY - len(marks)).collect()
    vocabulary = {t: i for i, t in enumerate([*marks, *(r["token"] for r in frequent)])}
    index = index_vectors(list(vocabulary))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        context = np.zeros((len(vocabulary), WIDTH), np.int64)
        for b in batches:
            context += contexts_of(vocabulary, texts(b))
        yield {"block": np.arange(_BLOCKS, dtype=np.int32), "sums": [x.tobytes() for x in np.array_split(context, _BLOCKS)]}

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(1, np.int64)
        for x in table.column("sums"):
            total = total + np.frombuffer(x.as_py(), np.int64)
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    blocks = map_arrow(rows.select("text"), contexts, "block int, sums binary").groupBy("block").applyInArrow(added, as_schema("block int, sums binary")).collect()
    context = np.frombuffer(b"".join(r["sums"] for r in sorted(blocks, key=lambda r: r["block"])), np.int64).reshape(-1, WIDTH)
    model = Model(vocabulary, word_vectors(index, context))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"__key": b.column("__key"), "__label": b.column("__label"), "x": [model.pooled(t).tobytes() for t in texts(b)]}

    kinds_of = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = map_arrow(rows, pooled, f"__key {kinds_of['__key']}, __label {kinds_of['__label']}, x binary").collect()
    found.sort(key=lambda r: r["__key"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64)
    model.layers, model.temperature = train(x, np.array([r["__label"] for r in found], np.float64))
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row; a null or repeated key is carried as it is, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "score": model.score(texts(b))}

    return map_arrow(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")


def keep_good(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns whatever their names, whose score is at least ``threshold``; rows are judged one by one, so repeated ones fare alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            kept = b.filter(pa.array(model.score(texts(b, text)) >= threshold))
            yield {n: kept.column(n) for n in kept.schema.names}

    return map_arrow(df, run, df.schema)
