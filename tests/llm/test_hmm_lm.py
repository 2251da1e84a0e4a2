import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from packetloom.llm import hmm_lm as lm


def tokens(text):
    return [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split(), lm.END]


def plain_forward(m, codes):
    a, out = m.start * m.emit[:, codes[0]], 0.0
    for c in [*codes[1:], None]:
        out += math.log10(a.sum())
        a = a / a.sum()
        if c is not None:
            a = (a @ m.move) * m.emit[:, c]
    return out


def model(classes, seed=0):
    r = np.random.default_rng(seed)
    d = lambda *n: (x := r.uniform(0.1, 1, n)) / x.sum(-1, keepdims=True)
    return lm.Model(d(lm.STATES), d(lm.STATES, lm.STATES), d(lm.STATES, classes))


def test_forward_over_segments_is_exact():
    m, r = model(9), np.random.default_rng(1)
    texts = [r.integers(0, 9, n) for n in (1, 2, 63, 64, 65, 128, 700, 5)]
    got = lm.log10_likelihood(m, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, [plain_forward(m, t) for t in texts], rtol=1e-10)


def test_expected_counts_equal_enumeration():
    import itertools

    m, codes = model(3), np.array([0, 2, 1, 1])
    flat = np.zeros(m.flat_size())
    s = lm.STATES
    for path in itertools.product(range(s), repeat=4):
        p = m.start[path[0]] * np.prod([m.emit[q, c] for q, c in zip(path, codes)]) * np.prod([m.move[a, b] for a, b in zip(path, path[1:])])
        flat[path[0]] += p
        for a, b in zip(path, path[1:]):
            flat[s + a * s + b] += p
        for q, c in zip(path, codes):
            flat[s + s * s + q * 3 + c] += p
    assert np.allclose(lm.expected(m, codes, np.array([4])), flat / flat[:s].sum())


def test_borders_of_segments_change_nothing(monkeypatch):
    m, r = model(7), np.random.default_rng(3)
    lengths = np.array([1, 2, 3, 7, 8, 9, 64, 65, 200, 1, 40])
    codes = r.integers(0, 7, lengths.sum())
    monkeypatch.setattr(lm, "SEGMENT", 1000)
    want, score = lm.expected(m, codes, lengths), lm.log10_likelihood(m, codes, lengths)
    assert np.isclose(want[: lm.STATES].sum(), len(lengths)) and np.isclose(want[lm.STATES : lm.STATES + lm.STATES**2].sum(), (lengths - 1).sum())
    for n, batch in ((1, 4096), (2, 3), (8, 5), (64, 4096)):
        monkeypatch.setattr(lm, "SEGMENT", n)
        monkeypatch.setattr(lm, "BATCH", batch)
        assert np.allclose(lm.expected(m, codes, lengths), want, atol=1e-9)
        assert np.allclose(lm.log10_likelihood(m, codes, lengths), score)


def test_training_raises_likelihood():
    r = random.Random(2)
    codes, lengths = [], []
    for _ in range(200):
        n, k = r.randint(3, 150), r.randrange(2)
        for _ in range(n):
            k = 1 - k if r.random() < 0.05 else k
            codes.append(r.randrange(4) + 4 * k)
        lengths.append(n)
    codes, lengths = np.array(codes), np.array(lengths)
    m = lm.Model.initial(np.full(8, 1 / 8))
    last = -np.inf
    for _ in range(8):
        now = lm.log10_likelihood(m, codes, lengths).sum()
        assert now > last - 1
        last, m = now, lm.Model.from_counts(lm.expected(m, codes, lengths), 8)
    assert last > lm.log10_likelihood(lm.Model.initial(np.full(8, 1 / 8)), codes, lengths).sum() + 100


def test_corpus_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 12)
    monkeypatch.setattr(lm, "OWN", 5)
    r = random.Random(1)
    vocab = [f"w{i}x{'abc'[i % 3]}" for i in range(40)]
    rows = [(i, " ".join(r.choice(vocab[: r.choice([5, 40])]) for _ in range(r.choice([1, 20, 300])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "new words only HERE"), (3, rows[3][1]), (None, "A a"), (103, "w1xb new " * 9_000)]
    train = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    c = Counter(t for d, x in rows if train(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, base double".replace("base double", "base string"))
    cond = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = lm.score_corpus(df, cond).collect()
    want = sorted((-1 if d is None else d, not train(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for d, x in rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    # the model's score: classes along the forward recursion, then words within their classes
    rows_ = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = lm.gather(lm.count_tokens(rows_.where(cond).select("text")))
    own = sorted(c, key=lambda w: (-c[w], w))[:5]
    assert set(own) <= set(counts.own) <= {*own, lm.END} and set(c) - set(counts.hot) and set(counts.hot) - set(counts.own)
    trained = lm.train_model(lm.code(rows_, counts, cond).where("not held_out"), counts)
    size = Counter(lm.bucket_of(w) for w in c if w not in counts.own)
    for w in c:
        if w not in counts.own:
            size[lm.bucket_of(w)] += c[w]
    for g, (d, x) in zip(sorted(got, key=lambda g: (-1 if g.doc_id is None else g.doc_id, g.n_tokens)), sorted(rows, key=lambda y: (-1 if y[0] is None else y[0], len(tokens(y[1])))), strict=True):
        plain = plain_forward(trained, [counts.class_of(w) for w in tokens(x)])
        plain += sum(math.log10((c[w] + 1) / (size[lm.bucket_of(w)] + 1)) for w in tokens(x) if w not in counts.own)
        assert abs(g.score - plain) < 1e-6 * abs(plain)
    assert lm.score_corpus(df.limit(0), cond).count() == 0
