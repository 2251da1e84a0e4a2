import random
import zlib
from collections import Counter

import numpy as np

from packetloom.llm import quality as q


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ba", "re", "no") for b in ("ti", "la", "mu") for c in ("s", "n", "")]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            kind = r.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "$$$" for w in words] if kind == 1 else [w for w in words[:5] for _ in range(10)]
        out.append((i, " ".join(words), int(not bad)))
    return out


def test_held_out_accuracy_and_determinism(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5001, None), (None, 1)], "doc_id long, quality int")
    model = q.fit_on(docs, labels)
    want = {i: y for i, _, y in rows}
    got = q.score(docs, model).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 for r in got)
    fresh = corpus(400, 2)
    right = sum((s >= 0.3) == bool(y) for s, (_, _, y) in zip(model.score([t for _, t, _ in fresh]), fresh, strict=True))
    assert right >= 390
    again = q.fit_on(docs, labels)
    assert (again.score([t for _, t, _ in fresh]) == model.score([t for _, t, _ in fresh])).all()
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns and all(want.get(r.doc_id, 1) for r in kept.collect() if r.doc_id < 30)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = q.fit_on(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in q.score(docs, model).collect()] == [0.5]
    assert q.score(docs.limit(0), model).count() == 0


def plain_pooled(model, text):
    """The mean over words of the sum of their tokens' vectors, word by word."""
    words = [x[i : i + q.PIECE] for x in text.split() for i in range(0, len(x), q.PIECE)]
    total = np.zeros(q.WIDTH)
    for k, w in enumerate(words):
        own = [w if w in model.vocabulary else q.UNSEEN, q.shape(w)] + ([q.REPEAT] if k and words[k - 1] == w else [])
        for t in own:
            if t in model.vocabulary:
                total += model.vectors[model.vocabulary[t]]
    return total / max(1, len(words))


def test_contexts_pooling_and_network_equal_plain_ones(spark):
    rows = corpus(60, 3)
    texts = [t for _, t, _ in rows] + ["", "Ab! Ab! " * 9, "x" * 100, "ä1 " + "qZ-" * 50]
    counts = q.count_tokens(texts)
    want = Counter()
    for t in texts:
        for x in t.split():
            for i in range(0, len(x), q.PIECE):
                want.update([x[i : i + q.PIECE], q.shape(x[i : i + q.PIECE])])
    assert counts == want
    vocabulary = {t: i for i, t in enumerate([q.REPEAT, q.UNSEEN, *(t for t, _ in counts.most_common(40))])}
    index = q.index_vectors(list(vocabulary))
    plain = np.zeros_like(index)
    for t in texts:
        words, line = q.words_of(t), []
        for k, w in enumerate(words):
            line += [x for x in (w, q.shape(w), q.REPEAT if k and words[k - 1] == w else None) if x in vocabulary]
        for i in range(len(line)):
            for j in range(max(0, i - q.REACH), min(len(line), i + q.REACH + 1)):
                if i != j:
                    plain[vocabulary[line[i]]] += index[vocabulary[line[j]]]
    context = q.contexts_of(vocabulary, texts[:30]) + q.contexts_of(vocabulary, texts[30:])
    assert (context == plain).all() and (np.abs(index).sum(1) <= q.NONZERO).all()
    model = q.Model(vocabulary, q.word_vectors(index, context))
    x = np.array([model.pooled(t) for t in texts])
    assert np.allclose(x, [plain_pooled(model, t) for t in texts], atol=1e-5)
    # gradients against differences of the loss
    r = np.random.default_rng(1)
    layers, y = [r.normal(0, 0.3, n) for n in ((q.WIDTH, q.HIDDEN), q.HIDDEN, q.HIDDEN, 1)], r.integers(0, 2, len(x)).astype(float)
    for k, g in enumerate(q.gradients(layers, x, y)):
        at = tuple(r.integers(0, n) for n in g.shape)
        step = [p.copy() for p in layers]
        step[k][at] += 1e-5
        decay = (1e-5, 0, 1e-4, 0)[k] * layers[k][at]
        slope = (q.loss(q._forward(step, x)[1], y) - q.loss(q._forward(layers, x)[1], y)) / 1e-5
        assert abs(slope + decay - g[at]) < 1e-3
    z = np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]
    model.layers, model.temperature = layers, 2.0
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-z / 2)), atol=1e-6)


def test_words_around_the_longest_piece():
    assert q.words_of("a" * 32 + " b") == ["a" * 32, "b"] and q.words_of("a" * 33) == ["a" * 32, "a"] and q.words_of(" \n") == []
    assert q.shape("Hello,World!" * 9) == "\0" + "Aa,Aa!" * 9


def test_odd_rows_and_the_query(spark, tmp_path):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, t, "x", b"z") for i, t, _ in rows] + [(7, "zzz", "x", None), (None, None, None, None), (None, "a", "x", None), (400, "y" * 300_000, "x", None)], "doc_id long, text string, score string, x binary")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0), (3, 1), (None, 0), (5, 7)], "doc_id long, quality int")
    taken = {r["__key"]: (r["__label"], r["text"]) for r in q.chosen_rows(docs, labels, "doc_id", "text", "quality", 1000).collect()}
    of = {i: t for i, t, _ in rows}
    of[7] = min((rows[7][1], "zzz"), key=lambda t: (zlib.crc32(t.encode()), t))
    ys = {i: y for i, _, y in rows} | {3: 0}
    assert taken == {i: (ys[i], of[i]) for i in range(300) if zlib.crc32(str(i).encode()) % 5 and i != 5} | ({5: (ys[5], of[5])} if zlib.crc32(b"5") % 5 else {})
    assert q.chosen_rows(docs, labels, "doc_id", "text", "quality", 10).count() == 10
    one = labels.where("quality = 1")
    model = q.fit_on(docs, one, sample=50)
    assert abs(model.constant - 51 / 52) < 1e-9
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    from packetloom.llm import queries

    got = queries.op9_quality(spark, str(tmp_path)).collect()
    assert len(got) == 304 and all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    assert q.keep_good(docs, model).count() == 304
