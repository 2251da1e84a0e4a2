import random

import numpy as np

from packetloom.llm import near_dedup as nd
from packetloom.llm.shingles import shingle_sets, word_hashes


def plain_sets(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def plain(rows, words=5):
    sets = [plain_sets(t, words) for _, t in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                comp[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), -1 if d is None else low[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 8, 40, 120]))] for _ in range(12)]
    for i in range(n):
        w = list(bases[0] if i % 3 == 0 else r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else "\t".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (5, rows[5][1]), (1003, "one"), (1004, "ONE"), (1005, "x " * 30_000)]
    return rows


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "extra", b"x") for d, t in rows], "doc_id long, text string, fp string, keys binary")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in nd.near_duplicates(df, **kw).collect())


def test_groups_equal_brute_force(spark):
    rows = corpus(1)
    assert got(spark, rows) == plain(rows)


def test_small_blocks_and_another_width(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 5)
    rows = corpus(2)
    assert got(spark, rows, words=4) == plain(rows, 4)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_sets_and_signatures():
    texts = ["a b c d e f", "a b", "", "é É A\x0bB c", "a b c d e f a b c d e f"]
    sets = shingle_sets([t.encode() for t in texts], 4)
    assert [len(s) for s in sets] == [len(plain_sets(t, 4)) for t in texts]
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:600], r.integers(0, 2**63, 300, dtype=np.uint64)]))
    for x, y in ((a, b), (a[:30], np.unique(np.concatenate([a[:20], b[-10:]])))):
        s = nd.signatures([x, y], 512)
        assert (s != np.uint64(2**64 - 1)).all()
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s[0] == s[1]).mean() - true) < 0.08


def test_words_that_follow_a_rule_do_not_collide(spark):
    bit = lambda i: "ab"[bin(i).count("1") % 2]
    one = "".join(bit(i) for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(3))
    assert got(spark, [(1, f"{rest} {one}"), (2, f"{rest} {two}"), (3, f"{rest} {one}")], words=4) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    words = [(a * n).encode() for a in ("a", "b", "ab", "é") for n in range(1, 700)] + [one[:k].encode() for k in range(1, 1024)]
    h, _ = word_hashes([b" ".join(set(words))])
    assert len(set(h.tolist())) == len(set(words))


def test_a_template_whose_texts_are_apart(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in r.sample(range(60), r.choice([3, 4, 5])):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for sparse in (0, 2, 10**9):
        monkeypatch.setattr(nd, "SPARSE", sparse)
        assert got(spark, rows) == plain(rows)
