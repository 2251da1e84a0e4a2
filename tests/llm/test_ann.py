import numpy as np
from pyspark.sql import functions as F

from packetloom.llm import ann


def run(spark, rows, k=10, step=100):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, code string")
    out = {}
    for r in ann.nearest(df, F.col("id") % step == 0, k).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "RERANK", 60)
    r = np.random.default_rng(1)
    x = (r.normal(size=(40, 33))[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 33))).astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert len(got) == 30 and hits / 300 >= 0.9


def test_ties_and_unusable(spark):
    rows = [(i, [1.0, 2.0]) for i in range(250)] + [(1000, None), (1100, [0.0, 0.0]), (1200, [1.0, float("nan")]), (1300, [None, 1.0]), (1400, [1.0]), (1500, [float("inf"), 1.0]), (1600, [5.0, 5.0])]
    got = run(spark, rows)
    assert sorted(got) == [0, 100, 200, 1600]
    assert [v for _, v, _ in got[0]] == list(range(1, 11)) and [v for _, v, _ in got[100]] == list(range(10))
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]) == {0: [(1, 1, 2**0.5)]}
    assert run(spark, []) == {} and run(spark, [(0, None)]) == {}


def plain(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(n + 1, int(ids[i]), float(d[i])) for n, i in enumerate(order)]


def test_everything_reranked_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "RERANK", 10**9)
    monkeypatch.setattr(ann, "GROUP", 33)
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 7)).astype(np.float32)
    x[100:140] = x[0]  # ties
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], step=20)
    want = {q: plain(x.astype(float), np.arange(400), q) for q in range(0, 400, 20)}
    assert {q: [(a, b) for a, b, _ in f] for q, f in got.items()} == {q: [(a, b) for a, b, _ in f] for q, f in want.items()}
    assert all(abs(a[2] - b[2]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_lengths_repeats_and_clashing_names(spark):
    r = np.random.default_rng(6)
    short, long = r.normal(size=(30, 3)), r.normal(size=(12, 5000))
    rows = [(i * 10, v.tolist()) for i, v in enumerate(short)] + [(1000 + i * 50, v.tolist()) for i, v in enumerate(long)] + [(None, [1.0, 2.0, 3.0]), (0, short[5].tolist()), (5, [])]
    df = spark.createDataFrame([(i, v, "x", 1, b"c") for i, v in rows], "vec_id long, embedding array<double>, vector string, id int, codes binary")
    got = ann.nearest(df, F.col("id") % 100 == 0).collect()
    per = {}
    for g in got:
        per.setdefault(g.query_id, []).append(g.vec_id)
    assert sorted(per) == [0, 100, 200, *range(1000, 1600, 100)]
    assert all(len(v) == 10 for v in per.values()) and all(v >= 1000 for v in per[1000]) and 0 not in per[0] and max(per[0]) < 1000
