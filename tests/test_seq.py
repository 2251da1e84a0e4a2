import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions import text
from packetloom.operators import seq


def rows(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice([None, 1, 1, 1, 1, 2]), i, r.choice([None, 1, 5, 9])) for i in range(n)]


def fold(data):
    out, state = [], {}
    for k, i, v in data:
        lag, total, last = state.get(k, (None, None, None))
        total = total if v is None else (total or 0) + v
        out.append((k, i, lag, total, v if v is not None else last, last))
        state[k] = v, total, v if v is not None else last
    return out


@pytest.mark.parametrize("chunk", [None, 7, 1000])
def test_scan_equals_a_fold(spark, chunk):
    data = rows()
    df = spark.createDataFrame(data, "k int, i long, v int").repartition(3)
    got = seq.scan(df, ["k"], "i", lags={"lag": F.col("v")}, sums={"total": F.col("v").cast("long")}, lasts={"last": F.col("v")}, before={"prior": F.col("v")}, chunk=chunk)
    want = sorted(fold(data), key=lambda x: x[1])
    assert sorted([(r.k, r.i, r.lag, r.total or None, r.last, r.prior) for r in got.collect()], key=lambda x: x[1]) == want


def test_scan_without_keys_and_empty(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("i"))
    assert [r.n for r in seq.scan(df, [], "i", sums={"n": F.lit(1).cast("long")}, chunk=50).orderBy("i").collect()] == list(range(1, 1001))
    assert seq.scan(df.limit(0), [], "i", lags={"x": F.col("i")}).count() == 0


def test_unwrap_and_sessions(spark):
    r = random.Random(3)
    t, true = 0, []
    for _ in range(200):
        t += r.choice([90_000, 3_000_000_000, -45_000])
        true.append(t)
    df = spark.createDataFrame([(1, i, x % 2**33) for i, x in enumerate(true)], "k int, i long, raw long")
    base = true[0] - true[0] % 2**33
    assert [x.unwrapped for x in seq.unwrap(df, ["k"], "i", "raw").orderBy("i").collect()] == [x - base for x in true]
    at = [0, 100, 357, 358, 900]
    s = seq.sessions(spark.createDataFrame([(1, a, a, i) for i, a in enumerate(at)], "k int, a long, b long, x int"), ["k"], "a", "b", 256, ["x"]).orderBy("a").collect()
    assert [(x.a, x.b, x.occurrences, x.x) for x in s] == [(0, 100, 2, 0), (357, 358, 2, 2), (900, 900, 1, 4)]


def test_ngrams_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(seq, "CHUNK", 5)
    r = random.Random(2)
    a, b = ([r.choice("abc") for _ in range(40)] for _ in range(2))
    df = lambda s: spark.createDataFrame(list(enumerate(s)), "i long, t string")
    want = {(i, j) for i in range(37) for j in range(37) if a[i : i + 4] == b[j : j + 4]}
    assert {(x.start_a, x.start_b) for x in seq.ngram_matches(df(a), df(b), 4, "i", "t").collect()} == want


def test_band_join_and_interval_union(spark):
    r = random.Random(5)
    a, b = ([r.randrange(-500, 500) for _ in range(60)] for _ in range(2))
    j = seq.band_join(spark.createDataFrame([(1, x) for x in a], "k int, x long"), spark.createDataFrame([(1, y) for y in b], "k int, y long"), ["k"], "x", "y", 13)
    assert sorted((r_.x, r_.y) for r_ in j.collect()) == sorted((x, y) for x in a for y in b if abs(x - y) <= 13)
    m = seq.merge_intervals(spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 8, 9), (1, 1, 2)], "k int, a long, b long"), ["k"], "a", "b")
    assert sorted((r_.a, r_.b) for r_ in m.collect()) == [(0, 6), (8, 9)]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.hex_pid(F.lit(0x1FF))) == "0x01FF"
    assert get(text.clock_text(F.lit(90_061_005))) == "25:01:01.005" and get(text.clock_text(F.lit(90_061_005), True)) == "01:01:01.005"
    assert get(text.parse_number(F.lit(" 0xff "))) == 255 and get(text.parse_number(F.lit("12"))) == 12 and get(text.parse_number(F.lit("1.5"))) is None
    assert get(text.parse_time(F.lit("1:02:03.5"))) == 3723.5 and get(text.parse_time(F.lit("1:2"))) is None
    assert get(text.size_text(F.lit(1536))) == "1.50 KB" and get(text.bitrate_text(F.lit(2_500_000))) == "2.50 Mbps"
    assert str(get(text.mjd_to_date(F.lit(60_000)))) == "2023-02-25" and get(text.nice_ceiling(F.lit(37.0))) == 50
    names = ["10.ts", "2.ts", "segment10", "segment09", "part100", "part20", "A1", "a01"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()]
    assert got == ["2.ts", "10.ts", "A1", "a01", "part20", "part100", "segment09", "segment10"]
