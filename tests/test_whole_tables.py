import random
from datetime import datetime, timedelta

import pytest

from packetloom.plans import relational


def write(spark, folder, rows):
    """events.parquet of (event_id, user_id, event_type)."""
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(seconds=i), u, t, 1.0) for i, u, t in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(3).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def drawn(r, n):
    return [(r.randrange(5000), r.choice(["click", "view", "error", "purchase"])) for _ in range(n)]


def test_recurrences_anywhere_in_the_table(spark, tmp_path):
    r = random.Random(7)
    s = drawn(r, 12_001)
    s[11_990:11_996] = s[5_000:5_006]  # beyond both windows of anchor4_match
    s[5_998:6_001] = s[8_000:8_003]  # crosses the cut: no recurrence of four
    rows = [(3 * k + 5, *x) for k, x in enumerate(s)]  # ids with holes
    token = [f"{t}{u % 64}" for u, t in s]
    half = len(s) // 2
    at = {}
    for i in range(half - 3):
        at.setdefault(tuple(token[i : i + 4]), []).append(i)
    want = sorted((i, j) for j in range(half, len(s) - 3) for i in at.get(tuple(token[j : j + 4]), []))
    assert {(5000 + k, 11_990 + k) for k in range(3)} <= set(want)
    got = relational.QUERIES["anchor4_match_whole"](spark, write(spark, tmp_path / "e", rows)).collect()
    assert sorted((x.start_a, x.start_b) for x in got) == want


@pytest.mark.parametrize(("kind", "n"), [("planted", 5000), ("planted", 5001), ("periodic", 400), ("constant", 301), ("none", 3000), ("short", 3000), ("few", 20), ("spoiled", 5000)])
def test_overlap_of_any_length(spark, tmp_path, monkeypatch, kind, n):
    monkeypatch.setattr(relational.seq, "CHUNK", 256)
    r = random.Random(8)
    s, half = drawn(r, n), n // 2
    if kind == "periodic":
        s = [s[k % 7] for k in range(n)]
    elif kind == "constant":
        s = [s[0]] * n
    elif kind in ("planted", "spoiled", "short"):
        size = 31 if kind == "short" else 1300
        s[half : half + size] = s[half - size : half]
        if kind == "spoiled":
            s[half + 700] = (9999, "click")
    want = max((k for k in range(32, half + 1) if s[half - k : half] == s[half : half + k]), default=None)
    assert (want is None) == (kind in ("none", "short", "few", "spoiled"))
    got = relational.QUERIES["binary_overlap_whole"](spark, write(spark, tmp_path / "e", [(k, *x) for k, x in enumerate(s)])).collect()
    assert [x.overlap for x in got] == [want]
