import zlib
from collections import Counter

from pyspark.sql import functions as F

from packetloom.llm import sharding as sh


def placed(spark, tree, n=4000):
    return {r.id: r.s for r in spark.range(n).select("id", sh.shard_of(F.col("id"), tree).alias("s")).collect()}


def test_movement_is_confined(spark):
    tree = sh.base_tree(16)
    before = placed(spark, tree)
    sizes = Counter(before.values())
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) < 1.4 * 250
    after = placed(spark, sh.grown(tree))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(after[k] == 16 for k in moved) and len(moved) < 4000 / 17 * 1.4
    twice = placed(spark, sh.grown(sh.grown(tree)))
    assert all(twice[k] in (after[k], 17) for k in after)
    heavier = placed(spark, tree.reweighted(3, 2.0))
    region = lambda s: s // 8
    # rows move only into or within the region whose weight grew, and only out of none of its untouched siblings' shards
    for k in before:
        if before[k] != heavier[k]:
            assert region(heavier[k]) == region(3)
    assert sum(v == 3 for v in heavier.values()) > 1.5 * sizes[3]


def test_slots_sizes_and_odd_rows(spark):
    rows = [(i, "é" * (i % 5)) for i in range(500)] + [(7, "again"), (7, "again"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, shard int, slot string")
    got = sh.assign(df).collect()
    assert len(got) == 504 and {r.law for r in got} == {"key"}
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.grown_shard in (r.shard, 16) for r in got) and len({r.shard for r in got if r.doc_id is None}) == 1
    assert sh.assign(df.limit(0)).count() == 0
    assert {r.shard for r in sh.assign(df, tree=sh.base_tree(1)).collect()} == {0}
