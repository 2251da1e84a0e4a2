"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, components.

A signature slot holds the smallest ``step + fraction`` over a set's elements, where each element deals its steps to the slots by a
permutation of its own; ranks are thus correlated and the estimate varies less than with independent hashes. Steps run
for all elements of a text at once and stop when all slots are filled, which the first step does for long texts.

Texts with equal shingle sets become one node first, so exact copies cost no pairs. A node shares a bucket with another if all rows of
a band agree; 24 bands of 4 rows miss a pair at similarity 0.8 with a probability of 3e-6. In each bucket, every member is verified
on whole sets against one hub; hubs reach the members by salts, so no bucket meets in one task. Members that are not connected
after that are met with the rest of their bucket in blocks, by sizes and one byte of each signature slot first (a pair at 0.8 falls short of the
agreement asked for with a probability of 5e-7). Blocks that leave few pairs give these to verification; texts travel to the other blocks and are
verified there. So no candidate goes unchecked, a group of copies costs a number of verifications in proportion to its size, and
texts that merely share a template cost sketches. Components come from min-label propagation with pointer jumping over tables in the shared folder.

Sets are compared as sets of 64-bit shingle hashes (see shingles.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.arrow import as_schema, map_arrow, raw_texts
from packetloom.llm.shingles import U, mix, shingle_sets
from packetloom.session import Scratch

BANDS, ROWS = 24, 4
BLOCK = 128
SALTS = 64
#: A block gives up to so many pairs a member; beyond that its texts are fetched.
SPARSE = 2
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def _step(h: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's exchange partner in j..slots-1 and its value of this step."""
    u = mix(h + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    to = j + ((u >> U(32)) * U(slots - j) >> U(32)).astype(np.int64)
    return to, (u & U(0xFFFFFFFF)) | U(j << 32)


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash values, one row per set; empty sets have rows of the largest value."""
    out = np.full((len(sets), slots), _EMPTY)
    if not sets:
        return out
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if sizes.sum() else np.empty(0, np.uint64)
    to, value = _step(every, 0, slots)
    np.minimum.at(out.reshape(-1), np.repeat(np.arange(len(sets)), sizes) * slots + to, value)
    starts = np.cumsum(sizes) - sizes
    for i in np.flatnonzero((out == _EMPTY).any(1) & (sizes > 0)).tolist():
        h, sig = sets[i], out[i]
        n = len(h)
        rows = np.arange(n)
        order = np.tile(np.arange(slots, dtype=np.int32), (n, 1))
        first = to[starts[i] : starts[i] + n]
        order[rows, first] = 0
        order[:, 0] = first
        for j in range(1, slots):
            k, v = _step(h, j, slots)
            slot = order[rows, k].copy()
            order[rows, k] = order[:, j]
            order[:, j] = slot
            np.minimum.at(sig, slot, v)
            if not (sig == _EMPTY).any():
                break
    return out


def band_keys(sigs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, slots = sigs.shape
    parts = mix(sigs.reshape(n, bands, slots // bands))
    h = np.zeros((n, bands), np.uint64)
    for k in range(slots // bands):
        h = mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, k] + U(k + 1))
    return h.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| of two sorted sets that are not empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _profiles(df: DataFrame, words: int) -> DataFrame:
    """(id, th, n, fp, keys, sketch) of (id, text, th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = shingle_sets(raw_texts(b), words)
            sigs = signatures(sets)
            keys, sketch = band_keys(sigs), mix(sigs).astype(np.uint8)
            yield {
                "id": b.column("id"), "th": b.column("th"), "n": [len(s) for s in sets], "fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "keys": [k.tolist() if len(s) else None for k, s in zip(keys, sets, strict=True)], "sketch": [k.tobytes() for k in sketch],
            }

    return map_arrow(df, run, "id long, th long, n long, fp binary, keys array<long>, sketch binary")


def _verified(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b, text_a, text_b) whose sets are similar enough, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in batches:
            one, two = raw_texts(part, "text_a"), raw_texts(part, "text_b")
            distinct = {x: i for i, x in enumerate(dict.fromkeys(one))}  # a hub comes many times in a row
            hubs = shingle_sets(list(distinct), words)
            keep = [linked(hubs[distinct[x]], y, percent) for x, y in zip(one, shingle_sets(two, words), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield {"a": part.column("a").filter(mask), "b": part.column("b").filter(mask)}

    return map_arrow(pairs, run, "a binary, b binary")


def agreement(percent: int, slots: int = BANDS * ROWS) -> int:
    """Slots that a pair at ``percent`` shares, less five standard deviations."""
    p = percent / 100
    return int(slots * p - 5 * (slots * p * (1 - p)) ** 0.5)


def _block_pairs(percent: int):
    """For one block of minority members against one block of a bucket: the pairs that sizes and sketches leave, or, if these are many, one row without a pair."""
    least = agreement(percent)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        few = np.array(table.column("few").to_pylist())
        n = table.column("n").to_numpy()
        fps = table.column("fp").to_pylist()
        comp = np.unique(np.array(table.column("comp").to_pylist()), return_inverse=True)[1]
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(fps), -1)
        others, found = np.flatnonzero(~few), []
        for i in np.flatnonzero(few).tolist():
            near = (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])) & (comp[others] != comp[i])
            some = others[near]
            some = some[(sketch[some] == sketch[i]).sum(1) >= least]
            # a pair that shares an earlier band as well is checked there
            found += [(fps[i], fps[j]) for j in some[(keys[some] == keys[i]).argmax(1) == key[0].as_py()].tolist()]
        if len(found) > SPARSE * len(fps):
            found = [(None, None)]
        where = {c: pa.array([k.as_py()] * len(found), k.type) for c, k in zip(("band", "bucket", "i", "j"), key, strict=True)}
        return pa.table(where | {"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return run


def _block_links(words: int, percent: int):
    """For one block of minority members against one block of a bucket: links that connect components, without repeats."""

    def run(table: pa.Table) -> pa.Table:
        few = np.array(table.column("few").to_pylist())
        comps, fps = table.column("comp").to_pylist(), table.column("fp").to_pylist()
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        band = table.column("band")[0].as_py()
        root = {c: c for c in comps}

        def top(x: bytes) -> bytes:
            while root[x] != x:
                x = root[x] = root[root[x]]
            return x

        raws = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
        sets = shingle_sets(raws, words)
        sizes = np.array([len(s) for s in sets])
        others = np.flatnonzero(~few)
        flat = np.concatenate([sets[i] for i in others]) if len(others) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(others)), sizes[others])
        out_a, out_b = [], []
        for i in np.flatnonzero(few):
            # a pair that shares an earlier band as well is checked there
            first = (keys[others] == keys[i]).argmax(1) == band
            near = (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])) & first
            apart = np.array([top(comps[j]) != top(comps[i]) for j in others], bool)
            if not (near & apart).any():
                continue
            at = np.searchsorted(sets[i], flat)
            at[at == len(sets[i])] = 0
            both = np.bincount(owner[sets[i][at] == flat], minlength=len(others))
            for j in others[near & apart & (100 * both >= percent * (sizes[others] + sizes[i] - both))]:
                a, b = top(comps[i]), top(comps[j])
                if a != b:
                    root[a] = b
                    out_a.append(fps[i])
                    out_b.append(fps[j])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) reaches. Ends when a round changes nothing."""
    both = scratch.keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        old = labels
        near = both.join(old, both.b == old.node).groupBy("a").agg(F.min("comp").alias("near"))
        low = old.join(near, old.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = old.select(F.col("node").alias("target"), F.col("comp").alias("far"))
        new = scratch.keep(low.join(jump, low.comp == jump.target, "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        labels._packetloom_path = new._packetloom_path
        scratch.drop(old)
        if new.where("comp <> was").isEmpty():
            scratch.drop(both)
            return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id (the smallest key of its group) and kept.

    Two texts are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets; a group is what links connect.
    Null texts and texts without words have no shingles, are linked with nothing and are kept. Rows with null keys take no part
    in groups: their component is null and they are kept. Repeated rows are members of one group and are told apart by
    nothing: those with the smallest key are all kept. An empty table gives no rows. Other columns are not read.
    """
    profiles, grouped = _groups(df, key, text, words, percent)
    least = grouped.groupBy("comp").agg(F.min("id").alias("component_id"))
    home = grouped.join(least, "comp").select("fp", "component_id")
    out = profiles.select("id", "n", "fp").join(home, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _groups(df: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The profile of each row, and each set's first row (id, th: the text's hash) and group (fp, id, th, comp)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = scratch.keep(_profiles(rows.withColumn("th", F.xxhash64("text")), words), "profiles")
    nodes = profiles.where("n > 0 and id is not null").groupBy("fp").agg(F.min(F.struct("id", "th", "keys", "sketch", "n")).alias("x")).select("fp", "x.*")
    nodes = scratch.keep(nodes, "nodes")
    deal = nodes.select("fp", F.posexplode("keys").alias("band", "bucket")).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    local = deal.groupBy("band", "bucket", "salt").agg(F.min("fp").alias("near"), F.count(F.lit(1)).alias("n"))
    hubs = local.groupBy("band", "bucket").agg(F.min("near").alias("hub"), F.sum("n").alias("members")).where("members > 1")
    # at most SALTS rows of a bucket meet here, and its members join by salt
    local = scratch.keep(local.join(hubs, ["band", "bucket"]).select("band", "bucket", "salt", "hub"), "hubs")
    mates = scratch.keep(deal.join(local, ["band", "bucket", "salt"]).select("fp", "band", "bucket", "hub"), "mates")

    # texts of the nodes that share a bucket with another; nothing else is read again
    chosen = nodes.join(mates.select("fp").distinct(), "fp", "left_semi")
    found = rows.join(chosen.select("id", "fp"), "id")
    # an id that stands for several texts brings texts that are not its node's: only one whose set is the node's counts
    held = scratch.keep(_own_texts(found, words).dropDuplicates(["fp"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(held.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
        return _verified(pairs.join(held.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a"), words, percent)

    edges = scratch.keep(verified(mates.where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()), "edges")
    labels = components(edges, scratch)

    # buckets in which members other than the hub belong to different components hold pairs that were not compared
    rest = mates.where("fp <> hub").join(labels, mates.fp == labels.node, "left").select("fp", "band", "bucket", F.coalesce("comp", "fp").alias("comp"))
    rest = scratch.keep(rest, "rest")
    per = rest.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = per.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    open_ = scratch.keep(open_.where("comps > 1"), "open")
    members = rest.join(open_, ["band", "bucket"])
    cell = ["band", "bucket", "i", "j"]

    def dealt(rows: DataFrame, *cols: str) -> DataFrame:
        """Members in the blocks of their buckets: those of minor components against all."""
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        shaped = rows.select(
            "fp", "comp", *cols, "band", "bucket", (F.col("comp") != F.col("major")).alias("minor"), blocks("all").alias("nj"),
            F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("ni"), F.abs(F.hash("fp")).alias("h"))
        few = shaped.where("minor").select("*", F.lit(True).alias("few"), F.expr("h % ni").alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"))
        many = shaped.select("*", F.lit(False).alias("few"), F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), F.expr("cast((h div 7) % nj as int)").alias("j"))
        names = [*cell, "few", "fp", "comp", *cols]
        return few.select(names).unionByName(many.select(names))

    light = dealt(members.join(nodes.select("fp", "keys", "sketch", "n"), "fp"), "keys", "sketch", "n")
    left = scratch.keep(light.groupBy(*cell).applyInArrow(_block_pairs(percent), as_schema("band int, bucket long, i int, j int, a binary, b binary")), "left")
    more = verified(left.where("a is not null").select("a", "b").distinct())
    dense = left.where("a is null").select(*cell)
    if not dense.isEmpty():
        # texts join members, not their copies in the blocks
        crowded = members.join(dense.select("band", "bucket").distinct(), ["band", "bucket"], "left_semi").join(held.join(nodes.select("fp", "keys"), "fp"), "fp")
        crowded = dealt(crowded, "keys", "text").join(dense, cell, "left_semi")
        more = more.unionByName(crowded.groupBy(*cell).applyInArrow(_block_links(words, percent), as_schema("a binary, b binary")))
    more = scratch.keep(more, "more")
    if not more.isEmpty():
        labels = components(edges.unionByName(more), scratch)

    return profiles, nodes.select("fp", "id", "th").join(labels, nodes.fp == labels.node, "left").select("fp", "id", "th", F.coalesce("comp", "fp").alias("comp"))


def _own_texts(found: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = shingle_sets(raw_texts(b), words)
            mask = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == f for s, f in zip(sets, b.column("fp").to_pylist(), strict=True)], pa.bool_())
            yield {n: b.column(n).filter(mask) for n in ("fp", "text")}

    return map_arrow(found.select("fp", "text"), run, "fp binary, text string")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, all columns, that stay when one document of each group does: the one with the smallest key, then text hash.

    Repeated rows (same key, same text) become one; rows with null keys and rows without words stay. Rows that only share a key are told apart.
    """
    profiles, grouped = _groups(df, key, text, words, percent)
    first = grouped.groupBy("comp").agg(F.min(F.struct("id", "th")).alias("x")).select("x.id", "x.th")
    stays = first.unionByName(profiles.where("n = 0 and id is not null").select("id", "th")).select(F.col("id").alias("__key"), F.col("th").alias("__th"))
    known = df.where(F.col(key).isNotNull()).withColumn("__text", F.xxhash64(text))
    known = known.join(stays, (F.col(key) == F.col("__key")) & (F.col("__text") == F.col("__th")), "left_semi").dropDuplicates([key, "__text"]).drop("__text")
    return known.unionByName(df.where(F.col(key).isNull()))
