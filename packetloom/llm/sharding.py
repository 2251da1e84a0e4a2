"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A row descends the tree: at each node every child draws ``-ln(u) / weight`` with ``u`` hashed from (key, child name),
and the smallest draw wins. A child's draw depends on nothing but the key, its name and its weight, so a weight that
changes moves rows only into or out of the child whose weight changed, at each level on its path; rows of other
subtrees keep their places. A shard that is added as a region of its own therefore takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A region or rack (with children) or a shard (a leaf with its number). Names are unique in a tree."""

    name: str
    own_weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def reweighted(self, shard: int, weight: float) -> Node:
        """The tree with another weight for one shard."""
        if self.shard == shard:
            return replace(self, own_weight=weight)
        return replace(self, children=tuple(c.reweighted(shard, weight) for c in self.children))


def base_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """``shards`` leaves of weight 1 dealt over ``regions`` x ``racks``; empty racks and regions are left out."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    groups: dict[tuple[int, int], list[Node]] = {}
    for s in range(shards):
        cell = s * regions * racks // shards
        groups.setdefault((cell // racks, cell % racks), []).append(Node(f"s{s}", shard=s))
    out = []
    for r in sorted({r for r, _ in groups}):
        inner = tuple(Node(f"r{r}k{k}", children=tuple(groups[r, k])) for k in range(racks) if (r, k) in groups)
        out.append(Node(f"r{r}", children=inner))
    return Node("root", children=tuple(out))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: it takes rows only into itself."""
    s = max(x.shard for x in tree.leaves()) + 1
    leaf = Node(f"s{s}", own_weight=weight, shard=s)
    return replace(tree, children=(*tree.children, Node(f"g{s}", children=(Node(f"g{s}k0", children=(leaf,)),))))


def _draw(key: Column, child: Node) -> Column:
    # 52 bits of md5, which other engines have as well; never 0, so the logarithm is finite
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + child.name))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(child.weight))


def _descend(key: Column, node: Node) -> Column:
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return _descend(key, node.children[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))
    if all(c.shard is not None for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), best["i"] + 1)
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(node.children))):
        out = F.when(best["i"] == i, _descend(key, c)).otherwise(out)
    return out


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key of any type; null keys are one key of their own (the empty one)."""
    return _descend(F.coalesce(key.cast("string"), F.lit("")), tree).cast("int")


def with_slots(df: DataFrame, shard: str, key: str, ties: tuple[str, ...] = (), buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, without bringing a shard's rows together.

    Rows are numbered in (shard, bucket of the key and the ``ties``); the bucket's first number is a running sum over the counts, which
    are at most shards x ``buckets`` rows whatever the input. Rows of one key are spread and ordered by the columns ``ties``, so a key
    that many rows share is not one task's, and a task that runs again numbers them alike. Rows equal in all of these are told
    apart by nothing: which of their slots each gets makes no difference.
    """
    bucketed = df.withColumn("__bucket", _bucket([key, *ties], buckets))
    counts = bucketed.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(shard, "__bucket", before.alias("__from"))
    row = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in (key, *ties)]))
    return (
        bucketed.withColumn("__row", row).join(F.broadcast(starts), [shard, "__bucket"])
        .withColumn("slot", (F.col("__from") + F.col("__row") - 1).cast("long")).drop("__bucket", "__row", "__from", "__n")
    )


def _bucket(columns: list[str], buckets: int) -> Column:
    parts = [x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("#"))]
    bits = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10)
    return (bits.cast("long") % buckets).cast("int")


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", tree: Node | None = None, more: Node | None = None) -> DataFrame:
    """Shard, slot and size of each row under ``tree``, and the shard under ``more`` (by default one shard more).

    Null or empty texts have size 1 and checksum 0; null keys hash as the empty string; repeated rows each get a slot;
    an empty table gives no rows; other columns of ``df`` are not read, so clashing names do no harm.
    """
    tree = tree or base_tree(16)
    more = more or grown(tree)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(F.col(key), tree).alias("shard"), shard_of(F.col(key), more).alias("grown_shard"),
    )
    return with_slots(rows, "shard", key, ("text_crc32", "size")).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
