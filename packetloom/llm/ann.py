"""Approximate nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

The smallest Euclidean distance is the largest ``q.x - |x|**2 / 2``. The product ``q.x`` is read from tables: vectors are cut into parts of
two dimensions, each coded by one of 16 centres (four bits), and the half norm is kept as it is. Codebooks and codes minimise
``|r|**2 + (eta - 1) * (r.u)**2`` with ``u`` the direction of ``x``: error along the vector, which moves high products most, costs ``eta`` times
as much. Codes come by coordinate descent over the parts.

The codebooks are fitted on at most ``SAMPLE`` vectors chosen by a hash of their ids; every vector is coded. The index is rows of packed groups of at most
``GROUP`` vectors, made once, so what a query reads does not depend on how the scan is split. Queries go in blocks of about ``QUERY_BLOCK`` against all
groups: in each, the tables choose ``RERANK`` candidates a query (a smaller group, the last of a task, gives a larger share of itself), whose distances
are computed on the original vectors in double precision; the best of all groups are the result. Ties go to the smaller id at each step, so large groups of
equal vectors are ranked right. Distances exist between vectors of one length only, so each length has an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.arrow import map_arrow
from packetloom.session import Scratch

SAMPLE = 20_000
CENTRES, PART = 16, 2
QUERY_BLOCK = 512
RERANK = 100
GROUP = 2048


class Quantizer:
    """Codebooks of ``parts`` x 16 centres for vectors of one dimension (odd ones get a zero more)."""

    def __init__(self, dim: int, threshold: float = 0.2, seed: int = 5):
        self.dim, self.parts = dim, -(-dim // PART)
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.seed = seed
        self.books = np.zeros((self.parts, CENTRES, PART))

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float64), ((0, 0), (0, self.parts * PART - self.dim))).reshape(len(x), self.parts, PART)

    def _directions(self, cut: np.ndarray) -> np.ndarray:
        return cut / np.maximum(np.linalg.norm(cut.reshape(len(cut), -1), axis=1), 1e-300)[:, None, None]

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes 0..15, rows x parts."""
        cut = self._cut(x)
        codes = np.empty((len(x), self.parts), np.uint8)
        for s in range(self.parts):
            codes[:, s] = ((cut[:, s, None, :] - self.books[s]) ** 2).sum(2).argmin(1)
        return self._descend(cut, self._directions(cut), codes, sweeps)

    def _along(self, cut: np.ndarray, u: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each part's residual along the vector's direction."""
        return ((cut - self.books[np.arange(self.parts), codes]) * u).sum(2)

    def _descend(self, cut: np.ndarray, u: np.ndarray, codes: np.ndarray, sweeps: int) -> np.ndarray:
        along = self._along(cut, u, codes)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(self.parts):
                r = cut[:, s, None, :] - self.books[s]
                a = (r * u[:, s, None, :]).sum(2)
                rest = total - along[:, s]
                best = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + a) ** 2).argmin(1)
                codes[:, s] = best
                along[:, s] = a[np.arange(len(a)), best]
                total = rest + along[:, s]
        return codes

    def fit(self, x: np.ndarray, rounds: int = 8) -> Quantizer:
        cut = self._cut(x)
        u = self._directions(cut)
        r = np.random.default_rng(self.seed)
        for s in range(self.parts):
            self.books[s] = cut[r.integers(0, len(x), CENTRES), s] + r.normal(0, 1e-6, (CENTRES, PART))
        codes = np.stack([((cut[:, s, None, :] - self.books[s]) ** 2).sum(2).argmin(1) for s in range(self.parts)], 1).astype(np.uint8)
        outer = (self.eta - 1) * u[..., :, None] * u[..., None, :] + np.eye(PART)
        for _ in range(rounds):
            along = self._along(cut, u, codes)
            for s in range(self.parts):
                rest = along.sum(1) - along[:, s]
                right = np.einsum("nab,nb->na", outer[:, s], cut[:, s]) + (self.eta - 1) * rest[:, None] * u[:, s]
                for c in range(CENTRES):
                    if (own := codes[:, s] == c).any():
                        self.books[s, c] = np.linalg.solve(outer[own, s].sum(0), right[own].sum(0))
                along[:, s] = ((cut[:, s] - self.books[s, codes[:, s]]) * u[:, s]).sum(1)
            codes = self._descend(cut, u, codes, 1)
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with all centres, two four-bit tables joined to one of 256: queries x bytes of a code x 256."""
        t = np.einsum("qsd,scd->qsc", self._cut(q), self.books)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(q), 1, CENTRES))], 1)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and holds neither nulls nor numbers that are not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    column = b.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def best_of(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest values, ties to smaller ids, in no order."""
    if len(values) <= k:
        return np.arange(len(values))
    edge = np.partition(values, k - 1)[k - 1]
    under = np.flatnonzero(values < edge)
    ties = np.flatnonzero(values == edge)
    return np.concatenate([under, ties[np.argsort(ids[ties], kind="stable")[: k - len(under)]]])


def usable_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector")))


def build(rows: DataFrame, dim: int, scratch: Scratch, sample: int = SAMPLE) -> tuple[Quantizer, DataFrame]:
    """The quantizer and the index of vectors that all have ``dim`` components: groups of ids, codes and vectors, each packed into bytes."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    tool = Quantizer(dim).fit(np.array([r["vector"] for r in some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, vectors, held = [], [], 0

        def packed(last: bool) -> Iterator[dict]:
            nonlocal ids, vectors, held
            i, x = np.concatenate(ids), np.concatenate(vectors)
            whole = held if last else held - held % GROUP
            for at in range(0, whole, GROUP):
                end = min(at + GROUP, whole)
                yield {"ids": [i[at:end].tobytes()], "codes": [pack(tool.encode(x[at:end])).tobytes()], "vectors": [x[at:end].tobytes()]}
            ids, vectors, held = [i[whole:]], [x[whole:]], held - whole

        for b in batches:
            ids.append(b.column("id").to_numpy())
            vectors.append(_matrix(b, dim))
            held += b.num_rows
            if held >= GROUP:
                yield from packed(False)
        if held:
            yield from packed(True)

    return tool, scratch.keep(map_arrow(rows, run, "ids binary, codes binary, vectors binary"), "index")


def _scan(index: DataFrame, tool: Quantizer, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest of each partition for each query of a block."""
    tables = tool.tables(queries)

    def group_best(own: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        half = (vectors**2).sum(1).astype(np.float32) / 2
        for i, q in enumerate(queries):
            approx = half.copy()
            for s in range(codes.shape[1]):
                approx -= tables[i, s][codes[:, s]]
            others = np.flatnonzero(own != ids[i])
            near = others[best_of(approx[others], own[others], max(RERANK, k))]
            exact = np.sqrt(((vectors[near] - q) ** 2).sum(1))
            top = best_of(exact, own[near], k)
            yield np.full(len(top), ids[i]), own[near[top]], exact[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for own, codes, vectors in zip(*(b.column(n).to_pylist() for n in ("ids", "codes", "vectors")), strict=True):
                of = np.frombuffer(own, np.int64)
                kept += group_best(of, np.frombuffer(codes, np.uint8).reshape(len(of), -1), np.frombuffer(vectors, np.float64).reshape(len(of), -1))
                if len(kept) > 16 * len(queries):
                    kept = merged(kept)
        if kept:
            q, v, d = (np.concatenate(x) for x in zip(*merged(kept), strict=True))
            yield {"query_id": q, "vec_id": v, "score": d}

    def merged(kept: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        q, v, d = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        first = np.searchsorted(q, q, "left")
        top = np.arange(len(q)) - first < k
        return [(q[top], v[top], d[top])]

    return map_arrow(index, run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each usable row that ``queries`` (a condition on ``id``) selects: its k nearest other rows, or all if they are fewer.

    Columns query_id, rank (from 1), vec_id, score (Euclidean distance). Vectors that are null, zero, empty or hold null or non-finite components take
    no part, nor do rows with a null id. Rows that share an id count as one query (of the smallest vector) and are not its candidates. Of equal
    (vec_id, score) rows each has a rank. A query has candidates of its own length only. A table without usable vectors gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable_rows(df, key, vector)
    first = rows.where(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = scratch.keep(first, "queries")
    out = None
    for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        dim = r["dim"]
        own = asked.where(F.size("vector") == dim)
        blocks = -(-own.count() // QUERY_BLOCK)
        if not blocks:
            continue
        tool, index = build(rows.where(F.size("vector") == dim), dim, scratch)
        for i in range(blocks):
            # about QUERY_BLOCK rows, whatever the number of queries
            block = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").collect()
            if not block:
                continue
            near = _scan(index, tool, np.array([x["id"] for x in block]), np.array([x["vector"] for x in block]), k)
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
            best = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
            best = scratch.keep(best, "best") if blocks > 1 else best
            out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
