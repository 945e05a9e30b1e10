"""Approximate nearest neighbours with a forest of randomised kd-trees.

The trees are fitted on a bounded sample (``FIT_ROWS`` rows of least hash); every
row is indexed.  A query visits the leaves of least bound in each tree, by
best bin first, and meets the rows of those leaves in blocks.  A bounded
query then visits every leaf that the k-th distance so far does not exclude.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.distance import block_values
from trackloom.plans.stages import durable

FIT_ROWS = 20_000
#: Groups of leaves, rows of a block and queries that come to it at once (about).
BUCKETS, BLOCK, QUERIES = 16, 8192, 4096


@dataclass
class KdTree:
    """Flat arrays: a node splits ``dim`` at ``cut`` into ``low`` and ``high``, or is a leaf (dim -1)."""

    dim: list[int]
    cut: list[float]
    low: list[int]
    high: list[int]

    @classmethod
    def build(cls, x: np.ndarray, leaf: int, rng: np.random.RandomState, median: bool = False) -> KdTree:
        """Splits at the mean (or median) of a dimension drawn from the five of most variance."""
        tree = cls([], [], [], [])

        def grow(rows: np.ndarray) -> int:
            node = len(tree.dim)
            for a, v in ((tree.dim, -1), (tree.cut, 0.0), (tree.low, -1), (tree.high, -1)):
                a.append(v)
            part = x[rows]
            var = part.var(0) if len(rows) > leaf else np.zeros(1)
            if not var.max() > 0:
                return node
            top = np.argsort(-var)[:5]
            d = int(rng.choice(top[var[top] > 0]))
            cut = float(np.median(part[:, d]) if median else part[:, d].mean())
            below = part[:, d] < cut
            if below.all() or not below.any():
                return node
            tree.dim[node], tree.cut[node] = d, cut
            tree.low[node] = grow(rows[below])
            tree.high[node] = grow(rows[~below])
            return node

        grow(np.arange(len(x)))
        return tree

    def leaf_of(self, v: np.ndarray) -> int:
        at = 0
        while (d := self.dim[at]) >= 0:
            at = self.low[at] if v[d] < self.cut[at] else self.high[at]
        return at

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """:meth:`leaf_of` for every row, a level at a time."""
        dim, cut, low, high = (np.array(a) for a in (self.dim, self.cut, self.low, self.high))
        at, open_ = np.zeros(len(x), int), np.arange(len(x))
        while len(open_ := open_[dim[at[open_]] >= 0]):
            here = at[open_]
            at[open_] = np.where(x[open_, dim[here]] < cut[here], low[here], high[here])
        return at

    def nearest_leaves(self, v: np.ndarray, most: int) -> list[int]:
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            bound, at = heapq.heappop(heap)
            while (d := self.dim[at]) >= 0:
                gap = v[d] - self.cut[at]
                near, far = (self.low[at], self.high[at]) if gap < 0 else (self.high[at], self.low[at])
                heapq.heappush(heap, (bound + gap * gap, far))
                at = near
            out.append(at)
        return out

    def leaves_within(self, v: np.ndarray, radius2: float) -> list[int]:
        """All leaves whose box is within the squared distance of ``v``."""
        stack, out = [(0.0, 0, {})], []
        while stack:
            bound, at, gaps = stack.pop()
            while (d := self.dim[at]) >= 0:
                gap = v[d] - self.cut[at]
                near, far = (self.low[at], self.high[at]) if gap < 0 else (self.high[at], self.low[at])
                beyond = bound - gaps.get(d, 0.0) + gap * gap
                if beyond <= radius2:
                    stack.append((beyond, far, gaps | {d: gap * gap}))
                at = near
            out.append(at)
        return out


def build(data: DataFrame, trees: int = 4, leaf: int = 32, seed: int = 0, median: bool = False) -> list[KdTree]:
    """Trees fitted on a sample of ``id, v``."""
    rows = data.where("v IS NOT NULL").select("v").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(FIT_ROWS).collect()
    x = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)
    return [KdTree.build(x, leaf, np.random.RandomState(seed + t), median) for t in range(trees)]


def _leaves(forest: list[KdTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t, k in enumerate(forest):
                yield pa.record_batch({"id": batch.column(0), "v": batch.column(1), "tree": pa.array(np.full(len(x), t, np.int32)), "leaf": pa.array(k.leaves_of(x).astype(np.int32))})

    return run


def _visits(forest: list[KdTree], most: int | None):
    """Of every query, by tree and bucket, the leaves that it visits: the ``most`` of least bound, or all within its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tree, bucket, leaves = [], [], [], []
            for i, (v, r) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                v = np.array(v, float)
                for t, k in enumerate(forest):
                    found = np.array(k.nearest_leaves(v, most) if most is not None else k.leaves_within(v, np.inf if r is None else r * (1 + 1e-9) + 1e-12))
                    for at in np.unique(found % BUCKETS):
                        rows.append(i)
                        tree.append(t)
                        bucket.append(at)
                        leaves.append(np.sort(found[found % BUCKETS == at]))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch({"id": batch.column(0).take(at), "v": batch.column(1).take(at), "tree": pa.array(tree, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "leaves": pa.array(leaves, pa.list_(pa.int32()))})

    return run


_SCHEMA = "id long, v array<double>, tree int, leaf int"


def index(data: DataFrame, forest: list[KdTree]) -> DataFrame:
    """``id, v, tree, leaf``: every row in its leaf of every tree."""
    return data.where("v IS NOT NULL").select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(_leaves(forest), _SCHEMA)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), -1)


def _block(k: int):
    """The best ``k`` rows of a block for every query that comes to it, among the leaves that the query visits."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and rows.num_rows:
            leaf = rows.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, ids, x = leaf[order], rows.column("id").to_numpy()[order], _matrix(rows.column("v"))[order]
            asked_ids, q, leaves = asked.column("id").to_numpy(), _matrix(asked.column("v")), asked.column("leaves").combine_chunks()
            ends, flat = leaves.offsets.to_numpy(), leaves.values.to_numpy()
            held, which = np.unique(leaf, return_inverse=True)
            repeated = len(np.unique(ids)) < len(ids)
            norms = (x * x).sum(1)
            for i in range(0, len(q), 64):
                part = q[i : i + 64]
                rough = norms - 2 * part @ x.T + (part * part).sum(1)[:, None]
                # what the sum in another order may lose
                slack = 1e-12 * (norms.max() + (part * part).sum(1))
                for j in range(len(part)):
                    seen = np.isin(held, flat[ends[i + j] : ends[i + j + 1]], assume_unique=True)
                    at = np.arange(len(x)) if seen.all() else np.flatnonzero(seen[which])
                    least = rough[j, at]
                    if len(at) > 2 * k and not repeated:
                        at = at[~(least > np.partition(least, k - 1)[k - 1] + 2 * slack[j])]
                    d2 = block_values("l2", part[j : j + 1], x[at])[0]
                    best = np.lexsort((ids[at], d2))
                    if repeated:  # an id counts once, by its nearest row
                        best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])]
                    best = best[:k]
                    out.append((np.full(len(best), asked_ids[i + j]), ids[at][best], d2[best]))
        joined = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"q": pa.array(joined[0], pa.int64()), "id": pa.array(joined[1], pa.int64()), "d2": pa.array(joined[2], pa.float64())})

    return run


def _nearest(asked: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the rows in the leaves that the queries visit.  Rows lie in blocks by tree, bucket of leaves and hash; a query
    comes to the blocks of its buckets, and a block returns its best few, so no pair is a row."""
    salts, parts = (max(1, -(-df.count() // size)) for df, size in ((indexed, BLOCK * BUCKETS), (asked, QUERIES * BUCKETS)))
    dealt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select("id", "v", "leaves", "tree", "bucket", hashed(parts).alias("part"), dealt(salts).alias("salt"))
    right = indexed.select("id", "v", "leaf", "tree", (F.col("leaf") % BUCKETS).alias("bucket"), hashed(salts).alias("salt"), dealt(parts).alias("part"))
    keys = ["tree", "bucket", "salt", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k), "q long, id long, d2 double")
    once = met.groupBy("q", "id").agg(F.min("d2").alias("d2"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d2", "id"))).where(F.col("rank") <= k).select("q", "rank", "id", "d2")


def query(queries: DataFrame, indexed: DataFrame, forest: list[KdTree], k: int, leaves: int = 16, bounded: bool = False) -> DataFrame:
    """``q, rank, id, d2``: the k nearest of the rows met in ``leaves`` leaves of each tree.

    ``bounded`` goes on from there: the k-th distance met bounds the true one,
    and the first tree's leaves within it hold all of the k nearest, however
    large the table is.
    """
    wanted = queries.where("v IS NOT NULL").select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    visited = "id long, v array<double>, tree int, bucket int, leaves array<int>"
    first = _nearest(wanted.withColumn("radius2", F.lit(None).cast("double")).mapInArrow(_visits(forest, leaves), visited), indexed, k)
    if not bounded:
        return first
    radius = first.where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("d2").alias("radius2"))
    asked = durable(wanted.join(radius, "id", "left").select("id", "v", "radius2").mapInArrow(_visits(forest[:1], None), visited))
    return _nearest(asked, indexed.where("tree = 0"), k)
