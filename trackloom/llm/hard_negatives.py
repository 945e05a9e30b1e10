"""Hard-negative mining: a full score sort for each anchor, taken block by block.

Anchors are packed into blocks, and so are all rows.  An anchor block meets a row block in one
task: integer scores are computed, each anchor's scores in the block are sorted by score
and id, the upper limit of each positive is found by binary search, and the first k rows of another label above its
lower limit are read.  What a block pair returns is at most k rows for an anchor and a positive, merged
afterwards.  Positives are found by a first such pass over the rows of the anchors' labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

#: Anchors and rows of a block.
ANCHORS, ROWS = 512, 8192
#: Sums of products below this are whole in double precision.
EXACT = float(1 << 53)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where no sum can leave their whole numbers, else by longs."""
    largest = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (a, x)]
    if largest[0] * largest[1] * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def _packed(size: int, positives: int = 0):
    """Blocks of up to ``size`` vectors of one length, by id: ``head`` (key, id and label of each) and ``m``, as longs,
    and ``asked``: key, id and score of each one's ``positives``, key -1 where there are fewer."""

    def block(dims: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        head, m, asked = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((head[:, 0], head[:, 1]))
        packed = [pa.array([np.ascontiguousarray(c[order]).tobytes()], pa.binary()) for c in (head, m, asked)]
        return pa.record_batch([pa.array([dims], pa.int32()), *packed], names=["dims", "head", "m", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            head = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            asked = np.full((len(head), positives, 3), -1, np.int64)
            for i, found in enumerate(batch.column(4).to_pylist() if positives else ()):
                for j, p in enumerate(found):
                    asked[i, j] = (p["positive"], p["positive_id"], p["score"])
            lists = batch.column(3)
            flat, cuts = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            sizes = np.diff(cuts)
            for dims in map(int, np.unique(sizes)):
                places = np.nonzero(sizes == dims)[0]
                most = max(1, size // max(1, dims // 64))
                for k in range(0, len(places), most):
                    at = places[k : k + most]
                    own = held.setdefault(dims, [])
                    if own and sum(len(p[0]) for p in own) + len(at) > most:
                        yield block(dims, held.pop(dims))
                        own = held.setdefault(dims, [])
                    own.append((head[at], flat[cuts[at][:, None] + np.arange(dims)].reshape(len(at), dims), asked[at]))
        for dims, own in held.items():
            yield block(dims, own)

    return run


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of blocks of one length: anchors' heads, vectors and what they ask, rows' heads and vectors."""
    for dims, ah, am, asked, length, xh, xm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if dims == length:
            a, x = (np.frombuffer(h, np.int64).reshape(-1, 3) for h in (ah, xh))
            yield a, np.frombuffer(am, np.int64).reshape(len(a), dims), np.frombuffer(asked, np.int64).reshape(len(a), -1, 3) if asked else None, x, np.frombuffer(xm, np.int64).reshape(len(x), dims)


def ordered(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by score, highest first, ties by the smaller id."""
    return np.lexsort((ids, -score))


def _records(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)


_NEAR = ["anchor", "positive", "positive_id", "score"]
_FOUND = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score"]


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, av, _, x, xv in _opened(batch):
                out = []
                for label in np.unique(a[:, 2]):
                    own, same = np.nonzero(a[:, 2] == label)[0], np.nonzero(x[:, 2] == label)[0]
                    for i, row in zip(own, scores(av[own], xv[same]), strict=True):
                        best = ordered(row, x[same, 1])[: k + 1]
                        best = best[x[same[best], 0] != a[i, 0]][:k]
                        out += [(int(a[i, 0]), int(x[same[j], 0]), int(x[same[j], 1]), int(row[j])) for j in best]
                if out:
                    yield _records(out, _NEAR)

    return run


def read_negatives(score: np.ndarray, other: np.ndarray, positive: int, k: int, low: int, high: int) -> np.ndarray:
    """The first k places of another label with ``low * positive <= 100 * score <= high * positive``, best first.

    ``score`` is sorted by :func:`ordered`, and ``other`` are the places of another label in that order.
    """
    falling = -score[other]
    start = np.searchsorted(falling, -(high * positive // 100))
    stop = np.searchsorted(falling, -(-(-low * positive // 100)), side="right")
    return other[start : min(stop, start + k)]


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, av, asked, x, xv in _opened(batch):
                s, out = scores(av, xv), []
                for i in range(len(a)):
                    order = ordered(s[i], x[:, 1])
                    sorted_, other = s[i][order], np.nonzero(x[order, 2] != a[i, 2])[0]
                    for key, positive, at in asked[i].tolist():
                        for j in read_negatives(sorted_, other, at, k, low, high) if key >= 0 else ():
                            out.append((int(a[i, 0]), int(a[i, 1]), key, positive, at, int(x[order[j], 0]), int(x[order[j], 1]), int(sorted_[j])))
                if out:
                    yield _records(out, _FOUND)

    return run


def mine_negatives(rows: DataFrame, anchors: str, k: int = 5, positives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``id, label, v`` (longs).

    ``anchors`` is the condition of the stated query set.  An anchor's positives are its first
    ``positives`` other rows of its label; a positive's negatives are the first ``k`` rows of other labels
    with ``low`` to ``high`` percent of its score.

    Defined cases: rows with a null id, label or vector or a null component take no part;
    vectors of different lengths do not meet; repeated rows and ids are rows of their own, so an anchor's copy
    is a positive of it; a positive score below zero has no negatives; scores beyond a long wrap;
    an empty table gives no rows.
    """
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    kept = rows.where(whole).select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    kept = materialize(kept, "mined")
    packed = "dims int, head binary, m binary, asked binary"
    blocks = materialize(kept.mapInArrow(_packed(ROWS), packed).select(F.col("dims").alias("length"), F.col("head").alias("xhead"), F.col("m").alias("xm")), "mined_blocks")
    blocks = blocks.repartition(max(1, min(blocks.count(), 10_000)))
    asking = kept.where(anchors)
    # the stated query set against all rows, in blocks
    near = asking.mapInArrow(_packed(ANCHORS), packed).crossJoin(blocks).mapInArrow(_positives(positives), ", ".join(f"{c} long" for c in _NEAR))
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive"))
    near = near.withColumn("r", rank).where(F.col("r") <= positives).groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "score")).alias("wanted"))
    asked = materialize(asking.join(near, asking["key"] == near["anchor"]).select("key", "id", "label", "v", "wanted").mapInArrow(_packed(ANCHORS, positives), packed), "mining_anchors")
    found = asked.crossJoin(blocks).mapInArrow(_negatives(k, low, high), ", ".join(f"{c} long" for c in _FOUND))
    order = W.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", flip: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """``id, label, v``: components times ``scale``, rounded down; every ``flip``-th id has the next of ``labels`` labels.
    Vectors with null or non-finite components are null; whole numbers beyond a long are the last long."""
    label = F.when(F.col(id_col) % flip == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).alias("id"), label.alias("label"), F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale))).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(whole_vectors(table(spark, sf_dir, "embeddings")), "id % 100 = 0")


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
