"""Approximate nearest neighbours by inverted lists over residual codes, with exact re-ranking.

A coarse quantiser and codebooks are fitted on a bounded sample (``FIT_ROWS`` rows by hash); every
row is indexed by its list and the codes of its residual.  Rows are dealt to shards by hash, so a list
however long is spread evenly.  A query block meets each shard once, looks up the rows of
the lists that it probes, and keeps its best few; the distances of those are then taken from the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.vectors import pair_value
from trackloom.operators.quantise import codebooks, encoded, lloyd, looked_up, nearest_rows, parts_of
from trackloom.plans.stages import durable

#: Rows that fit the quantiser, most lists, subspaces and codewords.
FIT_ROWS, MOST_LISTS, PARTS, WORDS = 20_000, 4096, 16, 256
#: Rows of a shard, shards at least, and queries of a block.
SHARD_ROWS, SHARDS, QUERY_ROWS = 1 << 20, 16, 1 << 14


@dataclass
class Lists:
    centres: np.ndarray
    parts: list[slice]
    books: list[np.ndarray]


@dataclass
class Inverted:
    """The fitted lists, the indexed rows ``key, shard, list, codes``, and the vectors ``key, id, v``."""

    lists: Lists
    rows: DataFrame
    vectors: DataFrame
    shards: int


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(data: DataFrame, lists: int | None = None) -> Lists:
    """From about ``FIT_ROWS`` rows of ``v`` by hash; four times the square root of the rows is the number of lists."""
    n = data.count()
    sample = data.where(F.pmod(F.xxhash64("v"), F.lit(max(n, 1))) < FIT_ROWS).select("v").limit(2 * FIT_ROWS).toArrow().column("v").combine_chunks()
    x = _matrix(sample)
    x = x[np.lexsort(x.T[::-1])][np.random.RandomState(0).permutation(len(x))]
    if not len(x):
        return Lists(np.zeros((1, 1)), [], [])
    k = max(1, min(lists or min(int(4 * n**0.5), n // 8), MOST_LISTS, len(x)))
    centres, parts = lloyd(x, x[:k].copy(), 6), parts_of(x.shape[1], PARTS)
    return Lists(centres, parts, codebooks(x - centres[nearest_rows(x, centres)], parts, WORDS))


def _coded(lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lists.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                at = nearest_rows(x, model.centres)
                codes, _ = encoded(x - model.centres[at], model.parts, model.books)
                yield pa.record_batch({"key": batch.column(0), "list": pa.array(at.astype(np.int32)), "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

    return run


def index(data: DataFrame, lists: int | None = None) -> Inverted:
    """Every row of ``id, v`` (vectors of one length; rows with a null id or vector or a null component take no part)."""
    whole = data.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    vectors = durable(whole.select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    model = fit(vectors, lists)
    shards = max(SHARDS, -(-vectors.count() // SHARD_ROWS))
    rows = vectors.select("key", "v").mapInArrow(_coded(data.sparkSession.sparkContext.broadcast(model)), "key long, list int, codes binary")
    return Inverted(model, durable(rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))), vectors, shards)


def _shortlists(lists, probes: float, keep: int):
    """``q, key, estimate``: the best of a shard for each query of a block, by table look-up."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        model, out = lists.value, []
        if rows.num_rows and asked.num_rows:
            at, keys = rows.column("list").to_numpy(), rows.column("key").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            order = np.argsort(at, kind="stable")
            at, keys, codes = at[order], keys[order], codes[order]
            starts = np.searchsorted(at, np.arange(len(model.centres) + 1))
            q, x = asked.column("q").to_numpy(), _matrix(asked.column("v").combine_chunks())
            most = max(1, int(np.ceil(probes * len(model.centres))))
            step = max(1, (1 << 21) // max(len(keys), len(model.centres)))
            for k in range(0, len(x), step):
                some = x[k : k + step]
                d = (model.centres**2).sum(1) - 2 * some @ model.centres.T
                probed = np.zeros(d.shape, bool)
                np.put_along_axis(probed, np.argpartition(d, most - 1, 1)[:, :most], True, 1)
                estimate = np.full((len(some), len(keys)), np.inf)
                for j in np.nonzero(probed.any(0) & (np.diff(starts) > 0))[0]:
                    who, rows_of = np.nonzero(probed[:, j])[0], slice(starts[j], starts[j + 1])
                    estimate[who, rows_of] = looked_up(some[who] - model.centres[j], codes[rows_of], model.parts, model.books)
                n = min(keep, len(keys))
                best = np.argpartition(estimate, n - 1, 1)[:, :n]
                value = np.take_along_axis(estimate, best, 1)
                found = np.isfinite(value)
                out.append((np.repeat(q[k : k + step], n).reshape(-1, n)[found], keys[best][found], value[found]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": pa.array(columns[0]), "key": pa.array(columns[1]), "estimate": pa.array(columns[2])})

    return run


def query(queries: DataFrame, indexed: Inverted, k: int, probes: float = 0.5, keep: int = 8) -> DataFrame:
    """``q, rank, id, d2``: nearly the k nearest rows (squared L2, ties to the lower id) of each query ``id, v``.

    A query looks up the rows of the nearest ``probes`` of all lists; the vectors of its best
    ``keep`` times k decide.  With all lists and rows kept the result is exact.
    """
    whole = queries.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    asked = durable(whole.select(F.monotonically_increasing_id().alias("q"), F.col("id").cast("long").alias("asked"), F.col("v").cast("array<double>").alias("v")))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    spread = F.explode(F.sequence(F.lit(0), F.lit(indexed.shards - 1)))
    sent = asked.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")).select("*", spread.alias("shard"))
    rows = indexed.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    lists = queries.sparkSession.sparkContext.broadcast(indexed.lists)
    found = rows.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_shortlists(lists, probes, keep * k), "q long, key long, estimate double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("estimate", "key"))).where(F.col("r") <= keep * k).select("q", "key")
    near = best.join(indexed.vectors, "key").join(asked.select("q", "asked", F.col("v").alias("w")), "q")
    near = near.select("q", "asked", "id", pair_value("l2", F.col("v"), F.col("w")).alias("d2"), "key")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d2", "id", "key"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("asked").alias("q"), "rank", "id", "d2")
