"""Pairwise distances, ratio-test matching, nearest neighbours, nearest centres.

Searches take a stated set of queries against all rows.  Rows are packed into
blocks, each query block meets each data block once, and a block pair keeps
only the best few for each query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from trackloom.functions.vectors import pair_value
from trackloom.plans.stages import small_side

QUERY_BLOCK, DATA_BLOCK = 1024, 8192
#: Centres that are broadcast in one row.
MOST_CENTRES = 10_000


def _xlog(x: np.ndarray, over: np.ndarray) -> np.ndarray:
    ok = (x > 0) & (over > 0)
    return np.where(ok, x * np.log2(np.where(ok, x, 1) / np.where(ok, over, 1)), 0.0)


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.where(bottom == 0, 0.0, top / np.where(bottom == 0, 1.0, bottom))


#: The terms of ``functions.vectors`` on whole blocks; a distance is their sum.
TERMS = {
    "l2": lambda x, y: (x - y) ** 2, "l1": lambda x, y: np.abs(x - y), "l0": lambda x, y: (x != y).astype(float), "chi2": lambda x, y: _ratio((x - y) ** 2, x + y), "hell": lambda x, y: (np.sqrt(x) - np.sqrt(y)) ** 2,
    "js": lambda x, y: _xlog(x, (x + y) / 2) + _xlog(y, (x + y) / 2), "kl2": lambda x, y: x * y, "kl1": np.minimum, "min": np.minimum, "kchi2": lambda x, y: _ratio(2 * x * y, x + y), "khell": lambda x, y: np.sqrt(x * y),
    "kjs": lambda x, y: 0.5 * (_xlog_up(x, x + y) + _xlog_up(y, x + y)),
}


def _xlog_up(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    ok = (x > 0) & (whole > 0)
    return np.where(ok, x * np.log2(np.where(ok, whole, 1) / np.where(ok, x, 1)), 0.0)


def block_values(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The metric between all rows of two blocks; terms are added in their order, as expressions add them."""
    a, b = x[:, None, :], y[None, :, :]
    with np.errstate(invalid="ignore"):
        return np.abs(a - b).max(-1, initial=0.0) if metric == "linf" else TERMS[metric](a, b).cumsum(-1)[..., -1]


def _to_block(c: np.ndarray, kept: pa.Table, metrics: list[str], at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = c.shape
        rows = max(1, (1 << 20) // max(1, k * dims))
        for batch in batches:
            vectors = batch.column(at).to_pylist()
            good = np.array([v is not None and len(v) == dims and None not in v for v in vectors], bool)
            x = np.array([v if ok else [0.0] * dims for v, ok in zip(vectors, good, strict=True)], float).reshape(-1, dims)
            for i in range(0, len(x), rows):
                part, ok = x[i : i + rows], np.repeat(good[i : i + rows], k)
                left = batch.take(pa.array(np.repeat(np.arange(i, i + len(part)), k)))
                right = kept.take(pa.array(np.tile(np.arange(k), len(part))))
                columns = [left.column(j) for j in range(batch.num_columns) if j != at] + [c.combine_chunks() for c in right.columns]
                columns += [pa.array(block_values(m, part, c).ravel(), mask=~ok) for m in metrics]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def to_references(df: DataFrame, refs: DataFrame, metrics: list[str], vector: str = "v", ref_vector: str = "c") -> DataFrame:
    """``df`` x ``refs`` with a column for each metric.  ``refs`` is the stated, small side
    (centres, prototypes): up to ``MOST_CENTRES`` whole vectors of one length go to the tasks,
    which take whole blocks against them; more of them, or vectors with gaps, are joined.  A vector
    that is null, has a null or another length has null values."""
    rows = refs.limit(MOST_CENTRES + 1).collect()
    lengths = {len(r[ref_vector]) if r[ref_vector] is not None and None not in r[ref_vector] else -1 for r in rows}
    if len(rows) <= MOST_CENTRES and len(lengths) == 1 and min(lengths) > 0:
        fields = [f for f in df.schema if f.name != vector] + [f for f in refs.schema if f.name != ref_vector]
        kept = pa.table({f.name: pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in refs.schema if f.name != ref_vector})
        schema = StructType([*fields, *(StructField(m, DoubleType()) for m in metrics)])
        return df.mapInArrow(_to_block(np.array([r[ref_vector] for r in rows], float), kept, metrics, df.columns.index(vector), schema.names), schema)
    joined = df.crossJoin(refs)
    whole = (F.size(vector) == F.size(ref_vector)) & ~F.exists(vector, lambda x: x.isNull()) & ~F.exists(ref_vector, lambda x: x.isNull())
    return joined.select(*(c for c in df.columns if c != vector), *(c for c in refs.columns if c != ref_vector), *(F.when(whole, pair_value(m, F.col(vector), F.col(ref_vector))).alias(m) for m in metrics))


def blocks(df: DataFrame, size: int, key: str = "id", vector: str = "v") -> DataFrame:
    """``ids, m``: up to ``size`` vectors a row, as packed doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                ids.append(i)
                rows.append(np.array(v, np.float64))
                if len(ids) == size:
                    yield _block(ids, rows)
                    ids, rows = [], []
        if ids:
            yield _block(ids, rows)

    return df.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(pack, "ids array<long>, m binary")


def _block(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"ids": pa.array([ids], pa.list_(pa.int64())), "m": pa.array([np.stack(rows).tobytes()], pa.binary())})


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact sums of squared differences, a slice of queries at a time."""
    out = np.empty((len(q), len(x)))
    for i in range(len(q)):
        d = x - q[i]
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def _best(k: int, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qm, xi, xm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, x = (np.frombuffer(m).reshape(len(i), -1) for i, m in ((qi, qm), (xi, xm)))
                qi, xi = np.array(qi), np.array(xi)
                d = squared_distances(q, x)
                if skip_self:
                    d[qi[:, None] == xi[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(xi, d.shape), d), axis=1)[:, :k]
                best = np.take_along_axis(d, order, 1)
                ok = np.isfinite(best)
                yield pa.record_batch({"q": pa.array(np.repeat(qi, order.shape[1])[ok.ravel()]), "id": pa.array(xi[order][ok]), "d2": pa.array(best[ok])})

    return run


def nearest_neighbours(queries: DataFrame, data: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """``q, rank, id, d2``: the k nearest rows (squared L2, ties to the lower id) of each query.

    Inputs are ``id, v``; rows with a null id or vector take no part.
    """
    q = blocks(queries, QUERY_BLOCK).select(F.col("ids").alias("qi"), F.col("m").alias("qm"))
    x = blocks(data, DATA_BLOCK)
    found = x.crossJoin(q).select("qi", "qm", "ids", "m").mapInArrow(_best(k, skip_self), "q long, id long, d2 double")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d2", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "d2")


def ratio_match(left: DataFrame, right: DataFrame, thresh: float = 1.5, skip_self: bool = False) -> DataFrame:
    """``k1, k2, d2``: the best match of each left row, if ``thresh`` times its squared
    distance is strictly below the second best's.  With one candidate it is accepted."""
    near = nearest_neighbours(left, right, 2, skip_self)
    both = near.groupBy("q").agg(F.min_by("id", "rank").alias("k2"), F.min(F.when(F.col("rank") == 1, F.col("d2"))).alias("d2"), F.max(F.when(F.col("rank") == 2, F.col("d2"))).alias("second"))
    return both.where(F.col("second").isNull() | (thresh * F.col("d2") < F.col("second"))).select(F.col("q").alias("k1"), "k2", "d2")


def nearest_centre(vector: Column, centres: list[tuple[int, list[float]]], metric: str = "l2") -> Column:
    """The id of the nearest of a fixed list of centres (ties to the lower id), without a join."""
    literal = lambda c: F.array(*(F.lit(float(x)) for x in c))
    scored = F.array(*(F.struct(pair_value(metric, vector, literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in centres))
    return F.when(vector.isNotNull(), F.array_min(scored)["i"])


def push_centres(df: DataFrame, centres: DataFrame, metric: str = "l2") -> DataFrame:
    """``id, centre, d`` for ``id, v`` and a table of centres ``centre, c`` (the small side, packed into
    one row and broadcast if it has at most ``MOST_CENTRES``).  The minimum is taken where the row is,
    so nothing is shuffled and repeated ids stay apart; ties go to the lower centre."""
    few = centres.limit(MOST_CENTRES + 1).count() <= MOST_CENTRES
    if not few:
        rows = df.select("id", "v").withColumn("__r", F.monotonically_increasing_id())
        scored = to_references(rows, centres.select("centre", "c"), [metric])
        return scored.groupBy("__r").agg(F.first("id").alias("id"), F.min(F.struct(F.col(metric).alias("d"), "centre")).alias("m")).select("id", "m.centre", "m.d")
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("centre", "c"))).alias("__c")).where(F.size("__c") > 0)
    best = F.array_min(F.transform("__c", lambda r: F.struct(pair_value(metric, F.col("v"), r["c"]).alias("d"), r["centre"].alias("centre"))))
    return df.select("id", "v").crossJoin(F.broadcast(packed)).select("id", best.alias("m")).select("id", "m.centre", "m.d")


def push_tree(df: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """``id, path``: nearest centres from root to leaf of a tree ``node, parent, c`` (root's parent 0).
    A step is taken where the row is, so repeated ids stay apart."""
    children = small_side(tree.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("node", "c"))).alias("__c")))
    best = F.array_min(F.transform("__c", lambda r: F.struct(pair_value("l2", F.col("v"), r["c"]).alias("d"), r["node"].alias("node"))))
    at = df.select("id", "v", F.lit(0).alias("parent"), F.array().cast("array<int>").alias("path"))
    for _ in range(depth):
        at = at.join(children, "parent").select("id", "v", "path", best["node"].alias("parent"))
        at = at.select("id", "v", "parent", F.concat("path", F.array("parent")).alias("path"))
    return at.select("id", "path")
