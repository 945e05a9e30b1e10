"""Inverted lists over residual codes against exact search."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import distance as D
from trackloom.operators import inverted as V
from trackloom.plans.tables import vectors


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def exact(q, x, k):
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return d, order


def test_all_lists_are_exact(spark, monkeypatch):
    rnd = np.random.RandomState(2)
    x = rnd.normal(size=(400, 10)).round(1)
    for shards, rows in ((16, 1 << 14), (3, 7)):
        monkeypatch.setattr(V, "SHARDS", shards)
        monkeypatch.setattr(V, "QUERY_ROWS", rows)
        got = V.query(frame(spark, x[:30]), V.index(frame(spark, x)), 5, probes=1.0, keep=100).collect()
        d, order = exact(x[:30], x, 5)
        assert {(r["q"], r["rank"]): round(r["d2"], 6) for r in got} == {(q, k + 1): round(float(d[q, i]), 6) for q in range(30) for k, i in enumerate(order[q])}
        assert all(abs(d[r["q"], r["id"]] - r["d2"]) < 1e-9 for r in got)  # equal distances may differ in their last bits


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_whole_embeddings(spark, sf):
    rows = vectors(spark, f"/root/testdata/{sf}").select("id", "v")
    asked = rows.where(F.col("id") % 100 == 0)
    near = {(r["q"], r["id"]) for r in V.query(asked, V.index(rows), 7).collect()}
    want = {(r["q"], r["id"]) for r in D.nearest_neighbours(asked, rows, 7).collect()}
    assert len(near) == len(want) and len(near & want) >= 0.9 * len(want)


def test_a_hot_list_and_repeated_ids(spark):
    """A third of the rows are one vector; ids repeat; some rows have none."""
    rnd = np.random.RandomState(4)
    x = np.concatenate([np.repeat(rnd.normal(size=(1, 6)), 300, 0), rnd.normal(size=(600, 6))])
    df = frame(spark, x).withColumn("id", F.when(F.col("id") < 300, F.lit(7)).otherwise(F.col("id")))
    df = df.unionAll(spark.createDataFrame([(None, [0.0] * 6), (5, None), (6, [None] + [0.0] * 5)], "id long, v array<double>"))
    indexed = V.index(df)
    sizes = collections.Counter(r["shard"] for r in indexed.rows.collect())
    assert sum(sizes.values()) == 900 and max(sizes.values()) < 3 * 900 / 16
    got = V.query(frame(spark, x[:1], 50).unionAll(frame(spark, x[:1], 50)), indexed, 4).collect()
    assert sorted((r["q"], r["rank"], r["id"], r["d2"]) for r in got) == sorted((50, k, 7, 0.0) for k in range(1, 5) for _ in range(2))
    assert V.query(df.limit(0), indexed, 4).collect() == []
    assert V.query(frame(spark, x[:1]), V.index(df.limit(0)), 4).collect() == []
