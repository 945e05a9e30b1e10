"""Connected components over an edge table, by alternating stars.

Large-star: every node links its larger neighbours to the least node it
knows.  Small-star: every node links its smaller neighbours, and itself, to
the least of them.  The two alternate until nothing changes; then each
component is a star around its least node.  A round is a partial aggregation
and an equi-join; the joins' hubs are split by adaptive execution.  Every
round is written to the shared folder, so the plan stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # u < v in every edge: v's smaller neighbours, and v itself, link to the least of them
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    onward = edges.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))
    return onward.unionAll(least.select(F.col("m").alias("u"), "v")).distinct()


def component_roots(edges: DataFrame, name: str = "component") -> DataFrame:
    """``node, root`` for every node of an edge (``u, v``, both longs), where
    ``root`` is the least node of the component.  Self-loops and repeated edges
    are allowed; nodes without edges are absent; no edges give no rows."""
    edges = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialize(edges, name)
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), name)
        # the sum of the roots falls, or the number of edges does, until both stand
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(edges.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("root")))
        before = now
