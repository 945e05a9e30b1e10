"""Histograms and binning: bin search, weighted sums, marginals, tree and integral histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.plans.stages import durable, small_side


def bin_search(x: Column, edges: Sequence[float]) -> Column:
    """Index i with ``edges[i] <= x < edges[i + 1]``, counted from 1; 0 below the first edge,
    the number of edges at or above the last.  NaN gives 0, null gives null."""
    found = sum((F.when(x >= float(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(x.isNull(), F.lit(None).cast("int")).when(F.isnan(x.cast("double")), 0).otherwise(found)


def bin_sum(acc: DataFrame, obs: DataFrame, bin_col: str = "bin", acc_col: str = "h", value_col: str = "x") -> DataFrame:
    """``acc`` (a row for each bin from 1 on) plus the sums of ``obs`` by bin.

    Bin 0 and null bins are skipped; a bin that ``acc`` lacks is an error.
    The accumulator is the mergeable state: sums of sums give the same result.
    """
    sums = obs.where(F.col(bin_col) != 0).groupBy(bin_col).agg(F.sum(value_col).alias("__s"))
    joined = acc.withColumn("__known", F.lit(True)).join(sums, bin_col, "full")
    known = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("bin out of range: "), F.col(bin_col).cast("string"))).cast("int")).otherwise(F.lit(0))
    return joined.select(bin_col, (F.coalesce(acc_col, F.lit(0)) + F.coalesce("__s", F.lit(0)) + known).alias(acc_col))


def weighted_histogram(df: DataFrame, x: Column, w: Column, edges: Sequence[float]) -> DataFrame:
    """``bin, h`` for every edge: summed weights of ``edges[i] <= x < edges[i + 1]``;
    the last bin holds exactly the last edge.  NaN and outside values drop out."""
    k = bin_search(x, edges)
    inside = F.when((k == len(edges)) & (x > float(edges[-1])), 0).otherwise(k) if edges else F.lit(0)
    sums = df.select(inside.alias("bin"), w.alias("w")).where("bin > 0").groupBy("bin").agg(F.sum("w").alias("h"))
    dense = df.sparkSession.range(1, len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return dense.join(sums, "bin", "left").select("bin", F.coalesce("h", F.lit(0.0)).alias("h"))


def grid_votes(df: DataFrame, x: Column, y: Column, width: float, height: float, cells: int) -> DataFrame:
    """``row, col, votes`` for every cell of a ``cells`` x ``cells`` grid over (0, width) x (0, height)."""
    at = lambda v, size: F.floor(v / (size / cells)).cast("int")
    votes = df.select(at(y, height).alias("row"), at(x, width).alias("col")).where(f"row BETWEEN 0 AND {cells - 1} AND col BETWEEN 0 AND {cells - 1}").groupBy("row", "col").agg(F.count("*").alias("votes"))
    dense = df.sparkSession.range(cells * cells).select((F.col("id") / cells).cast("int").alias("row"), (F.col("id") % cells).cast("int").alias("col"))
    return dense.join(votes, ["row", "col"], "left").select("row", "col", F.coalesce("votes", F.lit(0)).alias("votes"))


def marginal(hist: DataFrame, keep: list[str], value: str = "h") -> DataFrame:
    """Sum a histogram over every dimension but ``keep``."""
    return hist.groupBy(*keep).agg(F.sum(value).alias(value))


def label_counts(df: DataFrame, labels: list[str]) -> DataFrame:
    """Occurrences of each label tuple.  A tuple of zeros only is not a label."""
    zero = F.lit(True)
    for c in labels:
        zero = zero & F.col(c).eqNullSafe(F.lit(0))
    return df.where(~zero).groupBy(*labels).agg(F.count("*").alias("n"))


def label_lookup(queries: DataFrame, counts: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of the queried labels, 0 where a label is unknown."""
    return queries.join(counts, labels, "left").select(*queries.columns, F.coalesce("n", F.lit(0)).alias("n"))


def tree_histogram(df: DataFrame, path: list[str]) -> DataFrame:
    """How many paths pass each node of a tree: every prefix of ``path``, and the root.

    ``depth`` tells a prefix from a null label.
    """
    depth = len(path)
    level = F.lit(depth) - F.length(F.regexp_replace(F.bin(F.grouping_id()), "0", ""))
    return df.rollup(*path).agg(level.cast("int").alias("depth"), F.count("*").alias("n")).select("depth", *path, "n")


def ancestors(parents: DataFrame) -> DataFrame:
    """``node, ancestor`` (the node itself included) of a parent table ``node, parent``;
    a root has parent 0.  Pointer doubling: a round for each power of two of the depth, each
    written to the shared folder."""
    up = parents.select("node", F.when(F.col("parent") != 0, F.col("parent")).alias("jump"))
    closure = parents.select("node", F.col("node").alias("ancestor"))
    while not up.where("jump IS NOT NULL").isEmpty():
        up, closure = durable(up), durable(closure)
        hop = up.select(F.col("node").alias("ancestor"), "jump")
        closure = closure.union(closure.join(hop, "ancestor").where("jump IS NOT NULL").select("node", F.col("jump").alias("ancestor"))).distinct()
        onward = up.select(F.col("node").alias("jump"), F.col("jump").alias("__next"))
        up = up.join(onward, "jump", "left").select("node", F.col("__next").alias("jump"))
    return closure


def merge_tree_histogram(parents: DataFrame, data: DataFrame, value: str = "x") -> DataFrame:
    """Counts of ``data`` at every node of a merge tree: each value counts for all its ancestors."""
    counted = data.groupBy(value).agg(F.count("*").alias("n"))
    up = ancestors(parents)
    sums = up.join(counted, up["node"] == counted[value]).groupBy("ancestor").agg(F.sum("n").alias("n"))
    return parents.join(sums, parents["node"] == sums["ancestor"], "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def cut_histogram(cut_map: DataFrame, data: DataFrame, n_clusters: int, nulls: str = "drop", value: str = "x") -> DataFrame:
    """``cluster, n`` over a cut ``x, cluster``; values whose cluster is 0 or missing are
    dropped, appended as a last cluster, or counted in the first of one more cluster."""
    mapped = data.join(cut_map, value, "left").select(F.coalesce("cluster", F.lit(0)).alias("cluster"))
    if nulls == "append":
        mapped, total = mapped.select(F.when(F.col("cluster") == 0, n_clusters + 1).otherwise(F.col("cluster")).alias("cluster")), n_clusters + 1
    elif nulls == "first":
        mapped, total = mapped.select((F.col("cluster") + 1).alias("cluster")), n_clusters + 1
    elif nulls == "drop":
        mapped, total = mapped.where("cluster > 0"), n_clusters
    else:
        raise ValueError(f"nulls: {nulls}")
    dense = data.sparkSession.range(1, total + 1).select(F.col("id").cast("int").alias("cluster"))
    return dense.join(mapped.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def integral_image(pixels: DataFrame, value: str = "v", image: list[str] | None = None) -> DataFrame:
    """Sums over all pixels up to and with (y, x): one running sum along x, then one along y.
    The pixels must be a dense grid."""
    image = image or []
    along = lambda by, order: W.partitionBy(*image, by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = pixels.withColumn("__r", F.sum(value).over(along("y", "x")))
    return rows.withColumn("s", F.sum("__r").over(along("x", "y"))).drop("__r")


def integral_histogram(pixels: DataFrame, label: str = "label") -> DataFrame:
    """``y, x, label, n``: pixels with a label up to and with (y, x).  Label 0 is
    ignored and layers add up.  The grid is dense for every label that occurs."""
    seen = pixels.where(F.col(label) != 0).groupBy("y", "x", label).agg(F.count("*").alias("v"))
    grid = pixels.select("y", "x").distinct().join(pixels.where(F.col(label) != 0).select(label).distinct())
    dense = grid.join(seen, ["y", "x", label], "left").select("y", "x", label, F.coalesce("v", F.lit(0)).alias("v"))
    return integral_image(dense, "v", [label]).select("y", "x", label, F.col("s").alias("n"))


def sample_integral(integral: DataFrame, boxes: DataFrame, labels: list[str], value: str = "n") -> DataFrame:
    """Sums within boxes ``box, y0, x0, y1, x1`` (both ends inclusive) from four corners.

    An empty box has sum 0.  ``boxes`` is a parameter table; it is broadcast if it is small.
    """
    corners = F.array(
        F.struct(F.col("y1").alias("y"), F.col("x1").alias("x"), F.lit(1).alias("sign")), F.struct((F.col("y0") - 1).alias("y"), F.col("x1").alias("x"), F.lit(-1).alias("sign")),
        F.struct(F.col("y1").alias("y"), (F.col("x0") - 1).alias("x"), F.lit(-1).alias("sign")), F.struct((F.col("y0") - 1).alias("y"), (F.col("x0") - 1).alias("x"), F.lit(1).alias("sign")),
    )
    wanted = boxes.where("y0 <= y1 AND x0 <= x1").select("box", F.explode(corners).alias("c")).select("box", "c.y", "c.x", "c.sign")
    sums = integral.join(small_side(wanted), ["y", "x"]).groupBy("box", *labels).agg(F.sum(F.col("sign") * F.col(value)).alias(value))
    every = boxes.select("box")
    if labels:
        every = every.join(integral.select(*labels).distinct())
    return every.join(sums, ["box", *labels], "left").select("box", *labels, F.coalesce(value, F.lit(0)).alias(value))
