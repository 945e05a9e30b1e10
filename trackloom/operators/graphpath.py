"""Shortest paths on a layered graph: one layer for each window, coupled over two videos.

``edges`` are ``k, s, t, w``: the weight from label s in window k to label t
in window k + 1; ``links`` are ``k, s, t, w``: between label s of the first and
label t of the second video in one window.  An absent edge is no edge.
A dynamic program runs over the windows; each step is one equi-join and a
``min_by``, and the path rides along as an array, so nothing is traced back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.stages import durable


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint (in the shared folder): the loop's plan would double otherwise."""
    return durable(df)


def single_paths(edges: DataFrame, nodes: DataFrame, n_windows: int, forward: bool = True, every: int = 8) -> DataFrame:
    """``k, s, dist, path``: the least cost from window 0 to each node (or, backward, from each
    node to the last window) for ``nodes`` (``k, s``).  Ties go to the lower labels."""
    first, step = (0, 1) if forward else (n_windows - 1, -1)
    state = nodes.where(F.col("k") == first).select("s", F.lit(0.0).alias("dist"), F.array("s").alias("path"))
    out = state.withColumn("k", F.lit(first))
    for i in range(1, n_windows):
        k = first + i * step
        e = edges.where(F.col("k") == min(k, k - step)).select(F.col("s").alias("a"), F.col("t").alias("b"), "w")
        e = e.select(F.col("a" if forward else "b").alias("s"), F.col("b" if forward else "a").alias("to"), "w")
        ways = state.join(e, "s").select(F.col("to").alias("s"), (F.col("dist") + F.col("w")).alias("dist"), F.concat("path", F.array("to")).alias("path") if forward else F.concat(F.array("to"), "path").alias("path"))
        state = ways.groupBy("s").agg(F.min(F.struct("dist", "path")).alias("m")).select("s", "m.dist", "m.path")
        if i % every == 0:
            state = _cut(state)
        out = out.unionByName(state.withColumn("k", F.lit(k)))
    return out.select("k", "s", "dist", "path")


def coupled_paths(edges_a: DataFrame, edges_b: DataFrame, links: DataFrame, n_windows: int, forward: bool = True, every: int = 4) -> DataFrame:
    """``k, s, t, dist, path_a, path_b``: dist(k, s, t) = min over m, n of dist(k-1, m, n)
    + w_a(m, s) + w_b(n, t) + link(s, t)."""
    first, step = (0, 1) if forward else (n_windows - 1, -1)
    state = links.where(F.col("k") == first).select("s", "t", F.col("w").alias("dist"), F.array("s").alias("path_a"), F.array("t").alias("path_b"))
    out = state.withColumn("k", F.lit(first))
    for i in range(1, n_windows):
        k = first + i * step

        def layer(edges: DataFrame, here: str, to: str, cost: str, k: int = k) -> DataFrame:
            e = edges.where(F.col("k") == min(k, k - step))
            return e.select(F.col("s" if forward else "t").alias(here), F.col("t" if forward else "s").alias(to), F.col("w").alias(cost))

        link = links.where(F.col("k") == k).select(F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("w").alias("l"))
        grow = lambda path, to: F.concat(path, F.array(to)) if forward else F.concat(F.array(to), path)
        ways = state.join(layer(edges_a, "s", "s2", "wa"), "s").join(layer(edges_b, "t", "t2", "wb"), "t").join(link, ["s2", "t2"])
        ways = ways.select(F.col("s2").alias("s"), F.col("t2").alias("t"), (F.col("dist") + F.col("wa") + F.col("wb") + F.col("l")).alias("dist"), grow("path_a", "s2").alias("path_a"), grow("path_b", "t2").alias("path_b"))
        state = ways.groupBy("s", "t").agg(F.min(F.struct("dist", "path_a", "path_b")).alias("m")).select("s", "t", "m.dist", "m.path_a", "m.path_b")
        if i % every == 0:
            state = _cut(state)
        out = out.unionByName(state.withColumn("k", F.lit(k)))
    return out.select("k", "s", "t", "dist", "path_a", "path_b")


def every_path(edges_a: DataFrame, edges_b: DataFrame, links: DataFrame, n_windows: int) -> DataFrame:
    """``dist, path_a, path_b`` of every pair of whole paths: the number is exponential in the windows, so
    this is for holding :func:`coupled_paths` to it on few."""
    out = links.where("k = 0").select("s", "t", F.col("w").alias("dist"), F.array("s").alias("path_a"), F.array("t").alias("path_b"))
    for k in range(1, n_windows):
        a = edges_a.where(F.col("k") == k - 1).select("s", F.col("t").alias("s2"), F.col("w").alias("wa"))
        b = edges_b.where(F.col("k") == k - 1).select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("w").alias("wb"))
        link = links.where(F.col("k") == k).select(F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("w").alias("l"))
        out = out.join(a, "s").join(b, "t").join(link, ["s2", "t2"]).select(F.col("s2").alias("s"), F.col("t2").alias("t"), (F.col("dist") + F.col("wa") + F.col("wb") + F.col("l")).alias("dist"), F.concat("path_a", F.array("s2")).alias("path_a"), F.concat("path_b", F.array("t2")).alias("path_b"))
    return out.select("dist", "path_a", "path_b")


def best_path(paths: DataFrame, last: int) -> DataFrame:
    """The cheapest row of window ``last``."""
    cost = [c for c in ("dist", "path", "path_a", "path_b") if c in paths.columns]
    return paths.where(F.col("k") == last).agg(F.min(F.struct(*cost)).alias("m")).select("m.*")


def through_node(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """``k, s, dist``: the least cost of a whole path forced through each node."""
    f = forward.select("k", "s", F.col("dist").alias("__f"))
    return f.join(backward.select("k", "s", F.col("dist").alias("__b")), ["k", "s"]).select("k", "s", (F.col("__f") + F.col("__b")).alias("dist"))


def through_pair(forward: DataFrame, backward: DataFrame, links: DataFrame) -> DataFrame:
    """``k, s, t, dist`` for coupled paths; the link counts once."""
    f = forward.select("k", "s", "t", F.col("dist").alias("__f"))
    b = backward.select("k", "s", "t", F.col("dist").alias("__b"))
    return f.join(b, ["k", "s", "t"]).join(links, ["k", "s", "t"]).select("k", "s", "t", (F.col("__f") + F.col("__b") - F.col("w")).alias("dist"))


def nearest_label(edges: DataFrame, far: float = 1e8) -> DataFrame:
    """``k, s, t, w``: the cheapest next label of every node, if cheaper than ``far``."""
    return edges.where(F.col("w") < far).groupBy("k", "s").agg(F.min(F.struct("w", "t")).alias("m")).select("k", "s", "m.t", "m.w")


def good_labels(through: DataFrame, edges: DataFrame, best: float, factor: float = 2.0, least: float = 2.0, far: float = 1e8) -> DataFrame:
    """Background labels ``k, s``: nodes whose forced path costs less than ``max(factor * best, least)``,
    and the nearest labels of those in the windows beside them."""
    chosen = through.where(F.col("dist") < max(factor * best, least)).select("k", "s")
    ahead = nearest_label(edges, far).join(chosen, ["k", "s"], "left_semi").select((F.col("k") + 1).alias("k"), F.col("t").alias("s"))
    back = edges.where(F.col("w") < far).groupBy((F.col("k") + 1).alias("k"), F.col("t").alias("s")).agg(F.min(F.struct("w", F.col("s").alias("p"))).alias("m"))
    behind = back.join(chosen, ["k", "s"], "left_semi").select((F.col("k") - 1).alias("k"), F.col("m.p").alias("s"))
    return chosen.union(ahead).union(behind).distinct()


def path_cost(path: DataFrame, edges: DataFrame) -> DataFrame:
    """``cost`` of the path ``k, s`` along ``edges``; null if an edge is missing."""
    onward = path.select((F.col("k") - 1).alias("k"), F.col("s").alias("t"))
    walk = path.join(onward, "k").join(edges, ["k", "s", "t"], "left")
    return walk.agg(F.when(F.count("w") == F.count("*"), F.coalesce(F.sum("w"), F.lit(0.0))).alias("cost"))


def without_nodes(edges: DataFrame, ignored: DataFrame) -> DataFrame:
    """Edges that touch no ignored node ``k, s``."""
    ends = ignored.select((F.col("k") - 1).alias("k"), F.col("s").alias("t"))
    return edges.join(ignored, ["k", "s"], "left_anti").join(ends, ["k", "t"], "left_anti")


def set_edges(edges: DataFrame, changes: DataFrame, symmetric: bool = False) -> DataFrame:
    """``edges`` with the weights of ``changes`` (``k, s, t, w``), new edges added; ``symmetric`` sets both directions."""
    if symmetric:
        changes = changes.select("k", "s", "t", "w").unionByName(changes.select("k", F.col("t").alias("s"), F.col("s").alias("t"), "w"))
    return edges.select("k", "s", "t", "w").join(changes, ["k", "s", "t"], "left_anti").unionByName(changes.select("k", "s", "t", "w"))


def get_edges(edges: DataFrame, asked: DataFrame, far: float) -> DataFrame:
    """The weight of every asked edge ``k, s, t``; ``far`` where there is none."""
    return asked.join(edges.select("k", "s", "t", "w"), ["k", "s", "t"], "left").na.fill(far, ["w"])


def node_index(video, window, label, n_labels: int, n_windows: int):
    """0-based (video, window, label), numbers or columns, as a 1-based node number; back with
    :func:`node_parts` or :func:`node_columns`."""
    return (video * n_windows + window) * n_labels + label + 1


def node_parts(index: int, n_labels: int, n_windows: int) -> tuple[int, int, int]:
    window, label = divmod(index - 1, n_labels)
    return window // n_windows, window % n_windows, label


def node_columns(index: Column, n_labels: int, n_windows: int) -> tuple[Column, Column, Column]:
    """The 0-based video, window and label of a node number."""
    at = index - 1
    return F.floor(at / (n_labels * n_windows)), F.floor(at / n_labels) % n_windows, at % n_labels
