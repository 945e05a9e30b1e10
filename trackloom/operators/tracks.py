"""Point trajectories: life spans, window membership, label co-membership, verdicts.

``points`` are ``track_id, frame, x, y`` (one row for each visible point);
``tracks`` are ``track_id, head, tail, len``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lifespans(points: DataFrame, keys: list[str] | None = None, max_age: int | None = None) -> DataFrame:
    """``track_id, head, tail, len`` of every track; with ``max_age`` a track retires at that length."""
    keys = keys or ["track_id"]
    spans = points.groupBy(*keys).agg(F.min("frame").alias("head"), F.max("frame").alias("tail"))
    if max_age is not None:
        spans = spans.withColumn("tail", F.least("tail", F.col("head") + max_age - 1))
    return spans.withColumn("len", F.col("tail") - F.col("head") + 1)


def trim(tracks: DataFrame, n_frames: int) -> DataFrame:
    """Tracks that begin within ``n_frames`` (1-based), cut off there."""
    tail = F.least("tail", F.lit(n_frames))
    return tracks.where(F.col("head") <= n_frames).withColumn("tail", tail).withColumn("len", F.col("tail") - F.col("head") + 1)


def alive(frame: Column, to_next: bool = True) -> Column:
    """Is a track alive at ``frame`` (and, for pairs of frames, at the next)?"""
    return (F.col("head") <= frame) & ((F.col("tail") > frame) if to_next else (F.col("tail") >= frame))


def window_members(tracks: DataFrame, size: int, n_frames: int) -> DataFrame:
    """``track_id, window``: tracks alive over the middle of a window and longer than half of it.

    A window w covers frames ``w * size / 2 + 1`` to ``w * size / 2 + size``, the last
    one cut off.  Each track makes its own windows from its ends, so no
    interval join is needed.
    """
    hop = size // 2
    n_windows = -(-n_frames // hop) - 1
    mid = lambda w: (w * hop + 1 + F.least(w * hop + size, F.lit(n_frames))) / 2
    span = F.sequence(F.greatest(F.floor((F.col("head") - size) / hop), F.lit(0)).cast("int"), F.greatest(F.least(F.floor(F.col("tail") / hop), F.lit(n_windows - 1)), F.lit(0)).cast("int"))
    fits = lambda w: (F.col("head") < mid(w)) & (F.col("tail") > mid(w)) & (w < n_windows)
    long_enough = tracks.where((F.col("len") > size / 2) & (F.col("head") <= n_frames))
    return long_enough.select("track_id", F.explode(F.filter(span, fits)).alias("window"))


def steps(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each point with its track's next point: ``x2, y2``; pairs of consecutive frames only."""
    w = W.partitionBy(*(keys or ["track_id"])).orderBy("frame")
    ahead = points.withColumn("__n", F.lead(F.struct("frame", "x", "y")).over(w))
    return ahead.where(F.col("__n.frame") == F.col("frame") + 1).select(*points.columns, F.col("__n.x").alias("x2"), F.col("__n.y").alias("y2"))


def co_membership(labels: DataFrame, least: int = 10, far: float = 1e8) -> DataFrame:
    """``window, u, v, n, pruned``: tracks with label u in a window and v in the next.
    Pairs with fewer than ``least`` tracks are pruned to the weight ``far``."""
    a = labels.select("track_id", "window", F.col("label").alias("u"))
    b = labels.select("track_id", (F.col("window") - 1).alias("window"), F.col("label").alias("v"))
    pairs = a.join(b, ["track_id", "window"]).groupBy("window", "u", "v").agg(F.count("*").alias("n"))
    return pairs.withColumn("pruned", F.when(F.col("n") < least, F.lit(far)))


def background_verdict(labels: DataFrame, good: DataFrame, share: float = 0.7) -> DataFrame:
    """``track_id, seen, good, verdict``: 1 (background) if a track's windows with a good
    label reach ``ceil(share * seen)``, else -1; unlabelled tracks are 0."""
    marked = labels.where("label != 0").join(good.select("window", "label").distinct().withColumn("__g", F.lit(1)), ["window", "label"], "left")
    counted = marked.groupBy("track_id").agg(F.count_distinct("window").alias("seen"), F.count_distinct(F.when(F.col("__g") == 1, F.col("window"))).alias("good"))
    every = labels.select("track_id").distinct().join(counted, "track_id", "left").na.fill(0, ["seen", "good"])
    return every.withColumn("verdict", F.when(F.col("seen") == 0, 0).when(F.col("good") >= F.ceil(F.col("seen") * share), 1).otherwise(-1))


def relabel_small_groups(df: DataFrame, group: list[str], label: str, most: int = 4) -> DataFrame:
    """Labels of groups with at most ``most`` members become one more label than there are large groups."""
    counted = df.groupBy(*group, label).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*group).orderBy(label)
    big = counted.where(F.col("__n") > most).withColumn("__new", F.dense_rank().over(w))
    outlier = big.groupBy(*group).agg(F.max("__new").alias("__k"))
    joined = df.join(big.drop("__n"), [*group, label], "left").join(outlier, group, "left")
    return joined.withColumn("new_label", F.coalesce("__new", F.coalesce("__k", F.lit(0)) + 1)).drop("__new", "__k")


def in_frame(x: Column, y: Column, width: float, height: float, low: float = 0.0, high: float = 0.0, closed: bool = False) -> Column:
    """Inside an image: ``low < x < width - high``, or ``<=`` above if ``closed``."""
    top = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
    return (x > low) & top(x, F.lit(width - high)) & (y > low) & top(y, F.lit(height - high))


def drop_repeats(df: DataFrame, group: list[str], order: str, near: float = 0.1, signed: bool = False) -> DataFrame:
    """Drop a point whose successor is within ``near`` in x and y.

    ``signed`` compares signed differences, so that any point followed by one
    with larger coordinates goes; it is the observed, not the documented,
    behaviour of the original operator.
    """
    w = W.partitionBy(*group).orderBy(order)
    dx, dy = F.col("x") - F.lead("x").over(w), F.col("y") - F.lead("y").over(w)
    size = (lambda c: c) if signed else F.abs
    return df.withColumn("__d", F.coalesce((size(dx) < near) & (size(dy) < near), F.lit(False))).where(~F.col("__d")).drop("__d")


def robust_filter(df: DataFrame, group: list[str], distance: str, order: str, least: int = 20) -> DataFrame:
    """Rows within twice the trimmed mean distance of their group plus 10; groups left with
    fewer than ``least`` rows are emptied.  The mean runs over the ranks from 2/5 to 16/20."""
    w = W.partitionBy(*group).orderBy(distance, order)
    n = F.count("*").over(W.partitionBy(*group))
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("__n", n)
    middle = (F.col("__r") >= F.greatest(F.floor(F.col("__n") * 2 / 5), F.lit(1))) & (F.col("__r") <= F.floor(F.col("__n") * 16 / 20))
    limit = ranked.groupBy(*group).agg((2 * F.avg(F.when(middle, F.col(distance))) + 10).alias("threshold"))
    kept = df.join(limit, group).where(F.col(distance) <= F.col("threshold"))
    enough = kept.groupBy(*group).agg(F.count("*").alias("__c")).where(F.col("__c") >= least).drop("__c")
    return kept.join(enough, group, "left_semi")


def label_affinity(points: DataFrame, masks: DataFrame, size: int, beta: float) -> DataFrame:
    """``window, u, v, w``: exp(-beta * sum of both masks' products over control points / size).

    ``masks`` has a side's value at each control point: ``window, frame, k, side, label, m``.
    """
    a = masks.where("side = 'a'").select("window", "frame", "k", F.col("label").alias("u"), F.col("m").alias("__a"))
    b = masks.where("side = 'b'").select("window", "frame", "k", F.col("label").alias("v"), F.col("m").alias("__b"))
    both = points.join(a, ["window", "frame", "k"]).join(b, ["window", "frame", "k"])
    return both.groupBy("window", "u", "v").agg(F.exp(-beta * F.sum(F.col("__a") * F.col("__b")) / size).alias("w"))
