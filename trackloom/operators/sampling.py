"""Subsets, natural order, caps and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.plans.ordered import running_sums


def subset(df: DataFrame, n: float, mode: str, pos: str = "pos", keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows (a share of them if 0 < n < 1) in their order of ``pos``:
    beginning, ending, uniform, largest or smallest by ``keys``, or random by a
    seeded hash.  A sampling operator: n is its feature.  Rows are picked by rank,
    so no task holds more than a slice even where n is large."""
    total = df.count()
    if n < 0 or (n != round(n) and n > 1):
        raise ValueError("n must be a natural number or a share between 0 and 1")
    n = min(total, int(n * total + 0.5) if n != round(n) else int(n))
    if mode == "uniform":
        if not n:
            return df.limit(0)
        ranked = running_sums(df, [F.col(pos)], {})
        step = (total - 1) / (n - 1) if n > 1 else 0
        # round half away from zero of the points 1, ..., total; a single point is the last
        near = lambda i: F.floor(F.lit(float(1 if n > 1 else total)) + i * F.lit(float(step)) + 0.5)
        i = F.round((F.col("rank") - (1 if n > 1 else total)) / step).cast("long") if step else F.lit(0)
        return ranked.where((near(i) == F.col("rank")) & (i >= 0) & (i < n)).drop("rank")
    order = {
        "beginning": [F.col(pos)], "ending": [F.col(pos)], "random": [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(pos).cast("string"))), F.col(pos)],
        "smallest": [*(F.col(k) for k in keys or []), F.col(pos)], "largest": [*(F.col(k) for k in keys or []), F.col(pos)],
    }[mode]
    ranked = running_sums(df, order, {})
    last = mode in ("ending", "largest")
    return ranked.where(F.col("rank") > total - n if last else F.col("rank") <= n).drop("rank")


def natural_key(text: Column) -> Column:
    """A key whose plain order is natural order: runs of digits padded to 20 places."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")


def cap_per_group(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def top_up(have: DataFrame, fresh: DataFrame, cell: list[str], quota: int, order: list[str], low: float = 0.7) -> DataFrame:
    """Fresh points for cells that hold fewer than ``low`` of their quota: as many as they lack."""
    held = have.groupBy(*cell).agg(F.count("*").alias("__held"))
    ranked = fresh.withColumn("__n", F.row_number().over(W.partitionBy(*cell).orderBy(*order))).join(held, cell, "left")
    votes = F.coalesce("__held", F.lit(0))
    return ranked.where((votes < low * quota) & (F.col("__n") <= quota - votes)).drop("__n", "__held")


def unique_index(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``idx``, the position of its value among the sorted distinct values, from 1."""
    ranked = running_sums(df.select(value).where(F.col(value).isNotNull()).distinct(), [F.col(value)], {})
    return df.join(ranked.select(value, F.col("rank").alias("idx")), value)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def members(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b``."""
    return a.join(b, on, "left_semi")


def distinct_labelings(df: DataFrame, group: str, pos: str, label: str) -> DataFrame:
    """``labels, groups``: the distinct labelings up to a renaming of labels (labels are
    numbered by first occurrence), and how many groups have each.  A labeling is
    one row's array and so bounded by its group."""
    ordered = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(pos, label))).alias("x")).withColumn("seq", F.col(f"x.{label}"))
    first = F.transform("seq", lambda v: F.array_position(F.array_distinct("seq"), v).cast("int"))
    return ordered.select(group, first.alias("labels")).groupBy("labels").agg(F.count("*").alias("groups"))
