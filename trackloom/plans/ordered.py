"""Running totals over one global order, without one global task.

A window without PARTITION BY puts every row in a single task.  Here the order
is cut at edges taken from a bounded sample of sort keys, each slice is
windowed on its own, and the slices' totals, one row each, are prefix-summed
and broadcast back (at most ``MOST`` rows).  There is a slice for every
``SLICE`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE, LEAST, MOST = 200_000, 64, 8192


def sliced(df: DataFrame, keys: list[Column], slices: int | None = None) -> DataFrame:
    """``df`` with ``__k`` (the sort key, ascending) and ``__slice``.  The edges
    come from the keys of least hash, 64 for each slice but 65,536 at most, so they are the same
    every time; a row finds its slice by bisection."""
    if slices is None:
        slices = max(LEAST, min(MOST, -(-df.count() // SLICE)))
    df = df.withColumn("__k", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
    drawn = df.select("__k").orderBy(F.xxhash64("__k"), "__k").limit(min(64 * slices, 1 << 16)).collect()
    # nulls sort first, as they do in Spark
    ordered = sorted((r["__k"] for r in drawn), key=lambda k: tuple((v is not None, v if v is not None else 0) for v in k))
    edges = [ordered[i * len(ordered) // slices] for i in range(1, slices)] if ordered else []
    kind = df.schema["__k"].dataType.simpleString()
    literals = [F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(e))).cast(kind) for e in dict.fromkeys(map(tuple, edges))]
    if not literals:
        return df.withColumn("__slice", F.lit(0))
    table = F.array(*literals)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        below = F.when(acc["lo"] < acc["hi"], F.element_at(table, F.greatest(middle, F.lit(1))) <= F.col("__k")).otherwise(False)
        return F.struct(F.when(below, middle).otherwise(acc["lo"]).alias("lo"), F.when(below | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(middle - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(literals)).alias("hi"))
    return df.withColumn("__slice", F.aggregate(F.sequence(F.lit(1), F.lit(len(literals).bit_length())), start, halve, lambda acc: acc["lo"]))


def running_sums(df: DataFrame, keys: list[Column], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (1-based) and the inclusive running sum of each of ``sums``.

    ``keys`` should order the rows totally; equal keys are in no particular order.
    """
    parts = sliced(df.withColumns({f"__x_{n}": c for n, c in sums.items()}), keys, slices)
    local = W.partitionBy("__slice").orderBy("__k").rowsBetween(W.unboundedPreceding, 0)
    names = ["rank", *sums]
    ranked = parts.withColumns({"__rank": F.row_number().over(W.partitionBy("__slice").orderBy("__k")), **{f"__r_{n}": F.sum(f"__x_{n}").over(local) for n in sums}})
    totals = parts.groupBy("__slice").agg(F.count("*").alias("rank"), *(F.sum(f"__x_{n}").alias(n) for n in sums))
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each slice
    offsets = totals.select("__slice", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in names))
    joined = ranked.join(F.broadcast(offsets), "__slice")
    made = {"rank": (F.col("__rank") + F.col("__o_rank")).cast("long"), **{n: F.col(f"__r_{n}") + F.col(f"__o_{n}") for n in sums}}
    return joined.select(*(c for c in df.columns if c not in made), *(v.alias(n) for n, v in made.items()))


def running_max(df: DataFrame, keys: list[Column], value: Column, name: str, slices: int | None = None) -> DataFrame:
    """``df`` with the inclusive running maximum of ``value``."""
    parts = sliced(df.withColumn("__v", value), keys, slices)
    local = F.max("__v").over(W.partitionBy("__slice").orderBy("__k").rowsBetween(W.unboundedPreceding, 0))
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy("__slice").agg(F.max("__v").alias("m")).select("__slice", F.max("m").over(before).alias("__o"))
    joined = parts.withColumn("__l", local).join(F.broadcast(offsets), "__slice")
    return joined.select(*(c for c in df.columns if c != name), F.greatest("__l", "__o").alias(name))
