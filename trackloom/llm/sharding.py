"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form one group.  Groups sorted by size, largest first,
each enter the bin with the tightest remaining capacity that still holds
them, found in a balanced tree.

Only a histogram reaches the driver: group sizes are rounded up to 1024
steps an octave, which gives at most ``CLASS_BOUND`` size classes whatever
the corpus.  Groups of one class are interchangeable, so the packing places
them as runs, and a group finds its run by its rank within its class.  Ranks
and slots come from salted prefix sums, so no class and no shard meets in one
task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

#: Sizes below 2**11 are exact; above, 1024 steps for each of at most 52 octaves.
CLASS_BOUND = 2048 + 1024 * 52


class CapacityTree:
    """A treap of (remaining capacity, bin), ordered; O(log n) for each call.

    Priorities come from mixing the bin number, so runs are reproducible.
    """

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        x = (key[1] * 0x9E3779B97F4A7C15 + key[0] * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._merge(a[3], b))
        return (b[0], b[1], self._merge(a, b[2]), b[3])

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, (key, self._priority(key), None, None)), high)

    def remove(self, remaining: int, bin_: int) -> None:
        low, rest = self._split(self.root, (remaining, bin_))
        _, high = self._split(rest, (remaining, bin_ + 1))
        self.root = self._merge(low, high)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity of at least ``need``."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= (need, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs ``(size, first rank, last rank + 1, bin)`` for ``(size, count)`` classes.

    A group larger than the capacity has a bin of its own.  None if more than
    ``most`` bins would be needed.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.tightest(size)
            if found is None:
                if bins == most:
                    return None
                remaining, bin_ = capacity, bins
                bins += 1
            else:
                remaining, bin_ = found
                tree.remove(remaining, bin_)
            # the tightest bin stays the tightest until it is too full
            n = min(count - rank, max(1, remaining // size))
            runs.append((size, rank, rank + n, bin_))
            rank += n
            if remaining - n * size > 0:
                tree.add(remaining - n * size, bin_)
    return runs


def pack_evenly(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing at the least capacity found that needs ``bins`` bins at most."""
    if not classes:
        return []
    total, largest = sum(s * n for s, n in classes), max(s for s, _ in classes)
    low = max(-(-total // bins), largest)
    high, runs = low, best_fit_decreasing(classes, low, bins)
    step = max(1, low // 4096)
    while runs is None:
        low, high, step = high + 1, high + step, step * 2
        runs = best_fit_decreasing(classes, high, bins)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(classes, mid, bins)
        if got is None:
            low = mid + 1
        else:
            high, runs = mid, got
    return runs


#: ``gsize`` rounded up to 1024 steps an octave.
_STEP = "shiftleft(1L, greatest(length(bin(gsize)) - 11, 0))"
_CLASS = f"(gsize + {_STEP} - 1) div {_STEP} * {_STEP}"


#: Rows that one task ranks, about.
RANKED = 200_000


def _parts(n: int) -> int:
    return max(64, -(-n // RANKED))


def shard_groups(groups: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """``key, shard`` for ``key, gsize`` (unique keys): either ``shards`` shards
    of near equal size, or the least shards found of a fixed ``capacity``."""
    spark = groups.sparkSession
    salts = _parts(groups.count())
    classed = groups.withColumn("class", F.expr(_CLASS)).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    counts = classed.groupBy("class", "salt").agg(F.count("*").alias("n"))
    histogram = [(r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()]
    if len(histogram) > CLASS_BOUND:
        raise ValueError("more size classes than rounding allows")
    runs = pack_evenly(histogram, shards) if capacity is None else best_fit_decreasing(histogram, capacity)
    runs_df = spark.createDataFrame(runs, "class long, lo long, hi long, shard int")
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("class", "salt", "before")
    ranked = classed.withColumn("rn", F.row_number().over(W.partitionBy("class", "salt").orderBy("key")) - 1).join(before, ["class", "salt"])
    # at most CLASS_BOUND + one row a bin
    return ranked.join(F.broadcast(runs_df), (ranked["class"] == runs_df["class"]) & (F.col("before") + F.col("rn") >= F.col("lo")) & (F.col("before") + F.col("rn") < F.col("hi"))).select("key", "shard")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """Every row's shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Defined cases: a null text has no bytes (size 1, crc32 of nothing) and
    groups with the empty text; repeated rows stay together and have slots of
    their own; a null id is allowed; a group larger than a shard fills one;
    an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = materialize(rows, "shard-rows")
    buckets = _parts(rows.count() // max(1, shards or 1))
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("gsize")), "shard-groups")
    placed = rows.join(shard_groups(groups, shards, capacity), "key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    placed = materialize(placed, "shard-placed")
    before = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rn = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "key")) - 1
    return (
        placed.withColumn("rn", rn)
        .join(before.select("shard", "bucket", "before"), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)
