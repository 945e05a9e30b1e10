"""Distances and kernels between two array columns, as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, t: s + t)


def _xlog(x: Column, over: Column) -> Column:
    """x * log2(x / over), 0 at 0."""
    return F.when((x > 0) & (over > 0), x * F.log2(x / over)).otherwise(0.0)


def _ratio(top: Column, bottom: Column) -> Column:
    """Terms with a zero denominator count nothing."""
    return F.when(bottom == 0, 0.0).otherwise(top / F.when(bottom == 0, 1.0).otherwise(bottom))


#: Distances: 0 between equal vectors.  L2 and the others are not rooted.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "l2": lambda a, b: _sum(a, b, lambda x, y: (x - y) * (x - y)),
    "l1": lambda a, b: _sum(a, b, lambda x, y: F.abs(x - y)),
    "l0": lambda a, b: _sum(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)),
    "linf": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))),
    "chi2": lambda a, b: _sum(a, b, lambda x, y: _ratio((x - y) * (x - y), x + y)),
    "hell": lambda a, b: _sum(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))),
    "js": lambda a, b: _sum(a, b, lambda x, y: _xlog(x, (x + y) / 2) + _xlog(y, (x + y) / 2)),
}

#: Kernels: with each, D(a, b) = K(a, a) + K(b, b) - 2 K(a, b) for its distance.
KERNELS: dict[str, Callable[[Column, Column], Column]] = {
    "kl2": lambda a, b: _sum(a, b, lambda x, y: x * y),
    "kl1": lambda a, b: _sum(a, b, F.least),
    "kchi2": lambda a, b: _sum(a, b, lambda x, y: _ratio(2 * x * y, x + y)),
    "khell": lambda a, b: _sum(a, b, lambda x, y: F.sqrt(x * y)),
    "kjs": lambda a, b: _sum(a, b, lambda x, y: 0.5 * (F.when((x > 0) & (x + y > 0), x * F.log2((x + y) / x)).otherwise(0.0) + F.when((y > 0) & (x + y > 0), y * F.log2((x + y) / y)).otherwise(0.0))),
    "min": lambda a, b: _sum(a, b, F.least),
}


def pair_value(name: str, a: Column, b: Column) -> Column:
    """The named distance or kernel; null where either vector is null."""
    return (DISTANCES | KERNELS)[name](a, b)
