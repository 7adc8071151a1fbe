"""Quantiles from counts in buckets of equal ratio: they add up over partitions, batches and windows, with a known error.

A bucket i holds values from gamma**(i - 1), excluded, to gamma**i, and says 2 * gamma**i / (gamma + 1) of them, which is
off by `error` of a value at most. Values of 0 and below have a bucket of their own, which says 0.
"""

from __future__ import annotations

import math
from collections import Counter, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bucket of values of 0 and below.
NONE = -(1 << 31)


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(x: Column, error: float) -> Column:
    """The number of a value's bucket; null without a value."""
    return F.when(x > 0, F.ceil(F.log(x) / F.lit(math.log(gamma(error))))).when(x <= 0, NONE).cast("bigint")


def said(i: Column, error: float) -> Column:
    """What a bucket says of its values."""
    g = gamma(error)
    return F.when(i == NONE, 0.0).otherwise(2 * F.pow(F.lit(g), i) / (g + 1))


def counts(rows: DataFrame, by: list[str], value: str, error: float) -> DataFrame:
    """by, bucket and n of the rows that have a value."""
    return rows.select(*by, bucket(F.col(value), error).alias("bucket")).where("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of several parts as one."""
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(counted: DataFrame, by: list[str], qs: dict[str, float], error: float) -> DataFrame:
    """by, n, and for each name of qs the value at that share, from counts (some hundred rows for each of by)."""
    all_of, so_far = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"__n": F.sum("n").over(all_of), "__c": F.sum("n").over(so_far)})
    picks = [F.min(F.when(F.col("__c") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("__n"))), F.col("bucket"))).alias(name) for name, q in qs.items()]
    found = placed.groupBy(*by).agg(F.sum("n").alias("n"), *picks)
    return found.select(*by, "n", *[said(F.col(name), error).alias(name) for name in qs])


class Sliding:
    """Counts of the last `window` values at least, a batch at a time; batches wholly before them go."""

    def __init__(self, error: float, window: int):
        self.error, self.window = error, window
        self.batches: deque[Counter] = deque()
        self.total: Counter = Counter()

    def add(self, counted: dict[int, int]) -> None:
        self.batches.append(Counter(counted))
        self.total.update(counted)
        while self.batches and self.total.total() - self.batches[0].total() >= self.window:
            self.total -= self.batches.popleft()

    def quantile(self, q: float) -> float | None:
        rest = max(1, math.ceil(q * self.total.total()))
        for i in sorted(self.total):
            rest -= self.total[i]
            if rest <= 0:
                return 0.0 if i == NONE else 2 * gamma(self.error) ** i / (gamma(self.error) + 1)
        return None
