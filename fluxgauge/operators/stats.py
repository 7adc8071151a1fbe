"""Descriptive statistics over many columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, missing, mean, std, low, high of each column, in one aggregation."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.struct(
                F.lit(c).alias("name"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"),
                F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
            ).alias(c)
        ]
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs of columns, pooled over all rows where both have values; null where one stands still."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def moments(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"))

    one = df.agg(F.array(*[moments(a, b) for a, b in pairs]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return one.unionByName(one.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "channel", value: str = "value") -> DataFrame:
    """Long form: a row for each column of each row."""
    return df.unpivot(ids, [F.col(c).cast("double").alias(c) for c in columns], name, value)


def wide(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Wide form with the columns given: the mean value of each name."""
    return df.groupBy(*ids).agg(*[F.avg(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])

