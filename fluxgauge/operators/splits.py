"""Temporal splits without leaks: in each class the first steps train, the next validate, the rest test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN, VALIDATION = 0.70, 0.15
#: Parts of a class's range, and parts of such a part.
WIDE = 4096


def _place(x: Column) -> Column:
    """A step (number, date or time) on a line."""
    return x.cast("double")


def ranked(steps: DataFrame, by: list[str], step: str) -> DataFrame:
    """Distinct steps (numbers, dates or times) with their rank from 0, `__r`, and their class's count, `__n`.

    No class is sorted whole in one task: its range is cut into WIDE parts and each of them into WIDE
    again. Steps are counted by part, counts are summed up over the parts (WIDE rows at most in a window),
    and rows are numbered inside their small part alone. The parts depend on the ends of a range only, so a
    task that runs again places its rows as before.
    """
    at, keys = F.col("__at"), [F.col(c) for c in by]
    line = steps.withColumn("__at", _place(F.col(step).cast("timestamp") if _is_time(steps, step) else F.col(step)))
    ends = line.groupBy(*keys).agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"), F.count("*").alias("__n"))
    scaled = F.coalesce(F.try_divide(at - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0)) * (WIDE * WIDE - 1)
    put = line.join(ends, by).withColumn("__part", F.floor(scaled)).withColumn("__p", F.floor(F.col("__part") / WIDE))
    fine = put.groupBy(*keys, "__p", "__part").agg(F.count("*").alias("__c"))
    coarse = fine.groupBy(*keys, "__p").agg(F.sum("__c").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(*keys, "__p", F.coalesce(F.sum("__c").over(before.partitionBy(*by)), F.lit(0)).alias("__far"))
    near = Window.partitionBy(*by, "__p").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("__near", F.coalesce(F.sum("__c").over(near), F.lit(0))).join(coarse, [*by, "__p"])
    fine = fine.select(*keys, "__part", (F.col("__far") + F.col("__near")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(step)) - 1
    return put.join(fine, [*by, "__part"]).select(*keys, step, (F.col("__before") + own).alias("__r"), "__n")


def _is_time(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")


def temporal_split(rows: DataFrame, by: list[str], step: str, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """rows with `split`: distinct steps are ranked in each class and cut at floor(n * share).

    Ranks are made over the distinct steps and joined back; see `ranked`. A row without a class or a step has no split.
    """
    ranks = ranked(rows.select(*by, step).dropna().distinct(), by, step)
    first = F.floor(F.col("__n") * F.lit(train))
    second = first + F.floor(F.col("__n") * F.lit(validation))
    named = ranks.withColumn(
        "split", F.when(F.col("__r") < first, "train").when(F.col("__r") < second, "validation").otherwise("test")
    )
    return rows.join(named.select(*by, step, "split"), [*by, step], "left")


def metrics(split: DataFrame, step: str) -> DataFrame:
    """Rows, share of all, first and last step of each split."""
    sums = split.groupBy("split").agg(F.count("*").alias("n_rows"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))
    return sums.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def gates(split: DataFrame, by: list[str], step: str, least: int = 1) -> DataFrame:
    """Of each split: rows, classes, and whether it has all classes and `least` rows of each."""
    each = split.groupBy("split", *by).agg(F.count("*").alias("__c"))
    every = split.select(*by).distinct().agg(F.count("*").alias("__all"))
    sums = each.groupBy("split").agg(F.sum("__c").alias("n_rows"), F.count("*").alias("n_classes"), F.min("__c").alias("__least"))
    full = (F.col("n_classes") == F.col("__all"), F.col("__least") >= least)
    return sums.join(F.broadcast(every)).select("split", "n_rows", "n_classes", full[0].alias("all_classes"), full[1].alias("enough"))  # one row


def order_holds(split: DataFrame, by: list[str], step: str) -> DataFrame:
    """For each class whether train ends before validation begins, and that before test."""

    def edge(f, name):
        return f(F.when(F.col("split") == name, F.col(step)))

    bounds = split.groupBy(*by).agg(
        edge(F.max, "train").alias("__a"), edge(F.min, "validation").alias("__b"), edge(F.max, "validation").alias("__c"), edge(F.min, "test").alias("__d")
    )
    ok = F.coalesce(F.col("__a") < F.col("__b"), F.lit(True)) & F.coalesce(F.col("__c") < F.col("__d"), F.lit(True))
    return bounds.select(*by, ok.alias("holds"))


def apportion(weights: DataFrame, total: int, order: list[str], weight: str = "weight") -> DataFrame:
    """weights (a bounded plan table) with `quota`: shares of total by largest remainders, ties by order."""
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy())
    parts = weights.withColumn("__x", exact).withColumn("__f", F.floor("__x"))
    left = F.lit(total) - F.sum("__f").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy((F.col("__x") - F.col("__f")).desc(), *order))
    quota = F.col("__f") + F.when(rank <= left, 1).otherwise(0)
    return parts.withColumn("quota", quota.cast("bigint")).drop("__x", "__f")
