"""Labels by interval, guard bands, and how detections compare with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio

#: Steps in a bin of an interval join.
BIN = 512


def label(readings: DataFrame, episodes: DataFrame, on: list[str], step: str = "step", bin_steps: int = BIN) -> DataFrame:
    """readings with each episode (columns start, last beside those of on) that covers their step, or nulls.

    Episodes are put into all bins of steps that they touch and readings into theirs, so the join is
    an equi-join on keys and bin, with the bounds as a filter. A null last is an episode without end,
    up to the last step that its keys have.
    """
    ends = readings.groupBy(*on).agg(F.max(step).alias("__end"))
    bounded = episodes.join(ends, on).withColumn("last", F.coalesce("last", "__end")).drop("__end")
    low, high = F.floor(F.col("start") / bin_steps), F.floor(F.col("last") / bin_steps)
    binned = bounded.where("start <= last").withColumn("__bin", F.explode(F.sequence(low, high)))
    placed = readings.withColumn("__bin", F.floor(F.col(step) / bin_steps))
    # Names of their own, as episodes are often made from the readings themselves.
    theirs = binned.select(*[F.col(c).alias(f"__e_{c}") for c in binned.columns])
    inside = [F.col(k) == F.col(f"__e_{k}") for k in (*on, "__bin")] + [F.col(step).between(F.col("__e_start"), F.col("__e_last"))]
    extra = [F.col(f"__e_{c}").alias(c) for c in binned.columns if c not in (*on, "__bin")]
    return placed.join(theirs, inside, "left").select(*readings.columns, *extra)


def merge_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of both, which must not share any: the job fails, naming one that they share."""
    both = a.select(*keys, F.lit(1).alias("__side")).unionByName(b.select(*keys, F.lit(2).alias("__side")))
    met = both.groupBy(*keys).agg(F.min("__side").alias("__a"), F.max("__side").alias("__b"))
    named = F.concat(F.lit("in both: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    # A filter, so that the check stays in the plan whichever columns are read.
    return met.where(F.when(F.col("__a") == F.col("__b"), F.lit(True)).otherwise(F.raise_error(named).cast("boolean"))).select(*keys)


def guard_steps(episodes: DataFrame, guard: int, keys: list[str], last_step: str | None = None) -> DataFrame:
    """keys and step: all steps of the episodes and `guard` ones around each."""
    low, high = F.greatest(F.col("start") - guard, F.lit(0)), F.col("last") + guard
    if last_step:
        high = F.least(high, F.col(last_step))
    return episodes.select(*keys, F.explode(F.sequence(low, high)).alias("step")).distinct()


def confusion(scored: DataFrame, by: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """tp, fp, fn, tn, precision (1 without flags), recall (1 without positives), f1 and false-positive rate."""
    p, a = F.col(predicted), F.col(actual)
    counts = scored.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )
    precision = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0))
    recall = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumns(
        {
            "f1": F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
            "fpr": F.coalesce(ratio(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)),
        }
    )
