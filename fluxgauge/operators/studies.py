"""Aggregates that judge labelled runs: windows, detections, responses, throughput, conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .labels import label


def window_cells(rows: DataFrame, episodes: DataFrame, on: list[str], margin: str, step: str = "step") -> DataFrame:
    """on, start, last: rows in the window, those with a margin, violations (margin below 0), and steps to the first."""
    met = label(rows, episodes, on, step).where("start IS NOT NULL")
    bad = F.col(margin) < 0
    return met.groupBy(*on, "start", "last").agg(
        F.count("*").alias("n_window"),
        F.count(margin).alias("n_evaluable"),
        F.count_if(bad).alias("n_violations"),
        (F.min(F.when(bad, F.col(step))) - F.col("start")).alias("first_delay"),
    )


def detections(rows: DataFrame, episodes: DataFrame, on: list[str], flagged: str, by: list[str], step: str = "step") -> DataFrame:
    """by: episodes, detected ones, mean delay, and flags outside the episodes per 1000 rows outside."""
    met = label(rows, episodes, on, step)
    inside = F.col("start").isNotNull()
    hits = met.where(inside & F.col(flagged)).groupBy(*on, "start").agg(F.min(F.col(step) - F.col("start")).alias("delay"))
    kinds = episodes.join(hits, [*on, "start"], "left").groupBy(*by).agg(
        F.count("*").alias("n_episodes"), F.count("delay").alias("n_detected"), F.avg("delay").alias("mean_delay")
    )
    outside = met.where(~inside).groupBy(*by).agg(ratio(1000 * F.count_if(F.col(flagged)), F.count("*")).alias("false_per_1000"))
    return kinds.join(outside, by, "left")


def run_summary(rows: DataFrame, run: list[str], **counts: Column) -> DataFrame:
    """run: rows, and of each named condition how many rows hold it."""
    return rows.groupBy(*run).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def extremes(rows: DataFrame, by: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """by, magnitude, low, high, and whether the peak lies in the magnitude's target band."""
    every = F.array(
        *[F.struct(F.lit(n).alias("magnitude"), F.col(n).cast("double").alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in bands.items()]
    )
    long = rows.select(*by, F.explode(every).alias("m")).select(*by, "m.*")
    peak = F.max("x")
    return long.groupBy(*by, "magnitude").agg(
        F.min("x").alias("low"), peak.alias("high"), F.coalesce(peak.between(F.first("a"), F.first("b")), F.lit(False)).alias("on_target")
    )


def spread_over_runs(rows: DataFrame, by: list[str], run: str, bad: Column) -> DataFrame:
    """by: the least and the most violations of a run, and the runs."""
    each = rows.groupBy(*by, run).agg(F.count_if(bad).alias("n"))
    return each.groupBy(*by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("n_runs"))


def throughput(rows: DataFrame, at: str, length: str, seconds: int) -> DataFrame:
    """window_start, rows, and rows a second."""
    out = rows.groupBy(F.window(F.col(at).cast("timestamp"), length)).agg(F.count("*").alias("n_rows"))
    return out.select(F.col("window.start").alias("window_start"), "n_rows", (F.col("n_rows") / seconds).alias("per_second"))


def conservation(rows: DataFrame, by: list[str], residual: Column, limit: float) -> DataFrame:
    """by: the worst residual and how many exceed the limit."""
    size = F.abs(residual)
    return rows.groupBy(*by).agg(F.max(size).alias("worst"), F.count_if(size > limit).alias("n_failures"))
