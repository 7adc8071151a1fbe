"""Instrument faults put into readings, with their labels: stuck, offset, spike and ramp.

Episodes (sensor, kind, start, last, magnitude) meet readings in the binned interval join of
`labels.label`; a fault's value depends on its reading and, where it freezes, on its window's first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import labels

KINDS = {"freeze": "stuck", "offset": "bias_out_of_range", "spike": "noise_spike", "ramp": "sensor_drift"}


def inject(readings: DataFrame, episodes: DataFrame, sensor: str, step: str, value: str) -> DataFrame:
    """readings with the faults' values, `true_value` and `label` (null outside the episodes).

    freeze repeats the window's first value (its first step is no fault yet), offset adds the
    magnitude, spike adds it at the first step alone, ramp adds it for each step since the start.
    """
    met = labels.label(readings, episodes, [sensor], step)
    w = Window.partitionBy(sensor, "start").orderBy(step)
    first = F.first(value).over(w)
    since = F.col(step) - F.col("start")
    changed = (
        F.when(F.col("kind") == "freeze", first)
        .when(F.col("kind") == "offset", F.col(value) + F.col("magnitude"))
        .when((F.col("kind") == "spike") & (since == 0), F.col(value) + F.col("magnitude"))
        .when(F.col("kind") == "ramp", F.col(value) + F.col("magnitude") * since)
        .otherwise(F.col(value))
    )
    named = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KINDS.items()])
    at_once = ~((F.col("kind") == "freeze") & (since == 0)) & ~((F.col("kind") == "spike") & (since > 0))
    out = met.withColumns({"__new": changed, "label": F.when(at_once, named), "true_value": F.col(value)})
    return out.withColumn(value, F.col("__new")).select(*readings.columns, "true_value", "label")


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that seed and keys alone decide, so that it is the same wherever it is made."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def noisy(readings: DataFrame, keys: list[str], value: str, sigma: Column, seed: int) -> DataFrame:
    """readings with Gaussian noise of a sensor's sigma on their values; keys name a reading."""
    normal = F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))
    return readings.withColumn(value, F.col(value) + sigma * normal)


def intermittent(readings: DataFrame, episodes: DataFrame, sensor: str, step: str, value: str, seed: int) -> DataFrame:
    """readings in which episodes (sensor, start, last, direction, p_enter, p_exit, low, high) lose values, and `invalid`.

    A two-state chain for each episode: it starts lost, is found again with p_exit and lost again with
    p_enter a step (their sum is 1 at most). One number u a step drives it: u below p_enter loses the
    value, u of 1 - p_exit or more finds it, and others keep the state, so the state is that of the last step that set
    it, a window without a loop. A lost value is at a rail of the span: the first time that of the direction
    (above zero: high), then either by chance.
    """
    met = labels.label(readings, episodes, [sensor], step)
    w = Window.partitionBy(sensor, "start").orderBy(step)
    first = F.col(step) == F.col("start")
    u = uniform(seed, sensor, step)
    sets = F.when(first | (u < F.col("p_enter")), True).when(u >= 1 - F.col("p_exit"), False)
    state = F.when(F.col("start").isNotNull(), F.last(sets, ignorenulls=True).over(w))
    out = met.withColumn("__lost", F.coalesce(state, F.lit(False)))
    enters = F.col("__lost") & ~F.coalesce(F.lag("__lost").over(w), F.lit(False))
    chance = F.when(uniform(seed + 1, sensor, step) < 0.5, F.col("high")).otherwise(F.col("low"))
    rail = F.when(first, F.when(F.col("direction") > 0, F.col("high")).otherwise(F.col("low"))).otherwise(chance)
    held = F.last(F.when(enters, rail), ignorenulls=True).over(w)
    changed = out.withColumn("__new", F.when(F.col("__lost"), held).otherwise(F.col(value)))
    others = [F.col(c) for c in readings.columns if c != value]
    return changed.select(*others, F.col("__new").alias(value), F.col(value).alias("true_value"), F.col("__lost").alias("invalid"))
