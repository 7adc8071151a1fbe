"""Spans of sensors: derived from normal readings, and used to scale and judge values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import adc_counts

ALARM_PAD, SPAN_PAD = 0.2, 2.0


def derive(readings: DataFrame, sensor: str, value: str, alarm_pad: float = ALARM_PAD, span_pad: float = SPAN_PAD) -> DataFrame:
    """sensor, low, high, alarm_low, alarm_high: observed range, padded; a constant counts as 1 wide."""
    seen = readings.groupBy(sensor).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).where(F.col("__a").isNotNull())
    width = F.when(F.col("__b") > F.col("__a"), F.col("__b") - F.col("__a")).otherwise(1.0)
    pads = {"low": -span_pad, "alarm_low": -alarm_pad, "alarm_high": alarm_pad, "high": span_pad}
    ends = {n: F.round(F.col("__a" if p < 0 else "__b") + width * p, 6).alias(n) for n, p in pads.items()}
    return seen.select(sensor, ends["low"], ends["high"], ends["alarm_low"], ends["alarm_high"])


def attach(readings: DataFrame, spans: DataFrame, sensor: str) -> DataFrame:
    """readings with their spans; a sensor without one has nulls. Spans are a row for each sensor: the plan sizes the join."""
    return readings.join(spans, sensor, "left")


def uncovered(readings: DataFrame, spans: DataFrame, sensor: str) -> DataFrame:
    """Sensors without a span."""
    return readings.select(sensor).distinct().join(spans, sensor, "left_anti")


def counts(value: Column) -> Column:
    return adc_counts(value, F.col("low"), F.col("high"))


def in_span(value: Column) -> Column:
    return value.between(F.col("low"), F.col("high"))


def in_envelope(value: Column) -> Column:
    return value.between(F.col("alarm_low"), F.col("alarm_high"))
