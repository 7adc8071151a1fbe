"""Scalar functions as built-in expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities from least to worst.
SEVERITIES = ("low", "medium", "high", "critical")
ADC_TOP = 65535.0


def clean(x: Column) -> Column:
    """Null for NaN and infinities, which count as absent."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def to_number(x: Column) -> Column:
    """A number, or null where the text is none."""
    return clean(x.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean(x: Column) -> Column:
    """The mean of a group, the same in whatever order it is added up: what 14 decimal places hold is summed exactly, the rest as doubles."""
    exact = F.when(F.abs(x) < 1e14, x.cast("decimal(28,14)")).when(x.isNotNull(), F.lit(0).cast("decimal(28,14)"))
    return F.avg(exact).cast("double") + F.avg(x - exact.cast("double"))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def adc_counts(v: Column, low: Column, high: Column) -> Column:
    """16-bit converter count of a value in its span; null for no value or an empty span."""
    return F.floor(clamp(ratio((v - low) * ADC_TOP, high - low), 0.0, ADC_TOP)).cast("int")


def confidence(magnitude: Column, threshold: Column | float, saturation: float) -> Column:
    """0.5 at the threshold, 1 at `saturation` thresholds and beyond; 1 without a positive threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    excess = (ratio(magnitude, t) - 1.0) / max(saturation - 1.0, 1e-9)
    return F.when(t <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * F.greatest(excess, F.lit(0.0))))


def utc(df: DataFrame, column: str, naive: str = "reject") -> DataFrame:
    """df with the column as an instant. A time without a zone is an error, or taken as UTC if naive is 'utc'."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return df
    if kind != "timestamp_ntz":
        raise TypeError(f"{column} is no time")
    if naive != "utc":
        raise ValueError(f"{column} has no zone, so its instant is unknown")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return df.withColumn(column, F.timestamp_micros(micros))


def curve(xs: list[float], ys: list[float], x: Column) -> Column:
    """Linear interpolation on a rising curve of a few points (such as saturation pressure by temperature); null off it."""
    if len(xs) != len(ys) or any(a >= b for a, b in zip(xs, xs[1:], strict=False)):
        raise ValueError("a curve has as many values as places, which rise")
    pieces = [
        F.when((x >= a) & (x <= b), F.lit(float(u)) + (x - a) / (b - a) * (v - u))
        for a, b, u, v in zip(xs, xs[1:], ys, ys[1:], strict=False)
    ]
    return F.coalesce(*pieces)


def aliased_period(period: Column, interval: float) -> Column:
    """The period that an oscillation seems to have at a cadence; null if it seems to stand still or has no period."""
    if interval <= 0:
        raise ValueError("a cadence is above zero")
    turns = ratio(F.lit(float(interval)), period)  # for each sample
    folded = F.abs(turns - F.floor(turns + 0.5)) / interval
    return F.when((period > 0) & (folded >= 1e-12), 1.0 / folded)


def severity_rank(severity: Column) -> Column:
    """0 to 3, null for what is no severity."""
    return F.coalesce(*[F.when(severity == s, F.lit(k)) for k, s in enumerate(SEVERITIES)])


def uuid5(key: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(key, "UTF-8"))), 1, 32)
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def part_id(*keys: Column) -> Column:
    """Twelve hex digits that name a part by its content."""
    return F.substring(F.sha1(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 12)


def ramp(step: Column, start: Column, rise: Column, hold: Column) -> Column:
    """0 to 1 over `rise` steps from start, 1 for `hold`, back to 0 over `rise` steps."""
    x = (step - start).cast("double")
    down = ratio(2 * rise + hold - x, rise)
    return F.when(x < 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio(x, rise), F.lit(1.0)), F.coalesce(down, F.lit(1.0))))
    )


def grid_value(table: list[list[float]], x: Column, y: Column, x0: float, dx: float, y0: float, dy: float) -> Column:
    """Bilinear interpolation in a table over a uniform grid (rows along x); null off the grid."""
    nx, ny = len(table), len(table[0])
    flat = F.array(*[F.lit(float(v)) for row in table for v in row])
    fx, fy = (x - x0) / dx, (y - y0) / dy
    i = F.least(F.floor(fx), F.lit(nx - 2)).cast("int")
    j = F.least(F.floor(fy), F.lit(ny - 2)).cast("int")
    u, v = fx - i, fy - j

    def at(a: Column, b: Column) -> Column:
        return F.get(flat, a * ny + b)

    inside = (fx >= 0) & (fx <= nx - 1) & (fy >= 0) & (fy <= ny - 1)
    value = (
        at(i, j) * (1 - u) * (1 - v) + at(i + 1, j) * u * (1 - v) + at(i, j + 1) * (1 - u) * v + at(i + 1, j + 1) * u * v
    )
    return F.when(inside, value)
