"""Where and how large injected faults are: seeded draws, permutations and episodes as relational operators.

Every draw is a number that the seed and a row's keys decide, so a placement is the same for any partitioning, and each part
can be made again alone. A digest of the text of seed and keys gives the number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import labels

#: Parts of the range of draws in which a permutation numbers its rows.
PARTS = 4096


def draw(seed: int, *keys: Column | str) -> Column:
    """A whole number from 0 to 2**60 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def within(number: Column, low: Column | int, high: Column | int) -> Column:
    """A draw as a whole number from low to high, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return low + F.pmod(number, high - low + 1)


def between(number: Column, low: float, high: float) -> Column:
    """A draw as a number of [low, high)."""
    return low + (high - low) * (F.shiftright(number, 8) / float(1 << 52))


def permuted(rows: DataFrame, by: list[str], keys: list[str], seed: int) -> DataFrame:
    """rows with `place`, from 0, in an order that only seed and keys decide; keys name a row in its class `by`.

    Draws are cut into PARTS: their counts are summed up (PARTS rows at most in a window) and rows numbered inside their
    part, so no class is sorted in one task.
    """
    drawn = rows.withColumn("__d", draw(seed, *keys)).withColumn("__part", F.shiftright("__d", 48).cast("int"))
    counts = drawn.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__d", *keys))
    met = drawn.withColumn("__own", own).join(before, [*by, "__part"])
    return met.select(*rows.columns, (F.col("__before") + F.col("__own") - 1).cast("bigint").alias("place"))


def needs(rows: DataFrame, ok: Column, message: Column) -> DataFrame:
    """rows; one of them that isn't ok fails the job with the message."""
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


@dataclass(frozen=True)
class Plan:
    """How much is injected. Sizes are in widths of the alarm envelope. Default values are fixed ones."""

    sensors_per_kind: int = 6
    episodes_per_sensor: int = 2
    lengths: Mapping[str, tuple[int, int]] = field(default_factory=lambda: {"freeze": (12, 40), "offset": (15, 40), "spike": (1, 1), "ramp": (25, 45)})
    offset_margin: float = 0.35
    spike: tuple[float, float] = (1.5, 4.0)
    ramp_per_hour: tuple[float, float] = (13.0, 17.0)
    guard: int = 3

    def __post_init__(self) -> None:
        if self.sensors_per_kind < 1 or self.episodes_per_sensor < 1 or self.guard < 0:
            raise ValueError("a plan needs sensors, episodes and no negative guard")
        if any(not 1 <= low <= high for low, high in self.lengths.values()):
            raise ValueError("lengths are from 1 on, the lesser first")


def targets(sensors: DataFrame, by: list[str], sensor: str, plan: Plan, seed: int) -> DataFrame:
    """by, sensor and kind: disjoint sets of sensors for the kinds, of equal size, from the sensors given (those with a span)."""
    kinds, needed = list(plan.lengths), plan.sensors_per_kind * len(plan.lengths)
    placed = permuted(sensors.select(*by, sensor).distinct(), by, [*by, sensor], seed)
    there = placed.groupBy(*by).agg(F.count("*").alias("__n"))
    message = F.concat(F.lit(f"{needed} sensors with a span are needed, there are "), F.col("__n").cast("string"))
    enough = needs(there, F.col("__n") >= needed, message)
    picked = placed.where(F.col("place") < needed)
    picked = picked.join(enough, by) if by else picked.crossJoin(F.broadcast(enough))  # one row
    return picked.select(*by, sensor, F.element_at(F.array(*map(F.lit, kinds)), (F.floor(F.col("place") / plan.sensors_per_kind) + 1).cast("int")).alias("kind"))


def episodes(sensors: DataFrame, by: list[str], sensor: str, steps: str, plan: Plan, seed: int) -> DataFrame:
    """by, sensor, kind, episode, start, last, direction: an episode in each equal segment of a target's timeline, guards free.

    sensors has a row for each sensor with a span, and its number of steps.
    """
    timeline = sensors.groupBy(*by, sensor).agg(F.min(steps).alias("__steps"))
    each = targets(sensors, by, sensor, plan, seed).join(timeline, [*by, sensor])
    each = each.withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(plan.episodes_per_sensor - 1))))
    drawn = [draw(seed + k, *by, sensor, "episode") for k in (1, 2, 3)]
    length = F.coalesce(*[F.when(F.col("kind") == kind, within(drawn[0], low, high)) for kind, (low, high) in plan.lengths.items()])
    segment = F.floor(F.col("__steps") / plan.episodes_per_sensor)
    sized = each.withColumns({"__length": length, "__low": F.col("episode") * segment + plan.guard})
    sized = sized.withColumn("__high", (F.col("episode") + 1) * segment - plan.guard - F.col("__length"))
    message = F.concat(F.lit("an episode of "), F.col("__length").cast("string"), F.lit(" steps doesn't fit its segment of "), segment.cast("string"))
    start = within(drawn[1], F.col("__low"), F.col("__high"))
    placed = needs(sized, F.col("__high") >= F.col("__low"), message).withColumn("start", start)
    direction = F.when(F.pmod(drawn[2], F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return placed.select(*by, sensor, "kind", "episode", "start", (F.col("start") + F.col("__length") - 1).alias("last"), direction.alias("direction"))


def sized(
    placed: DataFrame, readings: DataFrame, spans: DataFrame, by: list[str], sensor: str, step: str, value: str, interval: float, plan: Plan, seed: int
) -> DataFrame:
    """placed with `magnitude`, in units (for a ramp: a step), and `widths`, in envelopes (for a ramp: an hour).

    An offset takes the whole window out of the envelope, from its value that is worst for that. spans has alarm_low and alarm_high.
    """
    keys = [*by, sensor]
    inside = labels.label(readings.select(*keys, step, value), placed.where("kind = 'offset'").select(*keys, "start", "last"), keys, step).where("start IS NOT NULL")
    worst = inside.groupBy(*keys, "start").agg(F.min(value).alias("__min"), F.max(value).alias("__max"))
    met = placed.join(worst, [*keys, "start"], "left").join(spans.select(sensor, "alarm_low", "alarm_high"), sensor)
    width, up = F.col("alarm_high") - F.col("alarm_low"), F.col("direction")
    offset = F.when(up > 0, F.col("alarm_high") - F.col("__min") + plan.offset_margin * width).otherwise(F.col("alarm_low") - F.col("__max") - plan.offset_margin * width)
    number = draw(seed + 4, *keys, "episode")
    spike, hourly = up * between(number, *plan.spike), up * between(number, *plan.ramp_per_hour)
    kind = F.col("kind")
    magnitude = F.when(kind == "offset", offset).when(kind == "spike", spike * width).when(kind == "ramp", hourly * width * interval / 3600.0).otherwise(0.0)
    widths = F.when(kind == "offset", offset / width).when(kind == "spike", spike).when(kind == "ramp", hourly).otherwise(0.0)
    return met.select(*placed.columns, magnitude.alias("magnitude"), widths.alias("widths"))


def truth(placed: DataFrame, keys: list[str], last_step: str) -> DataFrame:
    """keys, step, fault_type: where the episodes must be found; last_step is the last step of a timeline.

    An episode and the step after it are an anomaly. A freeze is stuck from its second step, a ramp drifts, and every edge is
    a spike, but a freeze's and a ramp's first.
    """
    start, last, after, kind = F.col("start"), F.col("last"), F.col("last") + 1, F.col("kind")
    edges = F.when(kind.isin("offset", "spike"), F.array(start, after)).otherwise(F.array(after))
    no_steps = F.array().cast("array<bigint>")
    found = F.map_from_arrays(
        F.array(*map(F.lit, ("kalman_anomaly", "stuck", "sensor_drift", "noise_spike"))),
        F.array(
            F.sequence(start, after), F.when((kind == "freeze") & (last > start), F.sequence(start + 1, F.greatest(last, start + 1))).otherwise(no_steps),
            F.when(kind == "ramp", F.sequence(start, last)).otherwise(no_steps), edges,
        ),
    )
    rows = placed.select(*keys, F.col(last_step).alias("__last"), F.explode(found).alias("fault_type", "__steps"))
    each = rows.select(*keys, "fault_type", "__last", F.explode("__steps").alias("step"))
    return each.where((F.col("step") >= 0) & (F.col("step") <= F.col("__last"))).select(*keys, "step", "fault_type").distinct()
