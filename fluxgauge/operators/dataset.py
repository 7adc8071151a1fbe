"""Labelled data sets: what went wrong with the plant and with its instruments, and what a data set holds.

Every reading has two axes. A fault of the process labels all of a run's sensors, a fault of an instrument that sensor's
readings alone; both are intervals of steps and meet readings in the binned interval join of `labels.label`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SEVERITIES
from . import labels

NO_FAULT = "none"
AXES = ("process", "instrument")
#: What a reading takes over from its episode.
PARTS = ("fault", "level", "start", "last", "id", "began")
#: The axis and the severity of each scenario; a normal run has neither.
SCENARIOS = {
    "normal": (None, None),
    "drift": ("instrument", "high"),
    "stuck": ("instrument", "critical"),
    "noise_spike": ("instrument", "low"),
    "bias": ("instrument", "high"),
    "intermittent": ("instrument", "medium"),
    "core_temp_excursion": ("process", "critical"),
    "coolant_flow_reduction": ("process", "high"),
    "void_formation": ("process", "critical"),
}


@dataclass(frozen=True)
class Columns:
    """Names of a reading's columns."""

    run: str = "run_id"
    sensor: str = "sensor_id"
    step: str = "timestep"
    at: str = "timestamp"
    value: str = "value"
    true_value: str = "true_value"


def _table(scenarios: Mapping[str, tuple[str | None, str | None]], place: int) -> Column:
    known = [x for name, told in scenarios.items() if told[place] for x in (F.lit(name), F.lit(told[place]))]
    return F.create_map(*known)


def axis_of(scenario: Column, scenarios: Mapping[str, tuple[str | None, str | None]] = SCENARIOS) -> Column:
    """process or instrument; null for a scenario that has no fault."""
    return _table(scenarios, 0)[scenario]


def severity_of(scenario: Column, scenarios: Mapping[str, tuple[str | None, str | None]] = SCENARIOS) -> Column:
    """The severity of a scenario's fault; null for a scenario that has none."""
    return _table(scenarios, 1)[scenario]


def apart(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """episodes, whose intervals must not overlap within their keys: the job fails, naming the first that does."""
    w = Window.partitionBy(*keys).orderBy("start", "last")
    # A null last is an episode without end.
    so_far = F.max(F.coalesce(F.col("last"), F.lit((1 << 63) - 1))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    named = F.concat(F.lit("overlapping episodes: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in (*keys, "start")]))
    marked = episodes.withColumn("__ok", F.coalesce(F.col("start") > so_far, F.lit(True)))
    return marked.where(F.when(F.col("__ok"), F.lit(True)).otherwise(F.raise_error(named).cast("boolean"))).drop("__ok")


def assemble(readings: DataFrame, episodes: DataFrame, c: Columns = Columns(), scenarios: Mapping[str, tuple[str | None, str | None]] = SCENARIOS) -> DataFrame:
    """readings with both axes' labels.

    episodes have the run, fault (a scenario), sensor (null for a process fault), level, start and last (steps, null: to the
    run's end). New columns: process_fault, process_severity, instrument_fault, instrument_severity (none and null without a
    fault), injected_at and injected_at_step (the first reading's time and step of the episode; of the instrument's where both are),
    episode_id, fault_level, corrupted (an instrument's fault changed the value), labelled.
    """
    found = readings
    for axis in AXES:
        keys = [c.run] if axis == "process" else [c.run, c.sensor]
        mine = episodes.where(axis_of(F.col("fault"), scenarios) == axis)
        mine = apart(mine.select(*keys, "fault", "level", "start", "last"), keys)
        named = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "fault", F.col("start").cast("string"))
        firsts = readings.groupBy(*keys, F.col(c.step).alias("start")).agg(F.min(c.at).alias("began"))
        mine = mine.withColumn("id", named).join(firsts, [*keys, "start"], "left")
        met = labels.label(found, mine, keys, c.step)
        renamed = {x: f"__{axis}_{x}" for x in PARTS}
        found = met.withColumnsRenamed(renamed)
    faults = {f"{axis}_fault": F.coalesce(F.col(f"__{axis}_fault"), F.lit(NO_FAULT)) for axis in AXES}
    severities = {f"{axis}_severity": severity_of(F.col(f"__{axis}_fault"), scenarios) for axis in AXES}
    parts = {"episode_id": "id", "fault_level": "level", "injected_at_step": "start", "injected_at": "began"}
    either = {name: F.coalesce(F.col(f"__instrument_{x}"), F.col(f"__process_{x}")) for name, x in parts.items()}
    changed = F.col("__instrument_fault").isNotNull() & ~F.col(c.value).eqNullSafe(F.col(c.true_value))
    out = found.withColumns(faults | severities | either | {"corrupted": changed}).withColumn("labelled", labelled())
    return out.drop(*[f"__{axis}_{x}" for axis in AXES for x in PARTS])


def labelled(process: str = "process_fault", instrument: str = "instrument_fault") -> Column:
    """Whether a row has a label on either axis."""
    return (F.coalesce(F.col(process), F.lit(NO_FAULT)) != NO_FAULT) | (F.coalesce(F.col(instrument), F.lit(NO_FAULT)) != NO_FAULT)


def by_scenario(assembled: DataFrame, scenario: str = "scenario", run: str = "run_id") -> DataFrame:
    """scenario, runs, readings, labelled, corrupted, episodes: for each scenario, and for all (scenario null)."""
    return assembled.rollup(scenario).agg(
        F.countDistinct(run).alias("runs"), F.count("*").alias("readings"), F.count_if("labelled").alias("labelled"),
        F.count_if("corrupted").alias("corrupted"), F.countDistinct("episode_id").alias("episodes"),
    )


def by_severity(assembled: DataFrame) -> DataFrame:
    """severity, readings, fraction of all readings, labelled or not: a row for each severity there is, also where it has none."""
    told = F.coalesce("instrument_severity", "process_severity")
    counts = assembled.agg(F.count("*").alias("__n"), *[F.count_if(told == s).alias(s) for s in SEVERITIES])
    each = counts.select("__n", F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("readings")) for s in SEVERITIES])).alias("x"))
    return each.select("x.severity", "x.readings", F.coalesce(F.try_divide(F.col("x.readings"), F.col("__n")), F.lit(0.0)).alias("fraction"))


def rule_matrix(broken: DataFrame, scenario: str, rule: str, rules: list[str]) -> DataFrame:
    """A row for each scenario, and in the columns of rules how often it breaks them; broken has a row for each break."""
    return broken.groupBy(scenario).agg(*[F.count_if(F.col(rule) == name).alias(name) for name in rules])
