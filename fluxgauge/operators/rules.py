"""Physical rules over one instant's magnitudes, and reports on them.

Each rule gives a margin: the signed distance to its limit, negative if it is broken, null if it
can't be evaluated (an input missing, off the grid, or a denominator that isn't positive).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import grid_value, ratio
from ..functions.windows import Series


@dataclass(frozen=True)
class Plant:
    """Limits and constants; property tables over uniform grids of temperature and pressure."""

    nominal_mw: float
    loops: int
    pump_max: float
    flux_factor: float
    cp: list[list[float]]
    t_sat: list[float]
    t0: float
    dt: float
    p0: float
    dp: float
    energy: float = 0.05
    heating: float = 10.0
    power_points: float = 4.5
    mass: float = 0.055
    steady: float = 0.02


def voted(readings: DataFrame, roles: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """keys, role, value: the median of a role's channels (roles: channel, role), nulls left out."""
    met = readings.join(roles, channel)
    return met.groupBy(*keys, "role").agg(F.median(value).alias("value"))


def single(roles: DataFrame, channel: str) -> DataFrame:
    """roles in which one channel stands alone for each of its roles, so that others can't outvote it."""
    mine = roles.where(F.col("channel") == channel).select("role")
    return roles.join(mine, "role", "left_anti").unionByName(roles.where(F.col("channel") == channel).select("role", *[c for c in roles.columns if c != "role"]))


def margins(rows: DataFrame, plant: Plant, s: Series, seconds: str) -> DataFrame:
    """rows (columns t_out, t_in, flow, flow_hot, flow_cold, p, flux, p_th) with a margin for each rule."""
    c = {n: F.col(n).cast("double") for n in ("t_out", "t_in", "flow", "flow_hot", "flow_cold", "p", "flux", "p_th")}
    t_avg = (c["t_out"] + c["t_in"]) / 2
    made = F.when(c["flux"] > 0, plant.nominal_mw * c["flux"] / 100)
    cp = grid_value(plant.cp, t_avg, c["p"], plant.t0, plant.dt, plant.p0, plant.dp)
    taken = plant.loops * c["flow"] * cp * (c["t_out"] - c["t_in"]) * 1e-6
    sat = grid_value([[v, v] for v in plant.t_sat], c["p"], F.lit(0.0), plant.p0, plant.dp, 0.0, 1.0)
    heating = F.abs(s.rate(c["t_out"], F.col(seconds)))
    drift = F.abs(s.rate(t_avg, F.col(seconds)))
    mean_flow = (c["flow_hot"] + c["flow_cold"]) / 2
    quiet = (drift < plant.steady) & (mean_flow > 0)
    found = {
        "energy_balance": plant.energy - ratio(F.abs(made - taken), made),
        "temperature_ordering": c["t_out"] - c["t_in"],
        "heating_rate": plant.heating - heating,
        "flow_range": F.when(c["flow"].isNotNull(), F.least(c["flow"], plant.pump_max / plant.loops - c["flow"])),
        "power_flux": plant.power_points - F.abs(c["p_th"] - plant.flux_factor * c["flux"]),
        "boiling": sat - c["t_out"],
        "mass_balance": F.when(quiet, plant.mass - ratio(F.abs(c["flow_hot"] - c["flow_cold"]), mean_flow)),
    }
    return rows.withColumns(found)


def heating_margins(channels: DataFrame, s: Series, value: str, seconds: str, limit: float, instant: list[str]) -> DataFrame:
    """instant and the margin of its fastest channel: one channel that heats or cools too fast breaks the rule.

    channels has a row for each channel and instant; s names a channel's rows. No channel with a rate, no margin.
    """
    rate = F.abs(s.rate(F.col(value).cast("double"), F.col(seconds)))
    return channels.withColumn("__m", limit - rate).groupBy(*instant).agg(F.min("__m").alias("heating_rate"))


def flow_margins(channels: DataFrame, value: str, pump_max: float, loops: int, instant: list[str]) -> DataFrame:
    """instant and the margin of the channel that is nearest to no flow or beyond its pump's."""
    flow = F.col(value).cast("double")
    margin = F.when(flow.isNotNull(), F.least(flow, pump_max / loops - flow))
    return channels.groupBy(*instant).agg(F.min(margin).alias("flow_range"))


RULES = ("energy_balance", "temperature_ordering", "heating_rate", "flow_range", "power_flux", "boiling", "mass_balance")


def report(rows: DataFrame, rules: Mapping[str, Column], by: list[str]) -> DataFrame:
    """by, rule, rows, evaluable ones, violations, and their rate (null if none is evaluable)."""
    every = F.array(*[F.struct(F.lit(n).alias("rule"), m.cast("double").alias("margin")) for n, m in rules.items()])
    long = rows.select(*by, F.explode(every).alias("r")).select(*by, "r.*")
    sums = long.groupBy(*by, "rule").agg(
        F.count("*").alias("n_rows"), F.count("margin").alias("n_evaluable"), F.count_if(F.col("margin") < 0).alias("n_violations")
    )
    return sums.withColumn("rate", ratio(F.col("n_violations"), F.col("n_evaluable")))


def margin_stats(rows: DataFrame, rules: Mapping[str, Column], by: list[str]) -> DataFrame:
    """by, rule, least and mean margin, population deviation, and the mean in deviations."""
    every = F.array(*[F.struct(F.lit(n).alias("rule"), m.cast("double").alias("margin")) for n, m in rules.items()])
    long = rows.select(*by, F.explode(every).alias("r")).select(*by, "r.*")
    sums = long.groupBy(*by, "rule").agg(
        F.min("margin").alias("least"), F.avg("margin").alias("mean"), F.stddev_pop("margin").alias("deviation")
    )
    return sums.withColumn("sigmas", ratio(F.col("mean"), F.col("deviation")))


def unexpected(found: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rules broken where (keys) they are not allowed to be."""
    return found.where("n_violations > 0").join(allowed, keys, "left_anti")
