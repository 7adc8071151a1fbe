"""The feature table: 28 numbers of each reading, from its own sensor's past and its instant.

Readings are dealt once by run and sensor and sorted; one pass over the Arrow batches of a partition
makes everything that looks back, for all its series at once. The last readings of the series that a
batch cuts are carried over with its filter, so no series is gathered. The mean position of an instant
is a partial aggregate, joined before. Pairs of sensors are aligned by their instants first.

A missing reading (null, NaN, infinite or not usable) is a place without a value: windows count places,
cells need `least` values, a slope or a rate needs all of its window, crossings count every transition
of a window that lacks one, the filter does not move and gives nothing, and the run of equal values is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean, mean
from ..functions.windows import Series
from . import kalman

WINDOWS, LAGS, SLOPE, LEAST = (10, 20, 60), (1, 2, 3, 4, 5), 10, 3
_CONTEXT = ("hour_of_day", "day_of_week", "power_level_pct")


def feature_names() -> list[str]:
    windows = [f"{f}_{n}" for n in WINDOWS for f in ("mean", "std", "min", "max")]
    rest = ["rate_of_change", f"slope_{SLOPE}", "kalman_residual", "kalman_uncertainty", "variance_ratio"]
    rest += [f"zero_crossing_rate_{SLOPE}", "stuck_run_length", *_CONTEXT]
    return ["value", *windows, *[f"lag_{k}" for k in LAGS], *rest]


def _nothing(ok: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.where(ok, x, np.nan)


def look_back(x: np.ndarray, place: np.ndarray, interval: float, least: int = LEAST) -> dict[str, np.ndarray]:
    """Windows, lags and rates of readings x (NaN: missing), each at a place (from 0) of its series, series after series."""
    n = len(x)

    def lag(k: int) -> np.ndarray:
        out = np.full(n, np.nan)
        out[k:] = x[: n - k] if k < n else ()
        return _nothing(place >= k, out)

    lags = np.stack([lag(k) for k in range(max(WINDOWS))])
    there = ~np.isnan(lags)
    filled = np.where(there, lags, 0.0)
    out: dict[str, np.ndarray] = {}
    for w in WINDOWS:
        c = there[:w].sum(axis=0)
        low = np.where(there[:w], lags[:w], np.inf).min(axis=0)
        above = np.where(there[:w], lags[:w] - np.where(c > 0, low, 0.0), 0.0)  # equal values have no spread, whatever their sum rounds to
        square = np.where(there[:w], (above - above.sum(axis=0) / np.maximum(c, 1)) ** 2, 0.0).sum(axis=0)
        enough = c >= least
        out |= {
            f"mean_{w}": _nothing(enough, filled[:w].sum(axis=0) / np.maximum(c, 1)), f"std_{w}": _nothing(enough & (c > 1), np.sqrt(square / np.maximum(c - 1, 1))),
            f"min_{w}": _nothing(enough, low),
            f"max_{w}": _nothing(enough, np.where(there[:w], lags[:w], -np.inf).max(axis=0)),
        }
    out |= {f"lag_{k}": lags[k] for k in LAGS}
    out["rate_of_change"] = (x - lags[1]) / interval
    places = np.minimum(place + 1, SLOPE)  # of the window
    whole = there[:SLOPE].sum(axis=0) == places
    at = -np.arange(SLOPE, dtype=float)[:, None] + (places - 1) / 2  # places about their middle
    inside = np.arange(SLOPE)[:, None] < places
    spread = np.where(inside, at**2, 0.0).sum(axis=0)
    level = np.zeros(n)
    for k in range(SLOPE - 1, -1, -1):  # the oldest first, as a window's average is, so that the same values lie on it
        level += filled[k]
    level /= places
    slope = np.where(inside, at * (filled[:SLOPE] - level), 0.0).sum(axis=0) / np.where(spread > 0, spread, 1.0) / interval
    enough = there[:SLOPE].sum(axis=0) >= least
    out[f"slope_{SLOPE}"] = _nothing(enough & whole, slope)
    last, crossed, sides = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(SLOPE - 1, -1, -1):
        side = np.where(inside[k], np.sign(filled[k] - level), 0.0)
        crossed += (side != 0) & (last != 0) & (side != last)
        sides += side != 0
        last = np.where(side != 0, side, last)
    rate = np.where(sides > 1, crossed / np.maximum(sides - 1, 1), 0.0)
    out[f"zero_crossing_rate_{SLOPE}"] = _nothing(enough, np.where(whole, rate, 1.0))
    long = out[f"std_{WINDOWS[-1]}"]
    out["variance_ratio"] = out[f"std_{WINDOWS[0]}"] / np.where(long == 0, np.nan, long)
    return out


class _Pass:
    """Goes through a partition's sorted readings; what it carries is one series' last readings, run and filter."""

    def __init__(self, interval: float):
        self.interval = interval
        self.key: tuple | None = None
        self.tail = np.empty(0)  # the series' last readings
        self.places = 0  # of the series so far
        self.run = 0
        self.filter = kalman.Filter()

    def features(self, run: list, sensor: list, x: np.ndarray, seconds: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        # A series changes where its key does.
        keys = list(zip(run, sensor, strict=True))
        new = np.array([n > 0 and keys[0] != self.key, *(a != b for a, b in zip(keys, keys[1:], strict=False))][:n], bool)
        if new[0]:
            self.tail, self.places = np.empty(0), 0
        starts = np.flatnonzero(new)
        first = np.maximum.accumulate(np.where(new, np.arange(n), -self.places))
        place = np.arange(n) - first
        k = len(self.tail)
        both = np.concatenate((self.tail, x))
        held = np.concatenate((np.arange(self.places - k, self.places), place))
        out = {name: v[k:] for name, v in look_back(both, held, self.interval).items()}
        # Runs of equal values: positions since the last that differs.
        same = np.zeros(n, bool)
        if n:
            same[0] = k > 0 and not new[0] and x[0] == self.tail[-1]
            same[1:] = (x[1:] == x[:-1]) & ~new[1:]
        broke = np.maximum.accumulate(np.where(same, -self.run, np.arange(n)))
        out["stuck_run_length"] = (np.arange(n) - broke + 1).astype(float)
        residual, sigma = np.full(n, np.nan), np.full(n, np.nan)
        cut = set(starts.tolist())
        values, times = x.tolist(), seconds.tolist()
        for i in np.flatnonzero(~np.isnan(x) | new).tolist():
            if i in cut:
                self.filter = kalman.Filter()
            if values[i] == values[i]:
                r, s, _, _ = self.filter.step(values[i], times[i])
                residual[i], sigma[i] = r / s, s
        out |= {"kalman_residual": residual, "kalman_uncertainty": sigma}
        self.key, self.places, self.run = keys[-1], int(place[-1]) + 1, int(out["stuck_run_length"][-1])
        self.tail = both[max(0, len(both) - max(WINDOWS), len(both) - self.places) :]
        return out


def feature_table(
    readings: DataFrame, run: str, sensor: str, step: str, at: str, value: str, kind: str, interval: float,
    usable: Column | None = None, keep: tuple[str, ...] = (), pairs: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """run, step, sensor, the columns of keep, and the features, in long form.

    pairs adds cross_correlation_a__b of each pair of sensors, the same for all readings of an instant.
    """
    x = clean(F.col(value)) if usable is None else F.when(usable, clean(F.col(value)))
    moment = F.col(at).cast("timestamp")
    rows = readings.select(
        *[F.col(c) for c in dict.fromkeys((run, step, sensor, *keep))], x.alias("__x"), (F.unix_micros(moment) / 1e6).alias("__s"),
        F.hour(moment).cast("double").alias("hour_of_day"), F.weekday(moment).cast("double").alias("day_of_week"), F.col(kind).alias("__kind"),
    )
    power = rows.where("__kind = 'position'").groupBy(run, step).agg(mean(F.col("__x")).alias("power_level_pct"))
    rows = rows.drop("__kind").join(power, [run, step], "left")
    extra = []
    for a, b in pairs:
        name = f"cross_correlation_{a}__{b}"
        extra.append(name)
        found = instants(rows, run, sensor, step, a, b)
        found = found.select(run, step, Series((run,), (step,), LEAST).pair_correlation(F.col("__a"), F.col("__b"), SLOPE).alias(name))
        rows = rows.join(found, [run, step], "left")
    names = [*dict.fromkeys((run, step, sensor, *keep)), *feature_names(), *extra]
    made = set(feature_names()) - set(_CONTEXT)
    fields = [f"`{c}` {'double' if c in made else rows.schema[c].dataType.simpleString()}" for c in names]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Pass(interval)
        for batch in batches:
            if batch.num_rows:
                v = batch.column("__x").to_numpy(zero_copy_only=False).astype(float)
                s = batch.column("__s").to_numpy(zero_copy_only=False)
                got = state.features(batch.column(run).to_pylist(), batch.column(sensor).to_pylist(), v, s) | {"value": v}
                arrays = [pa.array(got[c], pa.float64(), from_pandas=True) if c in got else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.repartition(run, sensor).sortWithinPartitions(run, sensor, step).mapInArrow(look, ", ".join(fields))


def instants(rows: DataFrame, run: str, sensor: str, step: str, a: str, b: str) -> DataFrame:
    """run, step and the values __a, __b (column __x) of two sensors, of every instant that any sensor has."""
    mine = {c: F.max(F.when(F.col(sensor) == tag, F.col("__x"))).alias(c) for c, tag in (("__a", a), ("__b", b))}
    return rows.groupBy(run, step).agg(*mine.values())
