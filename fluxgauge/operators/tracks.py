"""One pass over series of readings: what the detectors of a single sensor need, in batch and on a stream.

`by_series` deals rows by their keys, sorts them in their partitions and goes through the Arrow batches once; what it
carries from batch to batch is one series' state, so no series is gathered. A `Track` is that state for the
detectors: the last value, its time, the run of equal values and the filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import astuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .kalman import Filter

#: What a track says of a reading; all null for one without a value, but for the steps so far.
NUMBERS = (
    "run bigint, elapsed double, delta double, residual double, sigma double, predicted double, velocity double, "
    "anomaly boolean, kept boolean, steps bigint"
)
STATE = (
    "last double, last_at double, run bigint, q double, r double, x double, v double, pxx double, pxv double, pvv double, k_at double, steps bigint"
)
_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

Follow = Callable[..., list[tuple]]


def by_series(readings: DataFrame, keys: list[str], order: list[str], inputs: list[str], new: str, begin: Callable[[], Follow]) -> DataFrame:
    """readings with the columns new. begin() makes the function of a series, which takes the lists of inputs' values and gives a tuple for each row."""
    names, kinds = zip(*(c.split(" ") for c in new.split(", ")), strict=True)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema] + [new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        follow: Follow | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            columns = [batch.column(c).to_pylist() for c in inputs]
            starts = [i for i in range(len(at)) if at[i] != (at[i - 1] if i else key)]
            found: list[tuple] = []
            for a, z in zip([0, *(s for s in starts if s)], [*(s for s in starts if s), len(at)], strict=True):
                if follow is None or at[a] != key:
                    key, follow = at[a], begin()
                found += follow(*(c[a:z] for c in columns))
            arrays = [pa.array(c, _KINDS[k]) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    return readings.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Track:
    """A series so far. Readings without a value leave it as it was."""

    def __init__(self, state: tuple | None = None):
        self.last, self.last_at, self.run, *rest = state or (None, None, 0)
        self.filter = Filter(rest[0], rest[1], *rest[2:]) if rest else Filter()

    def state(self) -> tuple:
        f = astuple(self.filter)
        return self.last, self.last_at, self.run, *f

    def follow(self, at: list[float], x: list[float | None], near: list[float]) -> list[tuple]:
        """NUMBERS of each reading; values within `near` of the last one are the same."""
        out = []
        f, last, last_at, run = self.filter, self.last, self.last_at, self.run
        for t, v, tolerance in zip(at, x, near, strict=True):
            if v is None or not math.isfinite(v):
                out.append((None,) * 9 + (f.steps,))
                continue
            delta = elapsed = None
            if last is None:
                run = 1
            else:
                delta, elapsed = v - last, t - last_at
                run = run + 1 if abs(delta) <= tolerance else 1
            residual, sigma, anomaly, kept = f.step(v, t)
            out.append((run, elapsed, delta, residual, sigma, v - residual, f.v, anomaly, kept, f.steps))
            last, last_at = v, t
        self.last, self.last_at, self.run = last, last_at, run
        return out


def tracked(readings: DataFrame, keys: list[str], order: list[str], seconds: str, value: str, near: str) -> DataFrame:
    """readings with NUMBERS; near is the column of tolerances."""
    return by_series(readings, keys, order, [seconds, value, near], NUMBERS, lambda: Track().follow)
