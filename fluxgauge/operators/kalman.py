"""Constant-velocity Kalman filter of each sensor, one implementation for batch and stream.

Readings are dealt by their keys and sorted in their partitions; a pass over each partition carries
one filter's state from batch to batch. No series is gathered in memory, however long it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

START_VARIANCE = 1000.0
PROCESS_NOISE, OBSERVATION_NOISE = 1e-6, 1.0
FLAG_SIGMAS, RESET_SIGMAS = 3.0, 10.0


@dataclass
class Filter:
    """Position and velocity with their covariance; None is the state before any reading."""

    q: float = PROCESS_NOISE
    r: float = OBSERVATION_NOISE
    x: float | None = None
    v: float = 0.0
    pxx: float = START_VARIANCE
    pxv: float = 0.0
    pvv: float = START_VARIANCE
    at: float = 0.0
    steps: int = 0

    def seed(self, value: float) -> None:
        self.x, self.v = value, 0.0
        self.pxx = self.pvv = START_VARIANCE
        self.pxv = 0.0

    def step(self, value: float, at: float) -> tuple[float, float, bool, bool]:
        """Residual, its sigma, whether it is anomalous, and whether the filter kept its state."""
        self.steps += 1
        if self.x is None:
            self.seed(value)
            self.at = at
            return 0.0, math.sqrt(START_VARIANCE + self.r), False, False
        dt = at - self.at
        if dt < 0:
            raise ValueError(f"readings go back in time by {-dt} s")
        self.at = at
        # Predict.
        x = self.x + dt * self.v
        pxx = self.pxx + 2 * dt * self.pxv + dt * dt * self.pvv + self.q * dt**3 / 3
        pxv = self.pxv + dt * self.pvv + self.q * dt * dt / 2
        pvv = self.pvv + self.q * dt
        # Correct.
        residual, variance = value - x, pxx + self.r
        gx, gv = pxx / variance, pxv / variance
        sigma = math.sqrt(variance)
        self.x, self.v = x + gx * residual, self.v + gv * residual
        # The two off-diagonal entries are equal but for rounding.
        self.pxx, self.pxv, self.pvv = (1 - gx) * pxx, ((1 - gx) * pxv + pxv - gv * pxx) / 2, pvv - gv * pxv
        far = abs(residual / sigma)
        if far > RESET_SIGMAS:
            self.seed(value)
            return residual, sigma, True, False
        return residual, sigma, far > FLAG_SIGMAS, True


def run_filter(
    readings: DataFrame, keys: list[str], order: list[str], seconds: str, value: str, q: float = PROCESS_NOISE, r: float = OBSERVATION_NOISE
) -> DataFrame:
    """readings with residual, sigma, velocity, anomaly, kept and steps; nulls don't move a filter and have none."""
    from .tracks import by_series

    def begin():
        f = Filter(q, r)

        def follow(at: list[float], x: list[float | None]) -> list[tuple]:
            out = []
            for t, v in zip(at, x, strict=True):
                if v is None or not math.isfinite(v):
                    out.append((None, None, None, None, None, f.steps))
                else:
                    residual, sigma, anomaly, kept = f.step(v, t)
                    out.append((residual, sigma, f.v, anomaly, kept, f.steps))
            return out

        return follow

    new = "residual double, sigma double, velocity double, anomaly boolean, kept boolean, steps bigint"
    return by_series(readings, keys, order, [seconds, value], new, begin)
