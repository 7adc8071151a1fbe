"""Trailing-window features of one instrument's readings, as columns.

A `Series` names what no window may cross (run and sensor) and the order in it. All features of one
series share one shuffle and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import ratio


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    #: A cell is null unless its window holds so many values.
    least: int = 3

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def rolling(self, f, x: Column, n: int) -> Column:
        return F.when(F.count(x).over(self.last(n)) >= self.least, f(x).over(self.last(n)))

    def reduced(self, f, x: Column, n: int) -> Column:
        """f (from an array column to a column) of a window's places, in order; a missing value is a null in its place."""
        w = self.last(n)
        places = F.collect_list(F.struct(x.alias("x"))).over(w)
        return F.when(F.count(x).over(w) >= self.least, f(F.transform(places, lambda p: p["x"])))

    def mean(self, x: Column, n: int) -> Column:
        return self.rolling(F.avg, x, n)

    def std(self, x: Column, n: int) -> Column:
        return self.rolling(F.stddev_samp, x, n)

    def min(self, x: Column, n: int) -> Column:
        return self.rolling(F.min, x, n)

    def max(self, x: Column, n: int) -> Column:
        return self.rolling(F.max, x, n)

    def lag(self, x: Column, k: int) -> Column:
        return F.lag(x, k).over(self.w)

    def change(self, x: Column, interval: float) -> Column:
        """First difference for each second of a fixed cadence."""
        return (x - self.lag(x, 1)) / interval

    def rate(self, x: Column, seconds: Column) -> Column:
        """Difference for each second elapsed; null on the first row and where time stands or goes back."""
        dt = seconds - self.lag(seconds, 1)
        return F.when(dt > 0, (x - self.lag(x, 1)) / dt)

    def slope(self, x: Column, n: int, interval: float) -> Column:
        """Least-squares slope over a window's places; 0 for a window of one, null for one that lacks a value."""
        # regr_slope over a place that starts at 0 in each series.
        place = (F.row_number().over(self.w) - 1).cast("double")
        w = self.last(n)
        xy, sx, sy = F.sum(x * place).over(w), F.sum(F.when(x.isNotNull(), place)).over(w), F.sum(x).over(w)
        sxx, c = F.sum(F.when(x.isNotNull(), place * place)).over(w), F.count(x).over(w)
        return F.when(c == F.count(F.lit(1)).over(w), F.coalesce(ratio(c * xy - sx * sy, (c * sxx - sx * sx) * interval), F.lit(0.0)))

    def variance_ratio(self, x: Column, short: int, long: int) -> Column:
        """Standard deviation of a short window to that of a long one; null where the long one is 0."""
        return ratio(self.std(x, short), self.std(x, long))

    def zero_crossings(self, x: Column, n: int) -> Column:
        """Crossings of the window's own mean to the transitions there are; values on the mean are skipped.

        A window that lacks a value has no mean of its own, and every transition counts.
        """
        w = self.last(n)
        values, places = F.collect_list(x).over(w), F.count(F.lit(1)).over(w)
        return F.when(F.size(values) < places, F.when(places > 1, 1.0).otherwise(0.0)).otherwise(crossings(values, F.avg(x).over(w)))

    def starts_run(self, x: Column) -> Column:
        """Whether a value differs from the one before; a null is like nothing."""
        return F.when(x == self.lag(x, 1), 0).otherwise(1)

    def pair_correlation(self, x: Column, y: Column, n: int) -> Column:
        """Pearson correlation in a window; null where either stands still."""
        w = self.last(n)
        both = x.isNotNull() & y.isNotNull()
        a, b = F.when(both, x), F.when(both, y)
        r = ratio(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w))
        return F.when(F.count(a).over(w) >= self.least, r)

    def carried(self, x: Column) -> Column:
        """The last value so far."""
        return F.last(x, ignorenulls=True).over(self.so_far)

    def since_valid(self, x: Column, seconds: Column) -> Column:
        """Seconds since the last earlier row with a value."""
        earlier = self.w.rowsBetween(Window.unboundedPreceding, -1)
        return seconds - F.last(F.when(x.isNotNull(), seconds), ignorenulls=True).over(earlier)


def crossings(values: Column, mean: Column) -> Column:
    """Share of neighbours on different sides of the mean, among the values that are off it."""
    sides = F.filter(F.transform(values, lambda v: F.signum(v - mean)), lambda s: s != 0)
    n = F.size(sides) - 1
    changed = F.size(
        F.filter(F.zip_with(F.slice(sides, 1, F.greatest(n, F.lit(0))), F.slice(sides, 2, F.greatest(n, F.lit(0))), lambda a, b: a != b), lambda c: c)
    )
    return F.when(n >= 1, changed / n).otherwise(0.0)
