"""What a judge's stream has done: counters by kind of fault, latencies, batch sizes, lag and heartbeat.

`observed` makes Spark aggregate the numbers of each micro-batch beside its work, also latencies as counts in buckets that
add up; a `Telemetry` listener on the driver adds up what progress events bring and holds no rows.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections import Counter
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalar import SEVERITIES
from ..operators import detect, sketches
from ..operators.checks import QUALITIES

NAME = "judge"
#: The error of latency quantiles, the latencies in seconds that buckets tell apart, and how many of the last readings count.
ERROR, SHORTEST, LONGEST, WINDOW = 0.1, 1e-4, 1e6, 10_000
#: Upper bounds of histograms: a batch's seconds and readings.
SECONDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
SIZES = (1, 10, 50, 100, 250, 500, 1_000, 5_000, 10_000, 100_000)


def _ladder() -> range:
    g = math.log(sketches.gamma(ERROR))
    return range(math.floor(math.log(SHORTEST) / g), math.ceil(math.log(LONGEST) / g) + 1)


def _faults_with(field: str, value: str) -> Column:
    return F.coalesce(F.sum(F.size(F.filter("faults", lambda f: f[field] == value))), F.lit(0))


def observed(judged: DataFrame, latency: Column | None = None, name: str = NAME) -> DataFrame:
    """judged, whose micro-batches report their counts; latency is a reading's seconds from its making to its verdict."""
    ladder = _ladder()
    at = None if latency is None else F.greatest(F.lit(ladder[0]), F.least(F.lit(ladder[-1]), sketches.bucket(F.greatest(latency.cast("double"), F.lit(SHORTEST)), ERROR)))
    numbers = {
        "readings": F.count("*"), "without_value": F.count_if(F.col("value").isNull()), "unknown_sensor": F.count_if(F.col("low").isNull()),
        "resets": F.coalesce(F.sum("resets"), F.lit(0)),
        "faults": F.array(*[_faults_with("fault_type", k) for k in detect.NAMES]),
        "severities": F.array(*[_faults_with("severity", s) for s in SEVERITIES]),
        "qualities": F.array(*[F.count_if(F.col("quality") == q) for q in QUALITIES]),
        "latencies": F.array() if at is None else F.array(*[F.count_if(at == i) for i in ladder]),
    }
    return judged.observe(name, *[c.alias(n) for n, c in numbers.items()])


class Histogram:
    """Counts of values up to each bound, and their sum; two of one kind add up."""

    def __init__(self, bounds: tuple):
        self.bounds, self.counts, self.sum = bounds, [0] * (len(bounds) + 1), 0.0

    def add(self, x: float) -> None:
        self.counts[bisect_left(self.bounds, x)] += 1
        self.sum += x

    def merge(self, other: Histogram) -> None:
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.sum += other.sum

    def cumulative(self) -> dict[float, int]:
        total, out = 0, {}
        for bound, n in zip((*self.bounds, math.inf), self.counts, strict=True):
            total += n
            out[bound] = total
        return out


class Telemetry(StreamingQueryListener):
    """Adds up the progress of one session's queries that are observed under a name."""

    def __init__(self, name: str = NAME, window: int = WINDOW):
        self.name = name
        self.counts: Counter = Counter(dict.fromkeys(("readings", "without_value", "unknown_sensor", "resets"), 0))
        self.faults: Counter = Counter()
        self.severities: Counter = Counter()
        self.qualities: Counter = Counter()
        self.latency = sketches.Sliding(ERROR, window)
        self.batch_seconds, self.batch_sizes = Histogram(SECONDS), Histogram(SIZES)
        self.lag: dict[str, int] = {}
        self.heartbeat: datetime | None = None
        self.errors = self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.progressed(event.progress)

    def progressed(self, progress) -> None:
        self.heartbeat = _time(progress.timestamp)
        self.lag |= _lag(progress.sources)
        if (seen := progress.observedMetrics.get(self.name)) is None:
            return
        self.batches += 1
        self.counts.update({k: seen[k] for k in self.counts})
        for into, names, key in ((self.faults, detect.NAMES, "faults"), (self.severities, SEVERITIES, "severities"), (self.qualities, QUALITIES, "qualities")):
            into.update({name: n for name, n in zip(names, seen[key], strict=True) if n})
        if len(seen["latencies"]):
            self.latency.add({i: n for i, n in zip(_ladder(), seen["latencies"], strict=True) if n})
        self.batch_sizes.add(seen["readings"])
        self.batch_seconds.add(progress.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        self.heartbeat = _time(event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self.errors += event.exception is not None

    def snapshot(self) -> dict:
        """All numbers at once; latencies in seconds, within ERROR of what they say."""
        return {
            **self.counts, "batches": self.batches, "errors": self.errors, "faults": dict(self.faults), "severities": dict(self.severities),
            "qualities": dict(self.qualities), "latency_p50": self.latency.quantile(0.5), "latency_p99": self.latency.quantile(0.99),
            "batch_seconds": self.batch_seconds.cumulative(), "batch_sizes": self.batch_sizes.cumulative(), "lag": dict(self.lag),
            "heartbeat": self.heartbeat,
        }


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def _lag(sources) -> dict[str, int]:
    """Records still to be read, by topic and partition, of the sources that tell their latest offsets."""
    out = {}
    for s in sources:
        latest, end = _offsets(s.latestOffset), _offsets(s.endOffset)
        for topic, partitions in latest.items() if end else ():
            if isinstance(partitions, dict):
                for p, n in partitions.items():
                    out[f"{topic}-{p}"] = max(0, n - end.get(topic, {}).get(p, 0))
    return out


def _offsets(text: str) -> dict:
    """Offsets by topic and partition; nothing where a source has none of that form."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def listening(spark: SparkSession, name: str = NAME) -> Telemetry:
    listener = Telemetry(name)
    spark.streams.addListener(listener)
    return listener
