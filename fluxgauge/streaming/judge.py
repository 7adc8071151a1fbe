"""The detectors on a stream: the verdicts of `detect.all_faults`, with state for each sensor and each pair of a run.

A micro-batch's readings fan out: each goes to its sensor, and to every pair that its sensor is in. A pair's state (two
lists of the last readings) is that of one run, so runs that overlap in a batch don't meet in it; what a pair finds goes on to
the reading's sensor in the same micro-batch, where the verdict is made. A sensor's readings are judged in the order of
their offsets, or of their time and id where there are none. A reading from another run than the last one, or from before
it, starts the sensor's state anew; one from before its sensor's last makes a pair forget that sensor.

Both processors need the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`), which `session` sets.
Pairs of runs that are over keep their state unless `forget` says after how many seconds it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detect, tracks

BOUNDS = ("low", "alarm_low", "alarm_high", "high")
SOURCE = {"source_topic": "string", "source_partition": "int", "source_offset": "bigint"}
READING = "sensor_id string, reading_id string, run_id string, at double, value double, quality string, " + ", ".join(f"{c} {k}" for c, k in SOURCE.items())
SPAN = ", ".join(f"{c} double" for c in BOUNDS)
SEEN = "pair bigint, a string, b string, expected double, observed double"


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    """In the order of offsets, of time and id where there are none."""
    by = ["source_offset"] if frame["source_offset"].notna().all() else ["at", "reading_id"]
    return frame.sort_values(by, kind="stable", ignore_index=True)


class SensorProcessor(StatefulProcessor):
    """A sensor's track; its rows are readings, and what pairs saw after one of them (rows with a pair)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("track", f"run_id string, seen_at double, {tracks.STATE}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run_id, seen_at, *state = self.held.get() if self.held.exists() else (None, None)
        track = tracks.Track(tuple(state) or None)
        frame = pd.concat(list(rows), ignore_index=True)  # one sensor's rows of a micro-batch
        of_pairs = frame[frame["pair"].notna()]
        seen: dict[str, list] = {}
        for reading, *found in zip(*(of_pairs[c].tolist() for c in ("reading_id", "pair", "a", "b", "expected", "observed")), strict=True):
            seen.setdefault(reading, []).append((int(found[0]), *found[1:]))
        frame = _sorted(frame[frame["pair"].isna()])
        if not len(frame):
            return
        runs, times = frame["run_id"].fillna(""), frame["at"]
        before, earlier = runs.shift(fill_value=run_id if run_id is not None else runs.iloc[0]), times.shift(fill_value=seen_at if seen_at is not None else times.iloc[0])
        anew = ((runs != before) | (times < earlier)).to_numpy()
        values = [v if v == v else None for v in frame["value"].tolist()]
        at, near = times.tolist(), frame["near"].fillna(0.0).tolist()
        numbers: list[tuple] = []
        cuts = [0, *(i for i in np.flatnonzero(anew).tolist() if i), len(frame)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if anew[a]:
                track = tracks.Track()
            numbers += track.follow(at[a:z], values[a:z], near[a:z])
        self.held.update((runs.iloc[-1], at[-1], *track.state()))
        out = frame.drop(columns=["near", "pair", "a", "b", "expected", "observed"])
        for (name, kind), column in zip((c.split(" ") for c in tracks.NUMBERS.split(", ")), zip(*numbers, strict=True), strict=True):
            out[name] = pd.array(column, {"bigint": "Int64", "double": "Float64", "boolean": "boolean"}[kind])
        out["seen"] = [sorted(seen.get(r, ())) for r in frame["reading_id"]]
        out["resets"] = anew.astype(int)
        yield out

    def close(self) -> None:
        pass


class PairProcessor(StatefulProcessor):
    """The last readings of a pair's sensors in one run."""

    def __init__(self, n: int, forget: int | None):
        self.n, self.forget = n, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        life = None if self.forget is None else 1000 * self.forget
        self.sides = [handle.getListState(name, "at double, x double", life) for name in ("first", "second")]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [list(s.get()) if s.exists() else [] for s in self.sides]
        pair = detect.Pair(self.n, *([[r[k] for r in side] for side in held] for k in (0, 1)))
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at", "sensor_id", "reading_id"], kind="stable", ignore_index=True)
        side, at = frame["side"].to_numpy(), frame["at"].to_numpy(float)
        for k in (0, 1):
            mine = at[side == k]
            if len(mine) and len(pair.at[k]) and mine[0] < pair.at[k][-1]:
                pair.forget(k)
        observed = pair.observe(side, at, frame["value"].to_numpy(float))
        for k, s in enumerate(self.sides):
            if len(pair.at[k]):
                s.put(list(zip(pair.at[k].tolist(), pair.x[k].tolist(), strict=True)))
        out = frame[["sensor_id", "reading_id", "pair", "a", "b", "expected"]].assign(observed=observed)
        yield out[~np.isnan(observed)]

    def close(self) -> None:
        pass


def judged(
    readings: DataFrame, pairs: DataFrame | None = None, tolerance: float = 0.0, stuck_run: int = detect.STUCK_RUN, rate_limit: float = detect.RATE_LIMIT,
    n: int = detect.PAIR_READINGS, limit: float = detect.CORRELATION_LIMIT, forget: int | None = None,
) -> DataFrame:
    """Streamed readings with verdicts: their columns, the numbers of their track, faults, quality and resets.

    readings have sensor_id, reading_id, run_id, at (seconds), value, quality and the four bounds of a span, and perhaps
    source_topic, source_partition and source_offset; pairs (a bounded table) has a, b and expected.
    """
    there = [F.col(c) if c in readings.columns else F.lit(None).cast(k).alias(c) for c, k in SOURCE.items()]
    x = F.col("value").cast("double")
    rows = readings.select(
        *[F.col(c).cast("string").alias(c) for c in ("sensor_id", "reading_id", "run_id")], F.col("at").cast("double").alias("at"),
        F.when(F.abs(x) < float("inf"), x).alias("value"), "quality", *there, *[F.col(c).cast("double").alias(c) for c in BOUNDS],
    )
    mode = "None" if forget is None else "ProcessingTime"
    width = F.col("alarm_high") - F.col("alarm_low")
    nothing = [F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in SEEN.split(", ")]
    met = rows.select("*", F.coalesce(width * tolerance, F.lit(0.0)).alias("near"), *nothing)
    if pairs is not None:
        fan = rows.where("value IS NOT NULL").join(F.broadcast(detect.sided(pairs, "sensor_id")), "sensor_id")
        fan = fan.select("run_id", "pair", "a", "b", "expected", "side", "sensor_id", "reading_id", "at", "value")
        saw = fan.groupBy("run_id", "a", "b").transformWithStateInPandas(PairProcessor(n, forget), f"sensor_id string, reading_id string, {SEEN}", "Append", mode)
        saw = saw.where(F.abs(F.col("observed") - F.col("expected")) > limit)
        met = met.unionByName(saw, allowMissingColumns=True)
    schema = f"{READING}, {SPAN}, {tracks.NUMBERS}, seen array<struct<{SEEN.replace(' ', ': ').replace(',:', ',')}>>, resets bigint"
    followed = met.groupBy("sensor_id").transformWithStateInPandas(SensorProcessor(), schema, "Append", mode)
    of_pairs = F.transform("seen", lambda p: detect.apart(limit, lambda name: p[name]))
    near = F.coalesce(width * tolerance, F.lit(0.0))
    return detect.verdict(followed, "value", of_pairs, stuck_run, rate_limit, near).drop("seen")


def flat(judged: DataFrame) -> DataFrame:
    """Verdicts with their faults' types, severities and confidences as lists beside the faults."""
    lists = {"fault_types": "fault_type", "severities": "severity", "confidences": "confidence"}
    return judged.withColumns({c: F.col("faults")[f] for c, f in lists.items()})


def alerts(judged: DataFrame) -> DataFrame:
    """An event for each fault: its id, reading, sensor, run, the fault with its evidence, the reading's time as detected_at, and where the reading came from."""
    rows = detect.alerts(judged, "reading_id", ("sensor_id", "run_id", "at", *SOURCE))
    return rows.withColumn("detected_at", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("bigint")))


def write_both(batch: DataFrame, validated: str, alert_folder: str, epoch: int) -> None:
    """For foreachBatch: all judged readings, and an alert for each fault; an epoch written again replaces itself."""
    batch.persist()
    try:
        flat(batch).write.mode("overwrite").parquet(f"{validated}/epoch={epoch}")
        alerts(batch).write.mode("overwrite").parquet(f"{alert_folder}/epoch={epoch}")
    finally:
        batch.unpersist()
