"""The wire form of readings: nested JSON, checked against the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean
from ..operators.checks import PLANT_ID, QUALITIES, SENSOR_TYPES, require

SCHEMA = (
    "reading_id string, timestamp timestamp, plant_id string, "
    "sensor struct<id: string, type: string, location: string, elevation_m: double>, "
    "measurement struct<value: double, unit: string, quality: string, raw_counts: int>, "
    "metadata struct<calibration_date: date, last_maintenance: date, drift_coefficient: double>"
)
#: Times keep their microseconds on the wire.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def parse(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid readings, and quarantined messages with `broken`: tombstone, not_json or the rules they break."""
    text = F.col(value).cast("string")
    # One row each: filters stay above the explode, so that a message is parsed once and not for each rule.
    parsed = messages.select("*", F.explode(F.array(F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}))).alias("__r"))
    tests = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules("__r").items()]
    broken = F.when(text.isNull(), F.array(F.lit("tombstone"))).when(
        F.col("__r").isNull() | F.col("__r.reading_id").isNull() & F.col("__r.sensor").isNull(), F.array(F.lit("not_json"))
    ).otherwise(F.filter(F.array(*tests), lambda r: r.isNotNull()))
    marked = parsed.withColumn("broken", broken)
    rest = [c for c in messages.columns if c != value]
    good = marked.where(F.size("broken") == 0).select(*rest, "__r.*")
    usable = ~F.col("measurement.quality").isin("bad", "missing")
    return good.withColumn("is_usable", usable), marked.where(F.size("broken") > 0).select(*messages.columns, "broken")


def rules(root: str) -> dict[str, Column]:
    r = F.col(root)
    return {
        "reading_id": r["reading_id"].isNotNull(),
        "timestamp": r["timestamp"].isNotNull(),
        "plant_id": r["plant_id"].rlike(PLANT_ID),
        "sensor_id": r["sensor"]["id"].isNotNull(),
        "sensor_type": r["sensor"]["type"].isin(*SENSOR_TYPES),
        "elevation": r["sensor"]["elevation_m"].between(-10, 100),
        "quality": r["measurement"]["quality"].isin(*QUALITIES),
        "raw_counts": r["measurement"]["raw_counts"].between(0, 65535),
        "drift": F.coalesce(r["metadata"]["drift_coefficient"], F.lit(0.0)) >= 0,
    }


def nested(
    flat: DataFrame, calibrated: str = "2023-06-01", maintained: str = "2023-12-01", drift: float = 0.0001
) -> DataFrame:
    """Flat rows as readings of the contract, every row one; NaN is no value. The metadata are a run's constants."""
    require(flat, ["reading_id", "timestamp", "plant_id", "sensor_id", "sensor_type", "sensor_location", "elevation_m", "value", "unit", "quality", "raw_counts"])
    text = {c: F.col(c).cast("string") for c in ("sensor_id", "sensor_type", "sensor_location", "unit", "quality")}
    return flat.select(
        F.col("reading_id").cast("string").alias("reading_id"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("plant_id").cast("string").alias("plant_id"),
        F.struct(
            text["sensor_id"].alias("id"), text["sensor_type"].alias("type"), text["sensor_location"].alias("location"),
            F.col("elevation_m").cast("double").alias("elevation_m"),
        ).alias("sensor"),
        F.struct(
            clean(F.col("value")).alias("value"), text["unit"].alias("unit"), text["quality"].alias("quality"), F.col("raw_counts").cast("int").alias("raw_counts")
        ).alias("measurement"),
        F.struct(
            F.lit(calibrated).cast("date").alias("calibration_date"), F.lit(maintained).cast("date").alias("last_maintenance"),
            F.lit(float(drift)).alias("drift_coefficient"),
        ).alias("metadata"),
    )


def encode(readings: DataFrame, *more: str) -> DataFrame:
    """Readings as messages: key is the sensor, value the JSON; and the columns of more."""
    names = [x.split(" ")[0] for x in ("reading_id", "timestamp", "plant_id", "sensor", "measurement", "metadata")]
    return readings.select(F.col("sensor.id").alias("key"), F.to_json(F.struct(*names), {"timestampFormat": MICROS}).alias("value"), *more)


def numbers(readings: DataFrame) -> DataFrame:
    """A flat view of the numbers for models."""
    return readings.select(
        F.col("sensor.id").alias("sensor_id"),
        F.unix_micros("timestamp").alias("at_micros"),
        F.col("measurement.value").alias("value"),
        F.col("measurement.raw_counts").alias("raw_counts"),
        F.col("metadata.drift_coefficient").alias("drift_coefficient"),
        F.col("sensor.elevation_m").alias("elevation_m"),
    )
