"""Wide text files of white-space-separated numbers, one row for each step, as long readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, width: int = 52, pattern: str = r"d(\d+)") -> DataFrame:
    """file_class, step, channel (from 0), value.

    A file whose rows are channels (width rows) is turned; one that is neither way raises when read.
    Rows are numbered by their place in the file, for which Spark reads each file whole: files are of
    one run, some hundred rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value")
    rows = F.filter(F.split("value", r"\r?\n"), lambda r: F.trim(r) != "")
    split = files.select(
        F.regexp_extract(F.regexp_extract("f", r"([^/]+)$", 1), pattern, 1).cast("int").alias("file_class"),
        F.transform(rows, lambda r: F.split(F.trim(r), r"\s+")).alias("m"),
    )
    n, k = F.size("m"), F.size(F.get("m", F.lit(0)))
    ragged = F.exists("m", lambda r: F.size(r) != F.size(F.get("m", F.lit(0))))
    way = (
        F.when(ragged | ((n != width) & (k != width)), F.raise_error(F.concat(F.lit("not a matrix of the width wanted: class "), "file_class")).cast("boolean"))
        .when(k == width, F.lit(False))
        .otherwise(F.lit(True))
    )
    cells = split.select("file_class", way.alias("turned"), F.posexplode("m").alias("row", "r")).select(
        "file_class", "turned", "row", F.posexplode("r").alias("col", "cell")
    )
    step = F.when(F.col("turned"), F.col("col")).otherwise(F.col("row"))
    channel = F.when(F.col("turned"), F.col("row")).otherwise(F.col("col"))
    return cells.select("file_class", step.cast("bigint").alias("step"), channel.alias("channel"), F.col("cell").cast("double").alias("value"))


#: Channels of the measured kinds (from 0), and the units.
PRESSURES, TEMPERATURES, ANALYSES, MEASURED = (6, 12, 15), (8, 10, 17, 20, 21), 22, 41
UNITS = {"thermocouple": "celsius", "pressure": "bar", "flow": "kg_s", "normalized": "normalized", "position": "percent"}


def described(cells: DataFrame) -> DataFrame:
    """cells with sensor_type, unit and sensor_location by channel."""
    c = F.col("channel")
    kind = (
        F.when(c >= MEASURED, "position").when(c >= ANALYSES, "normalized").when(c.isin(*PRESSURES), "pressure")
        .when(c.isin(*TEMPERATURES), "thermocouple").otherwise("flow")
    )
    place = F.when(c >= MEASURED, "core").when(c >= ANALYSES, "containment").when(c >= 10, "secondary_loop").otherwise("primary_loop")
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return cells.withColumns({"sensor_type": kind, "unit": units[kind], "sensor_location": place})


def adapt(cells: DataFrame, prefix: str, start: str, interval: int, measured: int = 41) -> DataFrame:
    """Cells as readings: sensor names, times at a fixed cadence, and elevations by channel."""
    name = F.when(
        F.col("channel") < measured, F.format_string(f"{prefix}-XMEAS-%02d", F.col("channel") + 1)
    ).otherwise(F.format_string(f"{prefix}-XMV-%02d", F.col("channel") - measured + 1))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("step") * interval)
    return cells.withColumns({
        "sensor_id": name, "timestamp": at, "elevation_m": ((F.col("channel") % 55) * 2 - 10).cast("double"),
        "quality": F.when(F.col("value").isNull() | F.isnan("value"), "missing").otherwise("good"),
    })
