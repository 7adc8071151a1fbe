"""The judge's stream from records to its two outputs, and replays of stored runs as records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import kafka, readings
from .judge import alerts, judged, write_both

#: Takes records (key, value, headers) and a topic, and returns when they are acknowledged.
Write = Callable[[DataFrame, str], None]


def taken(records: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings as the judge takes them, and records that break the contract.

    records have key, value and headers (the run is in header run-id), and from Kafka topic, partition and offset; bounds
    have a row for each sensor that has a span: sensor_id, low, alarm_low, alarm_high, high.
    """
    source = [F.col(c).alias(f"source_{c}") for c in ("topic", "partition", "offset") if c in records.columns]
    run = records.withColumn("run_id", kafka.header("run-id", F.col("headers"))).select("run_id", F.col("value").cast("string").alias("value"), *source)
    good, bad = readings.parse(run)
    flat = good.select(
        F.col("sensor.id").alias("sensor_id"), "reading_id", "run_id", (F.unix_micros("timestamp") / 1e6).alias("at"),
        F.when(F.col("is_usable"), F.col("measurement.value")).alias("value"), F.col("measurement.quality").alias("quality"),
        *[c for c in run.columns if c.startswith("source_")],
    )
    return flat.join(bounds.select("sensor_id", "low", "alarm_low", "alarm_high", "high"), "sensor_id", "left"), bad


def start(
    records: DataFrame, bounds: DataFrame, validated: str, alert_folder: str, checkpoint: str, pairs: DataFrame | None = None, **trigger
) -> StreamingQuery:
    """Judge a stream of records; a micro-batch that is done again after a failure replaces its files."""
    good, _ = taken(records, bounds)
    writer = judged(good, pairs).writeStream.foreachBatch(lambda batch, epoch: write_both(batch, validated, alert_folder, epoch))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def _as_records(rows: DataFrame, key: str, epoch: int) -> DataFrame:
    """Rows as JSON records under a key, which name their epoch."""
    named = F.array(F.struct(F.lit("epoch").alias("key"), F.lit(str(epoch)).cast("binary").alias("value")))
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), named.alias("headers"))


def publish(batch: DataFrame, epoch: int, write: Write, done: Callable[[int], bool], topics: tuple[str, str, str] = ("validated", "alerts", "epochs")) -> bool:
    """For foreachBatch: the verdicts to one topic, the alerts to another, then a marker of the epoch with both counts to a third.

    done tells whether an epoch's marker is there: then nothing is written again. After a failure between the writes the
    epoch comes again, with the same ids under the same epoch; `committed` reads what counts. Says whether it wrote.
    """
    if done(epoch):
        return False
    spark = batch.sparkSession
    batch.persist()
    try:
        both = [(topics[0], batch, "sensor_id"), (topics[1], alerts(batch), "sensor_id")]
        counts = {}
        for topic, rows, key in both:
            write(_as_records(rows, key, epoch), topic)
            counts[topic] = rows.count()
        marker = spark.createDataFrame([(epoch, counts[topics[0]], counts[topics[1]])], "epoch bigint, validated bigint, alerts bigint")
        write(_as_records(marker, "epoch", epoch), topics[2])
    finally:
        batch.unpersist()
    return True


def to_kafka(connection: kafka.Connection) -> Write:
    """Writes records to Kafka topics."""

    def write(records: DataFrame, topic: str) -> None:
        records.write.format("kafka").options(**kafka.sink_options(connection, topic)).save()

    return write


def committed(records: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """The records' rows (a JSON document each) of epochs that have a marker, one of each value of key, with `epoch`."""
    number = kafka.header("epoch", F.col("headers")).cast("bigint")
    ready = markers.select(number.alias("epoch")).distinct()
    rows = records.select(number.alias("epoch"), F.get_json_object(F.col("value").cast("string"), f"$.{key}").alias(key), F.col("value").cast("string").alias("value"))
    return rows.join(ready, "epoch", "left_semi").dropDuplicates([key])


def replay(stored: DataFrame, run: str = "run_id", step: str = "timestamp", partitions: int | None = None) -> DataFrame:
    """Stored readings of the contract as records: a sensor's lie in one partition, run after run and step after step.

    Spark writes a partition in its order and a key's records go to one partition of the topic, so a reader of the
    topic sees each sensor's records in their order, however many tasks write. Sensors are not in step with each other;
    `replay_runs` keeps runs apart.
    """
    keyed = stored.withColumn("__key", F.col("sensor.id"))
    dealt = keyed.repartition("__key") if partitions is None else keyed.repartition(partitions, "__key")
    return kafka.records(dealt.sortWithinPartitions("__key", run, step), run).select("key", "value", "headers")


def replay_runs(stored: DataFrame, write: Write, topic: str, run: str = "run_id", step: str = "timestamp", partitions: int | None = None) -> list:
    """Write runs one after the other, in the order of their first step: no record of a run before all of the last one are acknowledged.

    A run is a job; the runs' names (one row each) come to the driver, and are returned.
    """
    first = stored.groupBy(run).agg(F.min(step).alias("first")).orderBy("first", run)
    names = [r[run] for r in first.toLocalIterator()]
    for name in names:
        write(replay(stored.where(F.col(run).eqNullSafe(F.lit(name))), run, step, partitions), topic)
    return names
