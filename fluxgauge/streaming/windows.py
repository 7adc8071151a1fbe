"""Event-time windows, deduplication and progress of streams; the same code serves batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def with_watermark(df: DataFrame, at: str, delay: str) -> DataFrame:
    """at as a timestamp in UTC, with a watermark if df is a stream."""
    out = df.withColumn(at, F.col(at).cast("timestamp"))
    return out.withWatermark(at, delay) if df.isStreaming else out


def windowed(df: DataFrame, at: str, length: str, slide: str | None, keys: list[str], **aggs: Column) -> DataFrame:
    """Tumbling windows, or sliding ones if slide is given: window_start, keys, aggregates."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = df.groupBy(w, *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("window.start").alias("window_start"), *keys, *aggs)


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], **aggs: Column) -> DataFrame:
    """Sessions of keys that a gap ends: session_start, session_end (last event and the gap), keys, aggregates."""
    out = df.groupBy(F.session_window(at, gap), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggs)


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows with an id not seen within the watermark."""
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


class Progress(StreamingQueryListener):
    """Counters of a stream: batches, rows, and the time of the last progress."""

    def __init__(self) -> None:
        self.batches = self.rows = 0
        self.last: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.last = event.progress.timestamp

    def onQueryIdle(self, event) -> None:
        self.last = event.timestamp

    def onQueryTerminated(self, event) -> None:
        pass


def observed(spark: SparkSession) -> Progress:
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
