"""A pluggable source of runs: anything that lists its runs and yields the batches of one.

`register` makes a Spark data source of it: one partition for each run, read by the executors, as a
batch or as a stream that takes up runs as they appear.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Runs(Protocol):
    """What a source provides; it travels to the executors, so it must pickle."""

    #: Spark schema of its rows, as text.
    schema: str

    def list(self) -> list[str]:
        """Names of the runs there are, in order: those listed before stay first. No run is an error."""
        ...

    def read(self, run: str) -> Iterator[pa.RecordBatch]:
        """The batches of one run."""
        ...


class _Run(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def register(spark: SparkSession, name: str, runs: Runs) -> None:
    """Afterwards spark.read.format(name).load() reads the source, and spark.readStream.format(name) follows it."""

    class Batch(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Run(r) for r in runs.list()]

        def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
            return runs.read(partition.name)

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"runs": 0}

        def latestOffset(self) -> dict:
            return {"runs": len(runs.list())}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [_Run(r) for r in runs.list()[start["runs"] : end["runs"]]]

        def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
            return runs.read(partition.name)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return runs.schema

        def reader(self, schema) -> DataSourceReader:
            return Batch()

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream()

    spark.dataSource.register(Source)
