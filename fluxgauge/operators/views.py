"""Feature views: what a feature store promises of a table of features, and both ways to read it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from . import checks, store
from .features import feature_names


@dataclass(frozen=True)
class FeatureView:
    """Features of an entity by time: a double for each name, the time they hold from and the time they were made.

    A value is served for ttl seconds from its time on.
    """

    name: str
    ttl: float
    entity: str = "sensor_id"
    at: str = "event_timestamp"
    created: str = "created_timestamp"
    features: tuple[str, ...] = field(default_factory=lambda: tuple(feature_names()))

    def __post_init__(self) -> None:
        if self.ttl <= 0 or not self.features or len(set(self.features)) < len(self.features):
            raise ValueError("a view has a time to live above zero and features of different names")

    @property
    def schema(self) -> StructType:
        times = [StructField(c, TimestampType()) for c in (self.at, self.created)]
        return StructType([StructField(self.entity, StringType()), *times, *[StructField(f, DoubleType()) for f in self.features]])

    def source(self, rows: DataFrame) -> DataFrame:
        """rows as the view's offline source: its columns, in its types, one row of an entity and time, the last made."""
        found = checks.require(rows, [f.name for f in self.schema])
        typed = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        return store.latest(typed, [self.entity, self.at], self.created, self.features[0]).select(*self.schema.names)

    def register(self, rows: DataFrame) -> None:
        """Afterwards SQL knows the view by its name."""
        self.source(rows).createOrReplaceTempView(self.name)

    def history(self, asked: DataFrame, rows: DataFrame, features: tuple[str, ...] | None = None) -> DataFrame:
        """asked (entity and time) with the features that held then, null where there are none or they are too old."""
        return store.as_of(asked, self.source(rows), [self.entity], self.at, list(features or self.features), self.ttl)

    def materialize(self, rows: DataFrame, path: str, version: int) -> DataFrame:
        """Merge rows into the table of latest features under path."""
        return store.materialize(self.source(rows), path, [self.entity], self.at, self.created, version)

    def online(self, asked: DataFrame, path: str, now: Column, version: int | None = None) -> DataFrame:
        """asked entities with their latest features and `verdict`: fresh, stale or missing. Only their buckets are read."""
        found = store.lookup(asked.select(self.entity), path, version)
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(self.at))
        return found.withColumn("verdict", F.when(F.col(self.at).isNull(), "missing").when(age > int(self.ttl * 1e6), "stale").otherwise("fresh"))


@dataclass(frozen=True)
class FeatureService:
    """Named features of several views over one entity."""

    name: str
    views: tuple[tuple[FeatureView, tuple[str, ...]], ...]

    def history(self, asked: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
        """asked with all the service's features, view by view; sources has each view's rows by its name."""
        for view, features in self.views:
            asked = view.history(asked, sources[view.name], features)
        return asked
