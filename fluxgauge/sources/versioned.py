"""Parquet tables that carry the version of their schema and when they were made.

Both are metadata of the columns, which Spark keeps in the footers of the files and gives back with the
schema, so that a check reads no data. The number of rows is in the footers by itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.checks import same_schema

VERSION = "1"


def write(df: DataFrame, path: str, created_at: datetime, version: str = VERSION, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """df under path, as snappy Parquet; created_at needs a zone."""
    if created_at.tzinfo is None:
        raise ValueError("created_at has no zone")
    told = {"schema_version": version, "created_at": created_at.isoformat()}
    marked = df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, **told}) for c in df.columns])
    marked.write.mode(mode).option("compression", "snappy").partitionBy(*(by or [])).parquet(path)


def read(spark: SparkSession, path: str, schema: StructType, version: str = VERSION) -> DataFrame:
    """The table under path, or an error if its columns, their types or its version are others."""
    found = same_schema(spark.read.parquet(path), schema)
    versions = {f.metadata.get("schema_version") for f in found.schema.fields}
    if versions != {version}:
        raise ValueError(f"the table's schema has version {', '.join(sorted(map(str, versions)))}, not {version}")
    return found


def write_runs(df: DataFrame, path: str, by: list[str]) -> None:
    """Runs in folders by scenario, seed and run (by), each in one file, in place of what their folders held."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Of every file under path: its path from there, length in bytes, and sha256. Files are read whole, one by one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    root = path.rstrip("/").split("://")[-1]
    at = F.locate(root, "path") + len(root) + 1
    return files.select(F.col("path").substr(at, F.length("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
