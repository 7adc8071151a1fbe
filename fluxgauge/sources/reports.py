"""Byte-stable reports of small aggregates, and dimension files."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.checks import same_schema
from .files import Files


def write_matrix(long: DataFrame, path: str, row: str, column: str, value: str, names: list[str]) -> None:
    """A matrix of names by names as one CSV file with row labels, from long rows; absent cells are empty."""
    wide = long.where(F.col(row).isin(names)).groupBy(row).pivot(column, names).agg(F.first(value))
    place = F.array_position(F.array(*map(F.lit, names)), F.col(row))
    ordered = wide.select(F.col(row).alias("name"), *[F.col(f"`{n}`") for n in names]).orderBy(place).coalesce(1)
    ordered.write.mode("overwrite").option("header", "true").csv(path)


def to_json(df: DataFrame, order: list[str], most: int = 10_000) -> str:
    """Sorted rows with sorted keys, a line feed at the end; neither NaN nor more than `most` rows."""
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")

    def sane(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: sane(v) for k, v in x.items()}
        return [sane(v) for v in x] if isinstance(x, list) else x

    return json.dumps([sane(r) for r in rows], sort_keys=True, indent=2, default=str, allow_nan=False) + "\n"


def write_dimension(df: DataFrame, path: str, name: str, key: str, decimals: int = 6, most: int = 100_000) -> str:
    """A small dimension as one file, put there as a whole, and its text: under a name, each key's columns, sorted, numbers rounded.

    The text is JSON, which YAML readers take too. A key that is absent or repeated is an error.
    """
    rows = [r.asDict() for r in df.orderBy(key).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a dimension has {most} rows at most")
    keys = [r.pop(key) for r in rows]
    if any(k is None for k in keys) or len(set(keys)) < len(keys):
        raise ValueError(f"{key} must be there, once for each row")

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("a dimension has finite numbers only")
            return round(x, decimals) + 0.0
        return x

    table = {str(k): {c: plain(v) for c, v in r.items()} for k, r in zip(keys, rows, strict=True)}
    text = json.dumps({name: table}, sort_keys=True, indent=2, allow_nan=False) + "\n"
    files = Files(df.sparkSession, path.rpartition("/")[0])
    files.put(path, text, replace=True)
    return text


def read_dimension(spark: SparkSession, path: str, name: str, key: str, schema: StructType) -> DataFrame:
    """A file of write_dimension as rows of a schema; another section, other columns or types are errors."""
    document = json.loads(Files(spark, path.rpartition("/")[0]).text(path))
    if not isinstance(document.get(name), dict):
        raise ValueError(f"{path} has no section {name}")
    columns = [f.name for f in schema if f.name != key]
    if off := [k for k, r in document[name].items() if not isinstance(r, dict) or sorted(r) != sorted(columns)]:
        raise ValueError(f"{path}: {off[0]} has other columns than {', '.join(columns)}")
    rows = [{key: k, **r} for k, r in document[name].items()]
    made = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    return same_schema(made, schema)


def expanded(text: str, settings: Mapping[str, str]) -> str:
    """text with each ${NAME} as in settings, such as the environment; an error that names those that are not there."""
    names = re.findall(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", text)
    if absent := sorted({n for n in names if not settings.get(n)}):
        raise ValueError(f"not set: {', '.join(absent)}")
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: settings[m[1]], text)
