"""Stored runs, a folder for each (key=number), read one after the other."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import require
from .files import Files


def discover(spark: SparkSession, root: str, producer: str, key: str = "fault_type") -> dict[int, str]:
    """The runs' folders by number, in order; an error that names who makes them if there is none. Other folders are passed over."""
    files = Files(spark, root)
    if not files.exists(files.root):
        raise FileNotFoundError(f"{root} is not there: run {producer} first")
    named = {n: re.fullmatch(rf"{re.escape(key)}=(\d+)", n) for n in files.names(files.root)}
    found = {int(m[1]): f"{files.root}/{n}" for n, m in named.items() if m and any(x.endswith(".parquet") for x in files.names(f"{files.root}/{n}"))}
    if not found:
        raise FileNotFoundError(f"{root} has no {key}= folder with Parquet files: run {producer} first")
    return dict(sorted(found.items()))


def in_order(spark: SparkSession, root: str, producer: str, key: str = "fault_type", columns: list[str] | None = None) -> Iterator[tuple[int, DataFrame]]:
    """Each run's number and rows, with the key as a column, in the order of numbers. A run's files are looked at when it is its turn, and
    rows are read by whatever takes the frame, so no run is held."""
    for number, folder in discover(spark, root, producer, key).items():
        try:
            rows = spark.read.option("basePath", root).parquet(folder)
        except Exception as e:
            raise ValueError(f"{folder} is not readable as Parquet: {str(e).splitlines()[0]}") from e
        yield number, rows if columns is None else require(rows, [*columns, key]).select(*columns, key)
