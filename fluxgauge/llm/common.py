"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker. Texts may be long, so a batch stays small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, and make sure that there is a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share; one of this machine only if there is no other."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def per_text(
    docs: DataFrame,
    keep: list[str],
    text: str,
    new_schema: str,
    make: Callable[[], Callable[[list], Iterable[list]]],
) -> DataFrame:
    """Map each row's text to new columns beside the columns of keep, without a shuffle.

    make() runs once in a task and returns a function from a list of texts to the lists of
    the new columns' values, in the order of new_schema.
    """
    prepare(docs.sparkSession)
    text_name = "text"
    while text_name in keep:
        text_name += "_"
    picked = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias(text_name))
    fields = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    types = docs.sparkSession.createDataFrame([], new_schema).schema
    names = [f.name for f in types]
    kinds = [_arrow_type(f.dataType.simpleString()) for f in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            columns = f(batch.column(text_name).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)],
                [*keep, *names],
            )

    return picked.mapInArrow(run, ", ".join(x for x in (fields, new_schema) if x))


def keep_texts(docs: DataFrame, text: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of docs, all columns, whose text passes; make() as for per_text, returning booleans."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield batch.filter(pa.array(f(batch.column(text).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _arrow_type(name: str) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }
    return simple[name] if name in simple else pa.list_(simple[name[len("array<") : -1]])


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns node, root of an undirected graph with the long columns a, b.

    Alternating large-star and small-star rounds; each is two aggregations with partial sums
    and two equi-joins, so a node with very many neighbours is never gathered in one task.
    Every round is cut with checkpoint(). Nothing but two totals a round reaches the driver.
    """
    prepare(edges.sparkSession)
    stars = (
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ).checkpoint()

    def totals(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return tuple(row)

    seen = totals(stars)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = totals(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def sliced(numbers: np.ndarray) -> list[int]:
    """Bit planes of unsigned 64-bit numbers: bit i of plane b is bit b of number i."""
    bits = np.unpackbits(numbers.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


class Memory(dict):
    """Remembers at most 2 * most results: those of this generation, and those before it that come again."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value
