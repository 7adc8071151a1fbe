"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table whose size is prime: a start and a
step, both hashed from its name. The shards take turns, each claiming the first slot of its order
that is still free, until the table is full. Every shard so gets the same number of slots, give or
take one, and few slots change hands when a shard joins or leaves.

A key's slot is its hash modulo the table's size. The table has a fixed number of rows, a parameter,
so it is broadcast, and a row's place costs one lookup. Nothing is shuffled, and a source with a
third of all rows is spread like any other since its rows have their own keys.

A null key is placed as the empty string is. Repeated keys go to the same shard. A key of any length is
hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime some 256 times the number of shards: their loads differ by less than one slot in 256.
SLOTS = 16381
SHARDS = [f"shard-{k:02d}" for k in range(64)]


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the number of the shard in shards that claimed it."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, and not less than that of shards")
    starts = [_hash(s, "start") % slots for s in shards]
    steps = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    at = list(starts)
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + steps[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of its MD5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def lookup(spark: SparkSession, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The filled table with the columns slot, shard."""
    rows = [(i, shards[k]) for i, k in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df's rows with the columns __slot and __shard, which replace such columns that df has."""
    df = df.withColumn("__slot", slot(F.col(key), slots)).drop("__shard")
    found = lookup(df.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    return df.join(F.broadcast(found), "__slot")


def write(df: DataFrame, key: str, path: str, shards: list[str] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Write df as Parquet, a folder for each shard, which up to `files` tasks fill."""
    placed = place(df, key, shards, slots)
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    dealt = placed.repartition(F.col("__shard"), salt).withColumnRenamed("__shard", "shard").drop("__slot")
    dealt.write.partitionBy("shard").parquet(path)


def loads(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("n_rows"))
