"""Feature serving: as-of joins with a time to live, latest rows with a freshness verdict, timelines."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Files


def as_of(queries: DataFrame, features: DataFrame, keys: list[str], at: str, values: list[str], ttl: float) -> DataFrame:
    """queries with `values` of the last feature row at or before their time, if not older than ttl seconds.

    Both sides go through one shuffle on the keys and one sort by time; there is no join.
    """
    q = queries.withColumn("__f", F.lit(None).cast(features.select(F.struct(F.col(at).alias("__at"), *values)).schema[0].dataType))
    q = q.withColumns({"__side": F.lit(1), **{f"__q_{c}": F.col(c) for c in queries.columns if c not in (*keys, at)}})
    f = features.select(*keys, at, F.struct(F.col(at).alias("__at"), *values).alias("__f"), F.lit(0).alias("__side"))
    both = q.select(*keys, at, "__side", "__f", *[c for c in q.columns if c.startswith("__q_")]).unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__f", F.last("__f", ignorenulls=True).over(w)).where("__side = 1")
    age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__f.__at").cast("timestamp"))
    fresh = age <= F.lit(int(ttl * 1e6))
    rest = [F.col(f"__q_{c}").alias(c) for c in queries.columns if c not in (*keys, at)]
    return found.select(*keys, at, *rest, *[F.when(fresh, F.col(f"__f.{v}")).alias(v) for v in values])


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key, by partial aggregates."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("__r"))
    return best.select(*keys, "__r.*")


#: Buckets of a table of latest rows.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _listed(files: Files, version: int) -> dict:
    """What a version has: its schema, number of buckets, and the folder of each bucket that has rows."""
    name = f"{files.root}/_versions/{version}.json"
    if not files.exists(name):
        raise ValueError(f"version {version} is not there, or not complete")
    return json.loads(files.text(name))


def _folders(files: Files, listed: dict, wanted: set[int] | None = None) -> list[str]:
    return [f"{files.root}/{folder}" for bucket, folder in listed["folders"].items() if wanted is None or int(bucket) in wanted]


def _rows(spark: SparkSession, listed: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(listed["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table of latest rows."""
    return sorted(int(n.removesuffix(".json")) for n in Files(spark, path).names(f"{path}/_versions"))


def materialize(rows: DataFrame, path: str, keys: list[str], at: str, tie: str, version: int, buckets: int = BUCKETS) -> DataFrame:
    """Merge rows into the table of latest rows under path: its version `version` from the one before.

    Rows lie in buckets by their keys, sorted. A merge reads and writes the buckets that its rows fall into; the others stay where
    an earlier version put them. A version is there once its list of buckets is, which is put there as a whole; a version
    that is written again replaces itself, and readers of other versions are left alone. The number of buckets is
    that of the first version.
    """
    spark = rows.sparkSession
    files = Files(spark, path)
    before = _listed(files, version - 1) if version else {"schema": rows.schema.jsonValue(), "buckets": buckets, "folders": {}, "keys": keys}
    if before["keys"] != keys or StructType.fromJson(before["schema"]).fieldNames() != rows.columns:
        raise ValueError("the table has other keys or columns")
    placed = rows.withColumn("bucket", _bucket(keys, before["buckets"]))
    touched = {r[0] for r in placed.select("bucket").distinct().collect()}  # numbers of buckets
    old = _rows(spark, before, _folders(files, before, touched)).withColumn("bucket", _bucket(keys, before["buckets"]))
    merged = latest(old.unionByName(placed), keys, at, tie).select(*rows.columns, "bucket")
    folder = f"data/{version}-{uuid.uuid4().hex}"
    dealt = merged.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", *keys)
    dealt.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    now = before | {"folders": before["folders"] | {str(b): f"{folder}/bucket={b}" for b in sorted(touched)}}
    files.put(f"{path}/_versions/{version}.json", json.dumps(now, sort_keys=True), replace=True)
    return _rows(spark, now, _folders(files, now))


def lookup(asked: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """asked (with the table's keys) with the table's columns of its keys, or nulls: only the buckets of the keys asked for are read.

    Without a version it is the last complete one.
    """
    spark = asked.sparkSession
    files = Files(spark, path)
    if version is None:
        version = max(versions(spark, path), default=-1)
    listed = _listed(files, version)
    keys = listed["keys"]
    wanted = {r[0] for r in asked.select(_bucket(keys, listed["buckets"])).distinct().collect()}  # numbers of buckets
    return asked.join(_rows(spark, listed, _folders(files, listed, wanted)), keys, "left")


def served(asked: DataFrame, last: DataFrame, keys: list[str], at: str, now: Column, ttl: float) -> DataFrame:
    """asked with its latest row and `verdict`: fresh (a row of exactly the time to live is), stale or missing."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    verdict = F.when(F.col(at).isNull(), "missing").when(age > int(ttl * 1e6), "stale").otherwise("fresh")
    return asked.join(last, keys, "left").withColumn("verdict", verdict)


def end_to_end(runs: DataFrame, run: str, steps: str, gap: int = 1) -> DataFrame:
    """runs (one row for each) with `offset`, so that their steps follow each other; by length of name, then name.

    Names of one length are in the order of all but their last three letters, so lengths are summed up
    over those beginnings first (one row for some hundred runs) and over the runs of a beginning then.
    """
    name = F.col(run).cast("string")
    size, start = F.length(name).alias("__size"), F.expr(f"left(cast(`{run}` AS string), greatest(length(cast(`{run}` AS string)) - 3, 0))").alias("__start")
    cut = runs.select("*", size, start)
    far = cut.groupBy("__size", "__start").agg(F.sum(F.col(steps) + gap).alias("__sum"))
    w = Window.orderBy("__size", "__start").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("__size", "__start", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__far"))
    near = Window.partitionBy("__size", "__start").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.col(steps) + gap).over(near), F.lit(0))
    met = cut.withColumn("__own", own).join(far, ["__size", "__start"])
    return met.select(*runs.columns, (F.col("__far") + F.col("__own")).cast("bigint").alias("offset"))


def rebased(rows: DataFrame, at: str, anchor: str) -> DataFrame:
    """rows with their times moved so that the last is the anchor (UTC)."""
    last = rows.agg(F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("__last"))
    shift = F.unix_micros(F.lit(anchor).cast("timestamp")) - F.col("__last")
    moved = F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + shift)
    return rows.join(F.broadcast(last)).withColumn(at, moved).drop("__last")  # one row
