"""The hourly archive of readings: appends that many writers may repeat, and pruned range reads.

Layout: plant=/year=/month=/day=/hour=/part=, in UTC.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Files

HOUR = ["plant", "year", "month", "day", "hour"]
#: Hours whose folders are looked up or claimed at once.
CLAIMS = 16


def hourly(readings: DataFrame, at: str = "timestamp", plant: str = "plant_id") -> DataFrame:
    """readings with the columns of their folder."""
    t = F.col(at).cast("timestamp")
    return readings.withColumns({
        "plant": F.col(plant), "year": F.date_format(t, "yyyy"), "month": F.date_format(t, "MM"),
        "day": F.date_format(t, "dd"), "hour": F.date_format(t, "HH"),
    })


def new_rows(readings: DataFrame, stored: DataFrame | None, key: str = "reading_id") -> DataFrame:
    """The rows that are not stored yet; of repeated ones in the batch one."""
    once = readings.dropDuplicates([key])
    return once if stored is None else once.join(stored.select(key), key, "left_anti")


def append(spark: SparkSession, readings: DataFrame, path: str, at: str = "timestamp", key: str = "reading_id", attempts: int = 20) -> DataFrame:
    """Add what isn't stored yet; a row for each hour of the batch: its folder's columns, `answer` (created or existing), and how many readings it added.

    An hour is a list of numbered parts. A writer puts its rows into a folder of its own and then claims, for each hour, the
    number after the last one it has seen, by a rename that fails if that number is taken. Who comes second looks up the new
    part and tries again with what it lacks, so each reading is there once however many writers there are, and a
    part is there as a whole or not at all. A batch that is written again, or whose writer died on the way, adds
    what is missing. Readings without a key are left out. The hours' folders are what the driver handles, not their rows.
    """
    folders = _Folders(spark, path)
    batch = hourly(readings, at).where(F.col(key).isNotNull()).dropDuplicates([key])
    hours = [tuple(map(str, r)) for r in batch.select(*HOUR).distinct().collect()]
    answers = {h: ("existing", 0) for h in hours}
    for _ in range(attempts):
        if not hours:
            break
        with ThreadPoolExecutor(CLAIMS) as pool:
            parts = dict(zip(hours, pool.map(folders.parts, hours), strict=True))
        known = [folders.part(h, n) for h, seen in parts.items() for n in seen]
        fresh = batch.join(F.broadcast(spark.createDataFrame(hours, ", ".join(f"{c} string" for c in HOUR))), HOUR, "left_semi")
        fresh = new_rows(fresh, spark.read.parquet(*known).select(key) if known else None, key)
        staged = folders.staging()
        # A file for each hour; as many tasks as can run, else small hours would be written one after the other.
        tasks = max(1, min(len(hours), spark.sparkContext.defaultParallelism))
        fresh.repartition(tasks, *HOUR).write.partitionBy(*HOUR).parquet(staged)
        filled = folders.staged(staged)
        with ThreadPoolExecutor(CLAIMS) as pool:
            got = pool.map(lambda x: folders.claim(f"{staged}/{folders.name(x[0])}", x[0], max(parts[x[0]], default=-1) + 1), filled)
            claimed = list(zip(filled, got, strict=True))
        folders.drop(staged)
        answers |= {h: ("created", answers[h][1] + n) for (h, n), mine in claimed if mine}
        hours = [h for (h, _), mine in claimed if not mine]
    else:
        raise RuntimeError(f"other writers took {len(hours)} hours {attempts} times")
    rows = [(*h, *answer) for h, answer in answers.items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in HOUR) + ", answer string, added bigint")


class _Folders(Files):
    """The archive's folders."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.plants: dict[str, str] = {}

    def name(self, hour: tuple) -> str:
        if hour[0] not in self.plants:
            self.plants[hour[0]] = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(hour[0])
        return "/".join(f"{c}={v}" for c, v in zip(HOUR, (self.plants[hour[0]], *hour[1:]), strict=True))

    def part(self, hour: tuple, n: int) -> str:
        return f"{self.root}/{self.name(hour)}/part={n}"

    def parts(self, hour: tuple) -> list[int]:
        names = self.names(f"{self.root}/{self.name(hour)}")
        return sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))

    def staging(self) -> str:
        return f"{self.root}/_staging/{uuid.uuid4().hex}"

    def staged(self, folder: str) -> list[tuple[tuple, int]]:
        """The hours that a staging folder has, with their numbers of rows."""
        if not any(n.startswith(f"{HOUR[0]}=") for n in self.names(folder)):
            return []
        rows = self.spark.read.parquet(folder)
        counts = rows.groupBy(*[F.col(c).cast("string").alias(c) for c in HOUR]).agg(F.count("*").alias("n")).collect()
        pads = (0, 4, 2, 2, 2)
        return [(tuple(r[c].zfill(p) for c, p in zip(HOUR, pads, strict=True)), r["n"]) for r in counts]

    def claim(self, source: str, hour: tuple, n: int) -> bool:
        """Move a folder to an hour's part n; False if somebody else has it."""
        return self.move(source, self.part(hour, n))


def read_range(archive: DataFrame, plant: str, start: str, end: str, at: str = "timestamp", key: str = "reading_id") -> DataFrame:
    """A plant's readings in [start, end), by time: a row of each id, the earliest. Hours outside are pruned."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    hour = F.make_timestamp(*[F.col(c).cast("int") for c in HOUR[1:]], F.lit(0), F.lit(0))
    near = archive.where((F.col("plant") == plant) & (hour >= F.date_trunc("HOUR", low)) & (hour < high))
    rows = near.where((F.col(at) >= low) & (F.col(at) < high))
    first = F.row_number().over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n").orderBy(at, key)
