"""Checks that tables hold what the operators rely on; each returns its findings as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.windows import Series

#: Fixed values of the reading contract.
SENSOR_TYPES = ("thermocouple", "pressure", "flow", "neutron_flux", "position", "normalized")
QUALITIES = ("good", "suspect", "bad", "missing")
UNUSABLE = ("bad", "missing")
PLANT_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def usable(quality: Column) -> Column:
    return ~quality.isin(*UNUSABLE)


def violations(df: DataFrame, rules: Mapping[str, Column], keys: list[str]) -> DataFrame:
    """keys and rule for each rule (a condition that must hold; null fails) that a row breaks."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    every = F.filter(F.array(*broken), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(every).alias("rule"))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of the rules they break."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull()
    )
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def cadence(readings: DataFrame, keys: list[str], order: list[str], seconds: Column) -> DataFrame:
    """keys, n, distinct gaps, smallest and largest gap: a steady clock has one gap."""
    s = Series(tuple(keys), tuple(order))
    gaps = readings.withColumn("__s", seconds).withColumn("__gap", F.col("__s") - F.lag("__s").over(s.w))
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("__gap").alias("n_gaps"), F.min("__gap").alias("least"), F.max("__gap").alias("most")
    )


def contiguous(readings: DataFrame, keys: list[str], step: str) -> DataFrame:
    """keys and whether their steps are 0 to n - 1, each once."""
    n = F.count("*")
    ok = (F.min(step) == 0) & (F.max(step) == n - 1) & (F.countDistinct(step) == n)
    return readings.groupBy(*keys).agg(n.alias("n"), ok.alias("contiguous"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def backwards(readings: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """Rows whose step is below that of the row before."""
    s = Series(tuple(keys), tuple(order))
    return readings.withColumn("__back", F.lag(step).over(s.w) > F.col(step)).where("__back").drop("__back")


def mismatched(manifest: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and `what` of entries that aren't found ('missing'), aren't listed ('extra') or whose values differ ('differs')."""
    a, b = F.struct(*values), F.struct(*[f"__{v}" for v in values])
    listed = manifest.select(*keys, *values, F.lit(True).alias("__listed"))
    there = found.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__there"))
    what = F.when(F.col("__there").isNull(), "missing").when(F.col("__listed").isNull(), "extra").when(~a.eqNullSafe(b), "differs")
    return listed.join(there, keys, "full").select(*keys, what.alias("what")).where("what IS NOT NULL")


def resolve_sensors(sensors: DataFrame, types: list[str], without: list[str], expected: int, sensor: str = "sensor_id", kind: str = "sensor_type") -> list[str]:
    """The sensors of the types, but those named, sorted; another number than expected is an error.

    sensors has a row for each sensor at least; distinct ones are a dimension of the plant and come to the driver.
    """
    picked = sensors.where(F.col(kind).isin(types) & ~F.col(sensor).isin(without)).select(sensor).distinct()
    found = sorted(r[0] for r in picked.limit(expected + 1).collect())
    if len(found) != expected:
        n = "more" if len(found) > expected else str(len(found))
        raise ValueError(f"{n} sensors of the types are there, {expected} are expected")
    return found


def same_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """df, or an error: columns, their order and their types must be those of the schema."""
    a, b = ([(f.name, f.dataType.simpleString()) for f in s.fields] for s in (df.schema, schema))
    if a != b:
        off = [f"{y} (found {x})" for x, y in zip_longest(a, b) if x != y]
        raise ValueError(f"other columns than expected: {', '.join(off[:5])}")
    return df


def sound(dimension: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """A small dimension, or an error that names its first defect: a repeated key or a broken rule."""
    twice = repeated(dimension, [key]).select(F.col(key).cast("string"), F.lit("repeated").alias("rule"))
    broken = violations(dimension, rules, [key]).select(F.col(key).cast("string"), "rule")
    first = twice.unionByName(broken).orderBy(key, "rule").first()
    if first is not None:
        raise ValueError(f"{key} {first[0]}: {first[1]}")
    return dimension


@dataclass(frozen=True)
class Dimension:
    """A small table, its key, conditions that its rows must keep, columns that name rows of other dimensions, and a column that names a row's parent in its own."""

    rows: DataFrame
    key: str
    rules: Mapping[str, Column] = field(default_factory=dict)
    #: Column to the dimension it names; nulls name nothing.
    references: Mapping[str, str] = field(default_factory=dict)
    #: Columns that must lie within two columns of the row of another dimension: column to (reference column, low, high).
    ranges: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    parent: str | None = None


def defects(dimensions: Mapping[str, Dimension], deepest: int = 64) -> DataFrame:
    """dimension, kind, key, detail of everything that is wrong in a set of dimensions that name each other, in one plan.

    Kinds: absent_key and repeated keys, broken rules, an orphan (a reference to no row), out_of_range, and cyclic parents: rows from
    which no way of up to `deepest` parents ends, followed by doubling.
    """
    found = []
    for place, (name, d) in enumerate(dimensions.items()):
        key = F.col(d.key).cast("string")

        def told(rows: DataFrame, order: int, kind: str, key: Column, detail: Column, name: str = name, place: int = place) -> None:
            found.append(rows.select(F.lit(place).alias("place"), F.lit(order).alias("order"), F.lit(name).alias("dimension"), F.lit(kind).alias("kind"), key.alias("key"), detail.cast("string").alias("detail")))

        told(d.rows.where(key.isNull()), 0, "absent_key", key, F.lit(None))
        told(repeated(d.rows.where(key.isNotNull()), [d.key]), 1, "repeated", key, F.col("n"))
        told(violations(d.rows.withColumn("__k", key), d.rules, ["__k"]), 2, "rule", F.col("__k"), F.col("rule"))
        for column, target in d.references.items():
            other = dimensions[target].rows.select(F.col(dimensions[target].key).cast("string").alias("__to")).distinct()
            named = d.rows.select(key.alias("__k"), F.col(column).cast("string").alias("__to")).where("__to IS NOT NULL")
            told(named.join(other, "__to", "left_anti"), 3, "orphan", F.col("__k"), F.concat_ws(" ", F.lit(column), "__to"))
        for column, (through, low, high) in d.ranges.items():
            other = dimensions[d.references[through]]
            bounds = other.rows.select(F.col(other.key).cast("string").alias("__to"), F.col(low).alias("__low"), F.col(high).alias("__high"))
            mine = d.rows.select(key.alias("__k"), F.col(through).cast("string").alias("__to"), F.col(column).alias("__x"))
            outside = mine.join(bounds, "__to").where("__x IS NULL OR __x < __low OR __x > __high")
            told(outside, 4, "out_of_range", F.col("__k"), F.concat_ws(" ", F.lit(column), F.col("__x").cast("string")))
        if d.parent is not None:
            up = d.rows.select(key.alias("__k"), F.col(d.parent).cast("string").alias("__up")).where("__k IS NOT NULL AND __up IS NOT NULL").dropDuplicates(["__k"])
            steps = 1
            while steps < deepest:  # a row's ancestor at twice the distance
                above = up.select(F.col("__k").alias("__up"), F.col("__up").alias("__next"))
                up, steps = up.join(above, "__up").select("__k", F.col("__next").alias("__up")), 2 * steps
            told(up, 5, "cyclic", F.col("__k"), F.lit(d.parent))
    return reduce(DataFrame.unionByName, found)


def whole(dimensions: Mapping[str, Dimension], deepest: int = 64) -> Mapping[str, Dimension]:
    """The dimensions, or an error that names their first defect, in the order of dimensions, kinds and keys."""
    first = defects(dimensions, deepest).orderBy("place", "order", "key", "detail").first()
    if first is not None:
        raise ValueError(f"{first.dimension} {first.key}: {first.kind}" + (f" ({first.detail})" if first.detail else ""))
    return dimensions


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing[:5])}")
    return df
