"""Coverage of a grid of cases by labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(**axes: DataFrame) -> DataFrame:
    """All combinations of the axes' values (one column each): plan tables with a few rows, by their nature."""
    return reduce(lambda a, b: a.crossJoin(b), axes.values())


def covered(cells: DataFrame, rows: DataFrame, axes: list[str], **aggs: Column) -> DataFrame:
    """cells with the aggregates over their rows and whether there is any."""
    stats = rows.groupBy(*axes).agg(F.count("*").alias("n_rows"), *[a.alias(n) for n, a in aggs.items()])
    out = cells.join(stats, axes, "left")
    return out.withColumn("covered", F.col("n_rows").isNotNull()).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def dense(rows: DataFrame, step: list[str], channel: str, channels: list[str]) -> DataFrame:
    """rows and a row (with nulls) for every channel that a step lacks; channels is the resolved, bounded list."""
    every = rows.select(*step).distinct().withColumn(channel, F.explode(F.array(*[F.lit(c) for c in channels])))
    return every.join(rows, [*step, channel], "left").select(*rows.columns)


def by_scope(rows: DataFrame, scope: str, axes: list[str], **aggs: Column) -> DataFrame:
    """The aggregates for every scope and over all of them (scope null), in one pass."""
    sets = [[F.col(scope), *map(F.col, axes)], list(map(F.col, axes))]
    out = rows.groupingSets(sets, F.col(scope), *map(F.col, axes)).agg(F.count("*").alias("n_rows"), *[a.alias(n) for n, a in aggs.items()])
    return out


def typed_gate(cells: DataFrame, share: float, kind: str, kinds: int) -> DataFrame:
    """covered_share, the kinds that any cell covers, and whether all of them are and the share reaches the gate."""
    part, n = F.avg(F.col("covered").cast("double")), F.countDistinct(F.when(F.col("covered"), F.col(kind)))
    return cells.agg(part.alias("covered_share"), n.alias("n_kinds"), ((part >= share) & (n == kinds)).alias("passed"))


def gate(cells: DataFrame, share: float) -> DataFrame:
    """covered_share and whether it reaches the gate."""
    part = F.avg(F.col("covered").cast("double"))
    return cells.agg(part.alias("covered_share"), (part >= share).alias("passed"))


def id_sets(rows: DataFrame, axes: list[str], ids: dict[str, str], sums: dict[str, Column]) -> DataFrame:
    """axes, what, slot, bits, and the sums: the sets of ids (whole numbers from 0, of rows that have one) of each cell, as bitmaps.

    Each of ids (what: column) has a row for each slot of 32,768 numbers that it uses; the sums and n_rows are in rows without
    a slot. Sets and sums of cells add up to those of any union of cells, so distinct counts don't need the rows again.
    """
    each = F.array(
        F.struct(F.lit(None).cast("string").alias("what"), F.lit(None).cast("bigint").alias("id")),
        *[F.struct(F.lit(what).alias("what"), F.col(c).cast("bigint").alias("id")) for what, c in ids.items()],
    )
    first = F.col("what").isNull()
    spread = rows.withColumn("__s", F.explode(each)).withColumns({"what": F.col("__s.what"), "__id": F.col("__s.id")}).where(first | F.col("__id").isNotNull())
    # Numbers of bitmaps start at 1.
    slot = F.when(~first, F.bitmap_bucket_number(F.col("__id") + 1))
    place = F.when(~first, F.bitmap_bit_position(F.col("__id") + 1))
    totals = {"n_rows": F.count_if(first), **{n: F.coalesce(F.sum(F.when(first, c)), F.lit(0)) for n, c in sums.items()}}
    return spread.groupBy(*axes, "what", slot.alias("slot")).agg(F.bitmap_construct_agg(place).alias("bits"), *[c.alias(n) for n, c in totals.items()])


def scoped(sets: DataFrame, axes: list[str], scopes: list[list[str]], ids: list[str], sums: list[str]) -> DataFrame:
    """axes (null where a scope leaves one out), scope (its number in scopes), n_rows, the sums, and n_ of each of ids: distinct counts by union of sets."""
    named = [[F.col(c) for c in (*scope, "what", "slot")] for scope in scopes]
    parts = sets.groupingSets(named, *[F.col(c) for c in (*axes, "what", "slot")])
    # grouping_id of the axes tells the scopes apart.
    masks = {sum(1 << (len(axes) - 1 - i) for i, a in enumerate(axes) if a not in scope): k for k, scope in enumerate(scopes)}
    united = parts.agg(
        F.expr(f"shiftright(grouping_id({', '.join(f'`{c}`' for c in (*axes, 'what', 'slot'))}), 2)").alias("__left_out"),
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("__n"), F.sum("n_rows").alias("n_rows"), *[F.sum(n).alias(n) for n in sums],
    )
    which = F.coalesce(*[F.when(F.col("__left_out") == mask, F.lit(k)) for mask, k in masks.items()]).alias("scope")
    counts = [F.coalesce(F.sum(F.when(F.col("what") == c, F.col("__n"))), F.lit(0)).cast("bigint").alias(f"n_{c}") for c in ids]
    rest = [F.sum(c).cast("bigint").alias(c) for c in ("n_rows", *sums)]
    return united.select("*", which).groupBy("scope", *axes).agg(*rest, *counts)
