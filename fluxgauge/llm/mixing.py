"""Mixing sources to target weights by balanced sampling with the cube method.

A document's size is its number of words. Sources, in the order of their names with null last, have weights that
repeat, and share a total by them; no target is above `most` times its source's size, and what that leaves
over goes to the others by weight. A document is taken a whole number of times for sure and once more with the
fraction that is left: that inclusion probability is the same for a source's documents. The cube method settles
the fractions. Three open documents at a time move along the direction that changes neither the number of documents
nor the number of words (the null space of both constraints), until one of them is in or out; the direction's sense
is drawn so that nobody's probability changes in the mean. Two documents at most stay open in a group; groups' open
documents meet in new groups until a source has one group, and a small linear programme lands the last two: of all
ways to draw them with their probabilities the one that misses the words least. A source's last group is drawn
TRIES times at most, and the sample that is nearest to the target in words holds.

Only ids, sources and sizes are shuffled, never texts. Rows with one id, source and size are one unit with a count
(pre-aggregated, so a null id of many rows is no hot key), in pieces of PIECE rows; of n such rows, n times the
probability are taken but for one open row. Units are dealt by a hash into groups of some GROUP, whatever
the source's size, and a group's draws depend on its units alone: reruns agree, on any partitioning.

Null and empty texts have size 0 and take part in the balance of documents. A null source is a source. An empty
table has no rows. Repeated rows are documents of their own. Other columns may have any names. A text of any length
is counted is counted whole. A source's taken words miss its target by less than its last two documents' size.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Units of a group in which documents are balanced together, and rows of a unit.
GROUP, PIECE = 1024, 4096
#: Sources that a join may broadcast.
FEW = 10_000
#: What a probability may lack to 0 or 1.
SNAP = 1e-9
#: Draws of a source's last group at most, and the share of its target that a draw may miss to be the last.
TRIES, NEAR = 64, 1e-3


def sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """id, source and size of every document, without a shuffle."""
    prepare(docs.sparkSession)
    picked = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.split()) if t else 0 for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(n, pa.int64())], ["id", "source", "size"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, source string, size bigint")


def numbered(sources: DataFrame, name: str = "source") -> DataFrame:
    """Distinct sources with `number`, their place from 0 by code point, null last; sorted by range, never in one task."""
    line = sources.orderBy(F.col(name).isNull(), name).checkpoint()
    placed = line.withColumn("number", F.monotonically_increasing_id())
    part = F.shiftright("number", 33)
    counts = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, so_far = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(so_far)]
        so_far += n
    if not before:
        return placed
    return placed.withColumn("number", F.create_map(*before)[part] + F.col("number").bitwiseAND((1 << 33) - 1))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, and others) with `target`, in words."""
    if share > most:
        raise ValueError("the sources can't hold that share")
    n = F.col("number") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))
    known = numbered(sources).withColumn("__w", weight).checkpoint()
    whole = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    cap, w = most * F.col("source_size"), F.col("__w")
    level, full = 0.0, -1
    while True:  # the level of a unit of weight rises until no further source is full
        is_full = cap <= level * w if full >= 0 else F.lit(False)
        row = known.agg(F.count_if(is_full), F.sum(F.when(is_full, cap)), F.sum(F.when(~is_full, w))).first()
        if row[0] == full:
            break
        full = row[0]
        if not row[2]:
            break
        level = (whole - (row[1] or 0.0)) / row[2]
    return known.withColumn("target", F.least(cap, F.lit(level) * w)).drop("__w", "number")


def settle(size: list[int], p: list[float], draw: random.Random, land: bool) -> None:
    """Move the probabilities p to 0 or 1, in place; two stay open at most, none with land."""
    held: list[int] = []
    for i in range(len(size)):
        held.append(i)
        if len(held) == 3:
            a, b, c = held
            v = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            _move(p, held, v if any(v) else (1, -1, 0), draw)
            held = [j for j in held if 0.0 < p[j] < 1.0]
    if len(held) == 2 and size[held[0]] == size[held[1]]:
        _move(p, held, (1, -1), draw)
        held = [j for j in held if 0.0 < p[j] < 1.0]
    if land and held:
        _land(size, p, held, draw)


def _move(p: list[float], held: list[int], v: tuple, draw: random.Random) -> None:
    """Along v or against it, as far as all stay within 0 and 1; each in the mean as before."""
    ahead = [((1.0 - p[i]) / x if x > 0 else p[i] / -x, i, float(x > 0)) for i, x in zip(held, v, strict=True) if x]
    back = [(p[i] / x if x > 0 else (1.0 - p[i]) / -x, i, float(x < 0)) for i, x in zip(held, v, strict=True) if x]
    far, near = min(ahead), min(back)
    (step, first, end), sense = (far, 1) if draw.random() * (far[0] + near[0]) < near[0] else (near, -1)
    for i, x in zip(held, v, strict=True):
        q = p[i] + sense * step * x
        p[i] = 0.0 if q < SNAP else 1.0 if q > 1.0 - SNAP else q
    p[first] = end


def _land(size: list[int], p: list[float], held: list[int], draw: random.Random) -> None:
    """The last one or two: the law with their probabilities whose sample misses the words least in the mean."""
    if len(held) == 1:
        p[held[0]] = float(draw.random() < p[held[0]])
        return
    a, b = held

    def law(both: float) -> dict[tuple[int, int], float]:
        return {(1, 1): both, (1, 0): p[a] - both, (0, 1): p[b] - both, (0, 0): 1.0 - p[a] - p[b] + both}

    def miss(chances: dict) -> float:
        return sum(c * abs((x - p[a]) * size[a] + (y - p[b]) * size[b]) for (x, y), c in chances.items())

    best = min((law(max(0.0, p[a] + p[b] - 1.0)), law(min(p[a], p[b]))), key=miss)
    u = draw.random()
    for found, chance in best.items():
        u -= chance
        if u < 0:
            break
    p[a], p[b] = map(float, found)


def _flight(land: bool, seed: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("hash", "ascending"), ("piece", "ascending")])
        size, before = group.column("size").to_pylist(), group.column("p").to_pylist()
        draw = random.Random(f"{seed} {key[0].as_py()!r} {key[1].as_py()}")
        near, least = NEAR * group.column("target")[0].as_py(), math.inf
        for _ in range(TRIES if land else 1):
            drawn = list(before)
            settle(size, drawn, draw, land)
            miss = abs(sum(n * (x - y) for n, x, y in zip(size, drawn, before, strict=True)))
            if miss < least:
                p, least = drawn, miss
            if miss <= near:
                break
        took = [t + (x == 1.0) for t, x in zip(group.column("took").to_pylist(), p, strict=True)]
        left = [0.0 if x == 1.0 else x for x in p]
        names = group.column_names
        return group.set_column(names.index("took"), "took", pa.array(took, pa.int64())).set_column(names.index("p"), "p", pa.array(left, pa.float64()))

    return run


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, group: int = GROUP, seed: int = 0,
) -> DataFrame:
    """id (under its own name), size, source_size, target, taken: for each document the words that the mix takes of it."""
    counted = sizes(docs, doc_id, source, text).groupBy("id", "source", "size").agg(F.count("*").alias("n")).checkpoint()
    pieces = _ceil_div(F.col("n"), PIECE)
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(pieces).alias("units"))
    known = targets(sources, weights, share, most).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    known = known.select(F.col("source").alias("name"), "source_size", "target", "units", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("share")).checkpoint()
    side = F.broadcast(known) if known.count() <= FEW else known
    units = counted.join(side, F.col("source").eqNullSafe(F.col("name"))).withColumn("piece", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    units = units.withColumn("n", F.least(F.col("n") - F.col("piece") * PIECE, F.lit(PIECE)))
    expected = F.col("n") * F.col("share")
    near = F.round(expected)
    expected = F.when(F.abs(expected - near) < SNAP, near).otherwise(expected)
    units = units.select(
        "id", "source", "size", "n", "piece", "source_size", "target", "whole", F.xxhash64(F.lit(seed), F.col("id").cast("string"), "size", "piece").alias("hash"),
        F.floor(expected).cast("bigint").alias("took"), (expected - F.floor(expected)).alias("p"), _ceil_div(F.col("units"), group).alias("groups"),
    )
    settled, still, turn = units.where("p = 0"), units.where("p > 0"), 0
    while True:
        most_groups = still.agg(F.max("groups")).first()[0]
        if most_groups is None:
            break
        last = most_groups <= 1
        dealt = still.withColumn("g", F.pmod(F.xxhash64(F.lit(turn), "hash"), F.col("groups")))
        moved = dealt.groupBy("source", "g").applyInArrow(_flight(last, seed + turn), dealt.schema).drop("g").checkpoint()
        settled = settled.unionByName(moved.where("p = 0"))
        # A group leaves two open units at most.
        still = moved.where("p > 0").withColumn("groups", F.when(F.col("groups") > 1, _ceil_div(2 * F.col("groups"), group)).otherwise(1))
        turn += 1
    each = settled.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    taken = F.col("size") * (F.col("whole") + (F.col("i") <= F.col("took")).cast("bigint"))
    return each.select(F.col("id").alias(doc_id), "size", "source_size", "target", taken.cast("bigint").alias("taken"))
