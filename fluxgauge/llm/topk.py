"""Exact top-k by inner product, a block at a time.

Vectors have integer components, so a score is exact. They are dealt by a hash into tiles of bounded
size; a tile holds its vectors in an order that puts like ones together (by the signs of their leading
principal components), cut into blocks, with each component's largest and smallest value in the block,
its centre and its radius. A tile first answers its own queries, which gives each a k-th score that it
cannot do without. Then every tile of vectors, which is shuffled once, meets the tiles of queries, the
smaller side: a query orders the blocks by the highest score that they allow (the sum of its terms'
maxima, or what centre and radius allow if that is less), and scores block after block until that bound
falls below its k-th score. A last window merges the tiles' best.

Every row is a candidate for every query but itself, also rows with one id. Vectors that are null or
hold null or non-finite components take no part, nor do those without an id. Missing components of
shorter vectors count as 0. Ties go to the smaller id. Scores that could reach 2**48 raise an error.
An empty table has no results. Columns other than the two named play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

TILE, BLOCK = 16384, 256


def quantise(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * component) for each component, of the rows that take part."""
    x = F.col(vector_col)
    ok = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    return df.where(ok).select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))


def _together(m: np.ndarray) -> np.ndarray:
    """An order of a matrix's rows in which like ones are near: by the signs of their leading principal components."""
    if len(m) < 2 or not m.shape[1]:
        return np.arange(len(m))
    x = m - m.mean(axis=0)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : max(1, math.ceil(math.log2(max(2, len(m) / BLOCK))) + 1)]
    cells = ((x @ axes) > 0) @ (1 << np.arange(axes.shape[1])[::-1])
    return np.lexsort((np.arange(len(m)), x @ axes[:, 0], cells))


def _pack(key: tuple, group: pa.Table) -> pa.Table:
    """One row for a tile: ids, rows' numbers, number of components, and the matrix, like vectors together."""
    group = group.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    vectors = group.column("v").to_pylist()
    wide = max(map(len, vectors), default=0)
    m = np.zeros((len(vectors), wide), "<i8")
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    order = _together(m.astype(float))
    ids, rows = (group.column(c).to_numpy().astype("<i8")[order] for c in ("vec_id", "row"))
    return pa.table({
        "tile": pa.array([key[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "rows": [rows.tobytes()],
        "wide": pa.array([wide], pa.int32()), "m": [m[order].tobytes()],
    })


def tiles(vectors: DataFrame, n_tiles: int) -> DataFrame:
    """vectors (vec_id, v) in n_tiles rows: tile, ids, rows, wide, m."""
    dealt = vectors.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("vec_id", "row"), F.lit(n_tiles)).cast("int"))
    return dealt.groupBy("tile").applyInArrow(_pack, "tile int, ids binary, rows binary, wide int, m binary")


def _matrix(n: int, wide: int, m: bytes) -> np.ndarray:
    return np.frombuffer(m, "<i8").reshape(n, wide)


class Tile:
    """Vectors in blocks, with what bounds the scores of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, m: np.ndarray, block: int = BLOCK):
        self.ids, self.rows, self.m, self.block = ids, rows, m, block
        self.starts = np.arange(0, len(m), block)
        # Places in the order of ids, so that of equal scores the smaller id is the better.
        self.place = np.empty(len(m), np.int64)
        self.place[np.lexsort((rows, ids))] = np.arange(len(m))
        self.at = np.argsort(self.place)
        if len(m):
            self.high, self.low = np.maximum.reduceat(m, self.starts), np.minimum.reduceat(m, self.starts)
            sizes = np.diff(np.append(self.starts, len(m)))
            self.centre = np.add.reduceat(m, self.starts).astype(float) / sizes[:, None]
            far = np.linalg.norm(m - np.repeat(self.centre, sizes, axis=0), axis=1)
            self.radius = np.maximum.reduceat(far, self.starts)
        self.scored = self.pruned = 0  # pairs of a query and a block

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query the highest score that each block allows."""
        maxima = np.maximum(q, 0) @ self.high.T.astype(float) + np.minimum(q, 0) @ self.low.T.astype(float)
        ball = q @ self.centre.T + np.linalg.norm(q, axis=1)[:, None] * self.radius
        # A little more, for what floating point may lose.
        return np.floor(np.minimum(maxima, ball * (1 + 1e-9) + 1)).astype(np.int64) + 1

    def best(self, rows: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> np.ndarray:
        """Keys of the k best of this tile for each query (numbers of the queries' own rows, vectors); NONE where there are fewer.

        A key is score * n - place: a larger one is a better vector. With floor, scores below it may be left out.
        """
        n = len(self.m)
        top = np.full((len(q), k), NONE)
        if not n or not len(q):
            return top
        wide = min(q.shape[1], self.m.shape[1])
        q = np.pad(q, ((0, 0), (0, self.m.shape[1] - wide))) if wide < self.m.shape[1] else q[:, :wide]
        most = float(np.abs(q).max(initial=0)) * float(np.abs(self.m).max(initial=0)) * max(1, wide)
        if most >= 2**48:
            raise ValueError("scores of 2**48 and more don't fit")
        kind = np.float32 if most < 2**24 else np.float64
        bound = self.bounds(q.astype(float))
        q, d = q.astype(kind), self.m.astype(kind)
        least = np.full(len(q), NONE // n) if floor is None else np.maximum(floor, NONE // n)
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(q))
        for r in range(len(self.starts)):
            b = order[active, r]
            kth = np.maximum(-(-top[active, 0] // n), least[active])  # the smallest of the k
            # An equal bound may still bring an equal score with a smaller id.
            go = bound[active, b] >= kth
            self.pruned += int((~go).sum()) * (len(self.starts) - r)
            active, b = active[go], b[go]
            if not len(active):
                break
            self.scored += len(active)
            for at in np.unique(b):
                mine = active[b == at]
                a, z = self.starts[at], min(self.starts[at] + self.block, n)
                keys = (q[mine] @ d[a:z].T).astype(np.int64) * n - self.place[a:z]
                keys[rows[mine][:, None] == self.rows[a:z][None, :]] = NONE
                both = np.concatenate((top[mine], keys), axis=1)
                both.partition(both.shape[1] - k, axis=1)
                kept = both[:, -k:]
                kept.sort(axis=1)
                top[mine] = kept
        return top

    def scores(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of keys."""
        n = len(self.m)
        scores = -((-keys) // n)
        return self.ids[self.at[scores * n - keys]], scores


#: No key.
NONE = np.int64(-1 << 62)


def search(vectors: DataFrame, k: int = 20, every: int = 20, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best others."""
    prepare(vectors.sparkSession)
    n_tiles = max(1, math.ceil(vectors.count() / tile))
    packed = tiles(vectors, n_tiles).checkpoint()

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Tile]]:
        names = ("tile", "ids", "rows", "wide", "m")
        for t, ids, rows, wide, m in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            i = np.frombuffer(ids, "<i8")
            yield t, Tile(i, np.frombuffer(rows, "<i8"), _matrix(len(i), wide, m))

    def queries(batches):
        for batch in batches:
            for t, own in opened(batch):
                mine = np.flatnonzero(own.ids % every == 0)
                if len(mine):
                    top = own.best(own.rows[mine], own.m[mine], k)[:, 0]
                    floor = np.where(top == NONE, np.iinfo(np.int64).min, -(-top // len(own.m)))
                    parts = (own.ids[mine], own.rows[mine], floor, own.m[mine])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t], pa.int32()), pa.array([own.m.shape[1]], pa.int32()), *(pa.array([x.astype("<i8").tobytes()]) for x in parts)],
                        ["q_tile", "wide", "ids", "rows", "floor", "m"],
                    )

    def score(batches):
        own: Tile | None = None
        for batch in batches:
            names = ("q_tile", "ids", "rows", "floor", "wide", "m")
            for t, ids, rows, floor, wide, m in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                i, r = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
                x = _matrix(len(i), wide, m)
                if t < 0:  # the tile's vectors come before its queries
                    own = Tile(i, r, x)
                    continue
                top = own.best(r, x, k, np.frombuffer(floor, "<i8"))
                row, col = np.nonzero(top != NONE)
                found, scores = own.scores(top[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(i[row]), pa.array(r[row]), pa.array(found), pa.array(scores)], ["query_id", "row", "vec_id", "score"])

    asked = packed.mapInArrow(queries, "q_tile int, wide int, ids binary, rows binary, floor binary, m binary")
    names = ("tile", "q_tile", "ids", "rows", "floor", "wide", "m")
    sent = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).select(*names)
    held = packed.withColumns({"q_tile": F.lit(-1), "floor": F.lit(None).cast("binary")}).select(*names)
    met = held.unionByName(sent).repartition(n_tiles, "tile").sortWithinPartitions("tile", "q_tile")
    found = met.mapInArrow(score, "query_id bigint, row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
