"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has 64 bits; two texts are linked if their fingerprints differ in at most
`radius` bits, and a component is what links connect. The steps:

1. `fingerprints`: one pass over the texts, no shuffle.
2. `links`: equal fingerprints collapse first, so copies cost nothing more. With radius 2 and
   four 16-bit blocks, two fingerprints in reach agree on at least two whole blocks, so each
   distinct fingerprint goes to the six buckets of its block pairs. Buckets of one are dropped.
   A large bucket is dealt into chunks of bounded size, and each pair of chunks is a unit of work
   of its own, so no task ever holds a whole bucket.
3. In a unit the fingerprints lie as bit planes. A query's distances to all members advance plane
   by plane in carry-save counters, and the unit is left as soon as every member exceeds the radius.
   A unit returns a star per local component, not its pairs.
4. `components`: star contraction over the links.

Null and empty texts have the fingerprint zero, as texts without words do, and are linked like any
other. A null id takes part in its component but is never its smallest id. Repeated rows stay; an empty
table gives no rows. A text of any length is hashed whole. Columns other than id and text play no part,
whatever their names, and `keep_first` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, per_text, prepare, sliced, utf8

WIDTH, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a chunk of a bucket, on average.
CHUNK = 4096


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = utf8(text).lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        octets = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col and fingerprint, as a signed long, of each row."""

    def make():
        return lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return per_text(docs, [id_col], text_col, "fingerprint bigint", make)


def linked(queries: np.ndarray, planes: list[int], n: int, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """(query's place, bit set of the members within the radius), for queries that reach any member.

    ones and twos count modulo four; over holds the members known to be beyond three.
    """
    if radius != 2:
        raise ValueError("the counters are made for a radius of 2")
    full = (1 << n) - 1
    varied = [(b, p) for b, p in enumerate(planes) if p not in (0, full)]
    fixed = [(b, p == full) for b, p in enumerate(planes) if p in (0, full)]
    for k, q in enumerate(queries.tolist()):
        base = sum((q >> b & 1) != p for b, p in fixed)  # the same for all members
        if base > radius:
            continue
        ones, twos, over = (full if base & 1 else 0), (full if base & 2 else 0), 0
        for b, plane in varied:
            d = plane ^ full if q >> b & 1 else plane
            carry = ones & d
            ones ^= d
            over |= twos & carry
            twos ^= carry
            if over | (ones & twos) == full:
                break
        else:
            if hit := full & ~(over | (ones & twos)):
                yield k, hit


def unit_links(values: np.ndarray, chunk: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Star links among the distinct fingerprints of one unit; chunk i's members query chunk j's."""
    left = np.flatnonzero(chunk == i)
    right = left if i == j else np.flatnonzero(chunk == j)
    if not len(left) or not len(right):
        return []
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    unsigned = values.view(np.uint64)
    members = right.tolist()
    for k, hit in linked(unsigned[left], sliced(unsigned[right]), len(right)):
        a = find(int(left[k]))
        while hit:
            low = hit & -hit
            hit ^= low
            b = find(members[low.bit_length() - 1])
            if a != b:
                parent[b] = a
    groups: dict[int, list[int]] = {}
    for x in range(len(values)):
        groups.setdefault(find(x), []).append(int(values[x]))
    return [(x, g[0]) for g in groups.values() for x in g[1:]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, i, j); a unit that a batch cuts is carried over."""
    rest: pa.Table | None = None

    def flush(t: pa.Table, last: bool):
        cols = {c: t.column(c).to_numpy() for c in ("bucket", "i", "j", "c", "fingerprint")}
        n = t.num_rows
        new = np.flatnonzero(
            (cols["bucket"][1:] != cols["bucket"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])
        )
        cuts = [0, *(new + 1).tolist(), n]
        found: list[tuple[int, int]] = []
        for a, b in zip(cuts[: len(cuts) - 1 - (not last)], cuts[1:], strict=False):
            if b - a > 1:
                found += unit_links(np.ascontiguousarray(cols["fingerprint"][a:b]), cols["c"][a:b], int(cols["i"][a]), int(cols["j"][a]))
        return found, (None if last else t.slice(cuts[-2]))

    def out(found):
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        found, rest = flush((pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks(), False)
        yield out(found)
    if rest is not None:
        yield out(flush(rest.combine_chunks(), True)[0])


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Columns a, b: links whose components are those of all pairs within the radius.

    distinct has each fingerprint once, as a long.
    """
    prepare(distinct.sparkSession)

    def block(i: int) -> Column:
        return F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(F.lit(0xFFFF))

    buckets = [
        F.lit(n << 32).bitwiseOR(F.shiftleft(block(a), 16)).bitwiseOR(block(b))
        for n, (a, b) in enumerate(combinations(range(4), 2))
    ]
    rows = distinct.select("fingerprint", F.explode(F.array(*buckets)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    dealt = rows.join(sizes, "bucket").withColumn("c", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    units = dealt.select(
        "bucket", "fingerprint", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).select("bucket", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "fingerprint")
    units = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return units.mapInArrow(_units, "a bigint, b bigint").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of each row."""
    prepare(docs.sparkSession)
    marked = fingerprints(docs, id_col, text_col).checkpoint()
    firsts = marked.groupBy("fingerprint").agg(F.min(id_col).alias("first"))
    roots = connected_components(links(firsts.select("fingerprint")))
    rooted = firsts.join(roots, firsts["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Of repeated rows with that id one stays. Rows without an id can't be told apart by it and stay.
    """
    found = components(docs, id_col, text_col)
    key = F.col(id_col)
    chosen = found.where(key == F.col("component_id")).select(key.alias("kept")).distinct()
    rows = docs.select(key.alias("key"), F.xxhash64(text_col).alias("order"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(chosen, rows["key"] == chosen["kept"], "left_semi")
    # A partial aggregate, so that an id's repeated rows are never in one place.
    one = kept.groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return one.unionByName(docs.where(key.isNull()))
