"""Ranked lexical search with block-max pruning.

A document's terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. The index has a row for a range of documents: their ids and numbers of terms, one dictionary, and the
range cut into blocks of BLOCK documents. A block has a forward index (each document's terms and how often it
has them) and for each of its terms the most occurrences in one document and the fewest terms of a document that has it,
from which the highest score that a term can bring there follows for any statistics. Documents of like terms and of
like length are neighbours in a range (by the signs of the leading principal components of hashed counts, then by length):
a block of one language or subject has high maxima for its own terms alone.

A search reads the index three times: for the statistics of the items' terms (two totals, and partial sums of a count
for each term), for a first threshold (each item's best k scores in every range's block of the highest bound), and
for the ranking: an item sorts a range's blocks by the sum of its terms' maxima and scores through their forward
indexes until that bound falls below its k-th score so far or its threshold. A window merges the tasks' best.

Items are taken in parts with a bounded number of terms, and of items times terms (TERMS, CELLS); a part is what tasks
get by broadcast, and a larger set of items takes several passes over the index. An item above that is a part of its
own. The index is cut off by checkpoint(). Documents are never shuffled.

Null and empty texts and those without terms are no documents and items without results. Repeated rows are
documents and items of their own; equal scores are in the order of ids, null last. An empty table gives no
results. Texts of any length are indexed whole. Other columns may have any names. Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

BLOCK, RANGE = 64, 1024
#: Cells of hashed counts, and principal components, by which a range's documents are put together.
HASHED, AXES = 256, 3
#: Occurrences of terms in a range: a range ends before it has more, unless it is one document.
WORDS = 2_000_000
TERMS, CELLS = 250_000, 8_000_000
#: What no term has becomes a space, A-Z lower case.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
UNIT, SLOPE, BASE = 1_000_000_000, 75, 100
INDEX = "ids array<{}>, sizes binary, words binary, ends binary, terms binary, times binary, tops binary, top_ends binary, most binary, least binary, df binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def _small(values, kinds: tuple[str, ...] = ("<u1", "<u2", "<u4")) -> bytes:
    """Numbers as bytes, as narrow as the largest one allows; the first byte tells the width."""
    x = np.asarray(values, np.int64)
    most = int(x.max(initial=0))
    kind = next((k for k in kinds if most < 256 ** int(k[-1])), "<i8")
    return bytes([int(kind[-1])]) + x.astype(kind).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8" if b[0] == 8 else f"<u{b[0]}", offset=1).astype(np.int64)


def _together(found: list[tuple]) -> list[tuple]:
    """Documents (id, number of terms, term counts) in an order in which like ones are near."""
    if len(found) < 3:
        return found
    x = np.zeros((len(found), HASHED))
    for row, (_, n, counts) in zip(x, found, strict=True):
        np.add.at(row, [crc32(w) % HASHED for w in counts], np.fromiter(counts.values(), float, len(counts)) / n)
    x -= x.mean(axis=0)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES]
    cells = ((x @ axes) > 0) @ (1 << np.arange(AXES)[::-1])
    return [found[i] for i in np.lexsort((np.arange(len(found)), [n for _, n, _ in found], cells))]


def _range(found: list[tuple], block: int) -> tuple:
    """An index row of documents (id, number of terms, term counts)."""
    found = _together(found)
    words: dict[bytes, int] = {}
    terms, times, ends, tops, most, least, top_ends = [], [], [], [], [], [], []
    df: Counter = Counter()
    for start in range(0, len(found), block):
        high: dict[int, int] = {}
        low: dict[int, int] = {}
        for _, n, counts in found[start : start + block]:
            numbers = [words.setdefault(w, len(words)) for w in counts]
            terms += numbers
            times += counts.values()
            ends.append(len(terms))
            df.update(numbers)
            for t, c in zip(numbers, counts.values(), strict=True):
                if c > high.get(t, 0):
                    high[t] = c
                if n < low.get(t, n + 1):
                    low[t] = n
        tops += high
        most += high.values()
        least += low.values()
        top_ends.append(len(tops))
    columns = ([n for _, n, _ in found], ends, terms, times, tops, top_ends, most, least, [df[i] for i in range(len(words))])
    sizes, ends, *others = map(_small, columns)
    return [d[0] for d in found], sizes, b" ".join(words), ends, *others


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The index of all documents, a row for each range; the id's column is `ids`."""
    prepare(docs.sparkSession)
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    schema = INDEX.format(picked.schema["id"].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def row() -> pa.RecordBatch:
            ids, *others = _range(found, block)
            arrays = [pa.array([ids], pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in others)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if not (terms := terms_of(t)):
                    continue
                if len(found) == RANGE or found and held + len(terms) > WORDS:
                    yield row()
                    found, held = [], 0
                found.append((i, len(terms), Counter(terms)))
                held += len(terms)
        if found:
            yield row()

    return picked.mapInArrow(run, schema).checkpoint()


class Part:
    """Items with a bounded number of terms: ids of items, and their terms' counts."""

    def __init__(self) -> None:
        self.items: list[tuple] = []
        self.terms: dict[bytes, int] = {}

    def fits(self, counts: Counter) -> bool:
        n = len(self.terms) + sum(w not in self.terms for w in counts)
        return not self.items or (n <= TERMS and n * (len(self.items) + 1) <= CELLS)

    def add(self, item, counts: Counter) -> None:
        self.items.append((item, {self.terms.setdefault(w, len(self.terms)): c for w, c in counts.items()}))


def parts(items: DataFrame, item_id: str, text: str) -> Iterator[Part]:
    """The items in bounded parts; the driver holds one part at a time."""
    part = Part()
    for item, t in items.select(item_id, F.col(text).cast("string").cast("binary")).toLocalIterator():
        counts = Counter(terms_of(None if t is None else bytes(t)))
        if not counts:
            continue
        if not part.fits(counts):
            yield part
            part = Part()
        part.add(item, counts)
    if part.items:
        yield part


class Scorer:
    """What a task knows of a part: its terms' weights in each item, and the totals."""

    def __init__(self, terms: dict[bytes, int], weights: list[int], items: list[dict[int, int]], n_docs: int, n_terms: int, k: int, block: int):
        self.terms, self.n_docs, self.n_terms, self.k, self.block = terms, n_docs, n_terms, k, block
        exact = max((sum(weights[t] * c for t, c in counts.items()) for counts in items), default=0) * (UNIT // 1000) < 2**53
        self.kind = np.float64 if exact else np.int64  # sums of integers below 2**53 are exact in doubles
        self.w = np.zeros((len(items), len(terms)), self.kind)
        for i, counts in enumerate(items):
            for t, c in counts.items():
                self.w[i, t] = weights[t] * c
        self.scored = self.pruned = 0  # pairs of an item and a block

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        known = {int(n): BASE - SLOPE + SLOPE * int(n) * self.n_docs // self.n_terms for n in np.unique(sizes)}
        return np.array([known[int(n)] for n in sizes], np.int64)

    def opened(self, row: dict) -> "Ranged | None":
        """A row of the index with what this part has of it; None if that is nothing."""
        to = np.array([self.terms.get(w, -1) for w in row["words"].split(b" ")], np.int64)
        return Ranged(self, row, to) if (to >= 0).any() else None


class Ranged:
    """A range's blocks, and the bounds of all items on each."""

    def __init__(self, scorer: Scorer, row: dict, to: np.ndarray):
        self.s, self.ids, self.to = scorer, row["ids"], to
        self.m = scorer.lengths(_wide(row["sizes"]))
        self.ends = np.append(0, _wide(row["ends"]))
        self.row = row
        tops, ends = to[_wide(row["tops"])], _wide(row["top_ends"])
        block = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        most, least = _wide(row["most"]), _wide(row["least"])
        asked = tops >= 0
        high = np.zeros((len(ends), scorer.w.shape[1]), scorer.kind)
        high[block[asked], tops[asked]] = UNIT * most[asked] // (1000 * most[asked] + 8 * scorer.lengths(least[asked]))
        self.bounds = scorer.w @ high.T
        self.decoded: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, items: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of items (rows) and block b's documents, and those documents' places."""
        if self.decoded is None:
            self.decoded = self.to[_wide(self.row["terms"])], _wide(self.row["times"])
        terms, times = self.decoded
        first, end = b * self.s.block, min((b + 1) * self.s.block, len(self.m))
        a, z = self.ends[first], self.ends[end]
        doc = np.repeat(np.arange(end - first), np.diff(self.ends[first : end + 1]))
        own, tf = terms[a:z], times[a:z]
        asked = own >= 0
        own, tf, doc = own[asked], tf[asked], doc[asked]
        used, at = np.unique(own, return_inverse=True)
        d = np.zeros((len(used), end - first), self.s.kind)
        d[at, doc] = UNIT * tf // (1000 * tf + 8 * self.m[first:end][doc])
        return (self.s.w[np.ix_(items, used)] @ d).astype(np.int64), np.arange(first, end)


def _order(x) -> tuple:
    return (x is None, x)


class Best:
    """The k best (score, id) of each item."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.found = k, [[] for _ in range(n)]
        # Scores below it can't be among the best; only scores above 0 count.
        self.least = np.ones(n, np.int64) if floor is None else np.maximum(floor, 1)

    def offer(self, i: int, scores: np.ndarray, ids: list) -> None:
        both = self.found[i] + list(zip(scores.tolist(), ids, strict=True))
        both.sort(key=lambda x: (-x[0], _order(x[1])))
        self.found[i] = both[: self.k]
        if len(self.found[i]) == self.k:
            self.least[i] = max(self.least[i], self.found[i][-1][0])


def _rank(r: Ranged, best: Best, first_only: bool = False) -> None:
    """Every item takes the range's blocks by falling bound, until none may bring a score as high as its least."""
    order = np.argsort(-r.bounds, axis=1, kind="stable")
    active = np.arange(len(r.bounds))
    for turn in range(1 if first_only else order.shape[1]):
        b = order[active, turn]
        go = r.bounds[active, b] >= best.least[active]
        r.s.pruned += int((~go).sum()) * (order.shape[1] - turn)
        active, b = active[go], b[go]
        if not len(active):
            return
        r.s.scored += len(active)
        for at in np.unique(b):
            mine = active[b == at]
            scores, docs = r.scores(mine, int(at))
            good = scores >= best.least[mine][:, None]
            for i, s, g in zip(mine[good.any(axis=1)], scores[good.any(axis=1)], good[good.any(axis=1)], strict=True):
                best.offer(i, s[g], [r.ids[d] for d in docs[g]])


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """item_id, rank, doc_id, score (the ids under their own names): each item's k best documents with a score above 0."""
    return search(index(docs, doc_id, text, block), items, k, doc_id, item_id, text, block)


def search(indexed: DataFrame, items: DataFrame, k: int, doc_id: str, item_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """As rank, over an index made with the same size of blocks."""
    spark = indexed.sparkSession
    id_type = indexed.schema["ids"].dataType.elementType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item bigint, rank int, doc {id_type}, score bigint")
    names = spark.createDataFrame([], f"item bigint, name {item_type}")
    for number, part in enumerate(parts(items, item_id, text)):
        n_docs, n_terms, df = _statistics(indexed, part.terms)
        if not n_docs:
            break
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df]
        sent = spark.sparkContext.broadcast((part.terms, weights, [c for _, c in part.items], n_docs, n_terms, k, block))
        kth = Window.partitionBy("item").orderBy(F.desc("score"))
        first = _passed(indexed, sent, None, id_type).withColumn("r", F.row_number().over(kth)).where(F.col("r") == k)
        floor = np.ones(len(part.items), np.int64)
        for r in first.select("item", "score").collect():  # a row for each item of the part at most
            floor[r.item] = r.score
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        best = _passed(indexed, sent, floor, id_type).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        base = number << 32
        out = out.unionByName(best.select((F.col("item") + base).alias("item"), F.col("rank").cast("int").alias("rank"), "doc", "score"))
        own = [(base + i, name) for i, (name, _) in enumerate(part.items)]
        names = names.unionByName(spark.createDataFrame(own, f"item bigint, name {item_type}"))
    return out.join(names, "item").select(F.col("name").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def _statistics(indexed: DataFrame, terms: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """How many documents there are, how many terms they have, and in how many documents each of these terms is."""
    sent = indexed.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = sent.value, np.zeros(len(sent.value) + 2, np.int64)
        for batch in batches:
            for words, counts, sizes in zip(*(batch.column(c).to_pylist() for c in ("words", "df", "sizes")), strict=True):
                to = np.array([known.get(w, -1) for w in words.split(b" ")], np.int64)
                n[to[to >= 0]] += _wide(counts)[to >= 0]
                n[-2:] += len(_wide(sizes)), _wide(sizes).sum()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    found = [0] * (len(terms) + 2)
    sums = indexed.select("words", "df", "sizes").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # a row for each term of a part
        found[r["at"]] = r["n"]
    return found[-2], found[-1], found[:-2]


def _passed(indexed: DataFrame, sent, floor: np.ndarray | None, id_type: str) -> DataFrame:
    """item, doc, score: each task's best; without floor, from each range's block with the highest bound alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        best = Best(len(scorer.w), scorer.k, floor)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                if (r := scorer.opened(row)) is not None:
                    _rank(r, best, floor is None)
        flat = [(i, d, s) for i, found in enumerate(best.found) for s, d in found]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), kind, pa.int64()), strict=True)], ["item", "doc", "score"])

    return indexed.mapInArrow(run, f"item bigint, doc {id_type}, score bigint")
