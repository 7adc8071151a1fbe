"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words and one end. It is coded as a stream of bytes, each word with a space after it
and a line feed for the end; each byte is a path of bits in a Huffman tree. For every bit of every
token four hashed contexts predict:

* the last three bytes of the stream, and the word so far; each has a table that counts the zeros and
  ones of all training texts in its slots, and its log odds are an input of a logistic mixer;
* the two words before: the word that followed them most often in all training texts predicts the
  bits as long as it agrees, with the odds by which words as sure as it have been right;
* the word so far in the text itself: what followed when a word of this text last began so.

The mixer's weights are gated by how sure the last two are; an adaptive map refines its output. The sum
over bits is the text's log probability, which bits_per_byte gives too.

The work, on Spark:

1. Texts, as compressed tokens, are dealt into batches by hashes of id and text and partition, so that a
   repeated task deals alike. A batch sends the distinct (two words before, word) of its texts and its distinct words with
   their counts to shards of the hash space; so a frequent phrase is one row of each batch. What is
   gathered here grows with the input, and so does the number of shards.
2. A shard adds up the counts of all training texts and answers: the word's count, and the following
   word that is predicted, of which a training text's own occurrence is left out. Batches meet their
   answers in a cogroup, and the coded streams with the answers are checkpointed.
3. `train`: learners of some `LEARNER` bytes each go through their training texts online: predict a
   slice, then learn from it (tables, weights, map). Within `UNIT` bytes, and no more than were learned before, bytes
   with the same contexts and guesses are one, with the number of times they occur; so it is in scoring. The tables' counts add up exactly over learners in
   a shuffle by table block; weights are averaged in proportion to the bits seen. What goes to the
   driver and out again is one table set, whose size is a parameter.
4. `score`: one pass over the checkpointed streams with the model.

base_score is the smoothed unigram score from the same counts. Null and empty texts have the end
alone. Rows without an id are held out. Repeated rows, and equal texts, get equal scores but for the
training texts' own occurrences. Columns other than id and text play no part, whatever their names.
Ids may be of any type. An empty table gives no rows. Without training texts all counts are 0 and
every bit costs one bit. A text of any length is coded whole, some `PIECE` bytes at a time; a single
word is held whole. The predicted following word reaches over a word's first four bytes; what the text itself predicts over all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from .common import prepare, utf8

END = b"\n"
SPACE, FEED = 32, 10
TABLE_BITS = 21
BLOCK_BITS = 13
CONTEXTS = ("three bytes", "word so far")
#: How sure a predicted byte is (0: there is none; else by counts, and by whether all was as predicted).
SURE = 11
GATES = 2 * SURE - 1
#: Guesses: by the two words before, and by the text so far.
GUESSES = 2
#: Places in a word that the predicted word's record tells apart.
PLACES = 4
#: Bytes of text in a batch, in a shard's share and in a learner's, about; and coded and learned at once.
BATCH, SHARD, LEARNER = 1 << 22, 1 << 23, 1 << 25
PIECE, SLICE = 1 << 18, 1 << 14
#: Bytes among which those with the same contexts and guesses are priced and learned once.
UNIT = 1 << 21
#: The depth of no byte's path.
NEVER = 255
DELTA, RATE, STEPS = 0.4, 0.05, 33
_PHI, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of the following word that are gathered and predicted.
LETTERS = 4
_ONE = np.array([1, 1 << 32], np.uint64)
_LOW, _HIGH, _DELTA = np.uint64(2**32 - 1), np.uint64(32), np.float32(DELTA)


def training(id_col: str = "doc_id") -> Column:
    """Rows that are learned from: crc32(id as text) mod 5 is not 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words, ASCII letters in lower case, and the end."""
    return [*utf8(text).lower().split(), END]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _PHI
    return h


# --- Bytes, words and contexts of a stream.


class Code:
    """Huffman code of bytes: for each the nodes and bits of its path."""

    def __init__(self, weights: np.ndarray):
        heap = [(int(w) + 1, b, b) for b, w in enumerate(weights)]  # every byte has a path
        heapq.heapify(heap)
        kids: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids[node] = a[2], b[2]
            heapq.heappush(heap, (a[0] + b[0], node, node))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo: list[tuple[int, list]] = [(510, [])]
        while todo:
            node, path = todo.pop()
            if node < 256:
                paths[node] = path
            else:
                todo += [(kid, [*path, (node - 255, bit)]) for bit, kid in enumerate(kids[node])]
        self.length = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([n for p in paths for n, _ in p], np.uint32) * np.uint32(0x9E3779B1)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        depth = np.concatenate([np.arange(len(p), dtype=np.uint64) for p in paths])
        #: All of them in one number: node, depth, bit.
        self.step = self.node.astype(np.uint64) | depth << np.uint64(32) | self.bit.astype(np.uint64) << np.uint64(48)
        bits = [[b for _, b in p] for p in paths]
        common = [[next((d for d, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x)) for y in bits] for x in bits]
        #: Of a byte and a guess, 256 times the one and the other: the depth until which the guess is live, NEVER if it is the byte.
        self.until = np.where(np.eye(256, dtype=bool), NEVER, np.array(common) + 1).astype(np.uint8).ravel()


class Words:
    """Where a stream's tokens begin and end, and their hashes."""

    def __init__(self, octets: np.ndarray):
        self.octets = octets
        self.end = np.flatnonzero((octets == SPACE) | (octets == FEED))
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        n = len(self.end)
        self.new_text = np.concatenate(([True], octets[self.end[:-1]] == FEED)) if n else np.empty(0, bool)

    @cached_property
    def hash(self) -> np.ndarray:
        out = np.empty(len(self.end), np.uint64)
        for i, j in self.pieces():
            a, b = self.start[i], self.end[j - 1] + 1
            out[i:j] = _so_far(self.octets[a:b], self.start[i:j] - a, self.end[i:j] - a)[1]
        return out

    def pieces(self, size: int = PIECE) -> Iterator[tuple[int, int]]:
        """Runs of tokens: whole texts of about `size` bytes, or as much of a longer text, cut from its start on."""
        first = np.append(np.flatnonzero(self.new_text), len(self.end))
        k = 0
        while k < len(first) - 1:
            near = np.searchsorted(self.start, self.start[first[k]] + size)
            last = int(np.searchsorted(first, near, "right")) - 1
            if last > k:
                yield int(first[k]), int(first[last])
                k = last
                continue
            i, stop = int(first[k]), int(first[k + 1])
            while i < stop:
                j = min(stop, max(i + 1, int(np.searchsorted(self.start, self.start[i] + size))))
                yield i, j
                i = j
            k += 1

    def before(self, k: int) -> np.ndarray:
        """The hash of the k-th token before each, 0 before the text."""
        out = np.zeros(len(self.hash), np.uint64)
        out[k:] = self.hash[:-k]
        for d in range(k):
            late = np.zeros(len(out), bool)
            late[d:] = self.new_text[: len(out) - d]
            out[late] = 0
        return out

    def letters(self) -> np.ndarray:
        """Each token's first LETTERS bytes as a number, zeros after its end."""
        out = np.zeros(len(self.end), np.uint64)
        for k in range(LETTERS):
            here = np.where(self.start + k <= self.end, self.octets.take(self.start + k, mode="clip"), 0)
            out = out << np.uint64(8) | here.astype(np.uint64)
        return out

    def keys(self, bits: int) -> np.ndarray:
        """Each token's context of two words before, as a number of so many bits."""
        return _mixed(_mixed(self.before(1)) + self.before(2)) >> np.uint64(64 - bits)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n), _PHI))))


def _so_far(o: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For bytes of whole tokens: a hash of the token before each byte, the tokens' hashes, and each byte's place in its token."""
    size = end - start + 1
    place = np.arange(len(o)) - np.repeat(start, size)
    x = (o.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max(initial=0))).take(place)
    run = np.cumsum(x)
    before = run[start] - x[start]
    out = _mixed(run[end] - before)
    run -= x
    run -= np.repeat(before, size)
    return run, out, place


@dataclass
class Bytes:
    """Bytes, each with all that its price depends on."""

    word: np.ndarray  # a hash of the word so far
    #: From the lowest: three bytes before (the nearest highest) and the byte itself; of each guess the depth until which
    #: it is live and how sure it is (0: none is made); the place in the word.
    rest: np.ndarray

    def at(self, s: slice) -> Bytes:
        return Bytes(self.word[s], self.rest[s])

    def distinct(self, table_bits: int) -> tuple[Bytes, np.ndarray, np.ndarray]:
        """Those that differ, how often each occurs, and the places of its occurrences, one after the other.

        They come in the order of the word's places in its table, so that neighbours are read together.
        """
        n = len(self.word)
        low = max(1, n - 1).bit_length()
        up = np.uint64(32 - table_bits)
        both = _mixed(self.rest)
        both >>= np.uint64(table_bits)
        both ^= self.word << up
        both >>= np.uint64(low)
        both <<= np.uint64(low)
        both |= np.arange(n, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << low) - 1)).view(np.int64)
        word, rest = self.word.take(order), self.rest.take(order)
        new = np.ones(n, bool)
        new[1:] = (word[1:] != word[:-1]) | (rest[1:] != rest[:-1])
        first = np.flatnonzero(new)
        return Bytes(word.take(first), rest.take(first)), np.diff(first, append=n), order


def _guess(until: np.ndarray, sure: np.ndarray) -> np.ndarray:
    return sure.astype(np.uint16) << np.uint16(8) | until


def contexts(octets: np.ndarray, w: Words, info: np.ndarray, i: int, j: int, code: Code) -> Bytes:
    """The bytes of tokens i to j, for each its contexts, and what the words before and the text itself predict."""
    lead = max(0, i - 2)
    a, b = w.start[lead], w.end[j - 1] + 1
    o = octets[a:b]
    start, end = w.start[lead:j] - a, w.end[lead:j] - a
    word, _, place = _so_far(o, start, end)
    word += place.astype(np.uint64)
    word = _mixed(word)
    # The three bytes before, line feeds before a text begins.
    back, first = np.full(len(o) + 3, FEED, np.uint8), start[w.new_text[lead:j]]
    back[3:] = o
    four = np.ndarray(len(o), "<u4", back, strides=(1,)).astype(np.uint32)
    for d in range(3):
        late = (first + d)[first + d < len(o)]
        mask = (1 << 8 * (3 - d)) - 1
        four[late] = four[late] & np.uint32(2**32 - 1 - mask) | np.uint32(0x0A0A0A & mask)
    skip = w.start[i] - a
    o, four, word, place = o[skip:], four[skip:], word[skip:], np.minimum(place[skip:], PLACES - 1).astype(np.uint8)
    start, end, new = start[i - lead :] - skip, end[i - lead :] - skip, w.new_text[i:j]
    rest = place.astype(np.uint64) << np.uint64(56)
    follower = np.zeros(len(o), np.uint16)
    agree, byte, sure = info[i:j].T
    some = np.flatnonzero(sure)
    for k in range(LETTERS):
        some = some[(agree[some] >= k) & (start[some] + k <= end[some])]
        at = start[some] + k
        until = np.where(agree[some] > k, np.uint8(NEVER), code.until.take(o[at].astype(np.intp) << 8 | byte[some]))
        follower[at] = _guess(until, sure[some])
    own = word + np.repeat(np.cumsum(new).astype(np.uint64) * _PHI, end - start + 1)
    rest |= four
    for k, guess in enumerate((follower, _repeated(o, own, code))):
        rest |= guess.astype(np.uint64) << np.uint64(32 + 12 * k)
    return Bytes(word, rest)


def _repeated(o: np.ndarray, key: np.ndarray, code: Code) -> np.ndarray:
    """The guess that what followed the last time the same word began so in this text follows again."""
    n = len(o)
    low = np.uint64(max(1, n - 1).bit_length())
    order = key >> low  # hashes already
    order <<= low
    order |= np.arange(n, dtype=np.uint64)
    order.sort()
    at = (order & ((np.uint64(1) << low) - np.uint64(1))).astype(np.intp)
    order >>= low
    new = np.concatenate(([True], order[1:] != order[:-1])) if n else np.empty(0, bool)
    places = np.arange(n, dtype=np.int32)
    rank = places - np.maximum.accumulate(np.where(new, places, np.int32(0)))
    byte = o[at]
    # The byte before and that before it in this order; a run's first has none, its second has one.
    past, again = byte.copy(), np.zeros(n, np.uint8)
    past[1:] = byte[:-1]
    again[2:] = byte[1:-1] == byte[:-2]
    sure = _RANKS.take(2 * np.minimum(rank, np.int32(27)) + again)
    found = _guess(code.until.take(byte.astype(np.uint16) << np.uint16(8) | past), sure)
    found[new] = 0
    out = np.empty(n, np.uint16)
    out[at] = found
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """0 to 5: nothing, then 1, 2, 4, 9 and 27 or more."""
    return (n > 0).astype(np.int64) + (n > 1) + (n > 3) + (n > 8) + (n > 26)


#: How sure the text itself is after 0 to 27 or more occurrences, the last two of which differ or not.
_RANKS = np.array([max(0, 2 * int(_level(np.array(n))) - 1 + (k if n > 1 else 0)) for n in range(28) for k in (0, 1)], np.uint8)


# --- The mixer.


@dataclass
class Bits:
    """The bits of a slice: places in the tables, the bit, its byte, and the guesses' parts."""

    slots: list[np.ndarray]
    bit: np.ndarray
    byte: np.ndarray
    start: np.ndarray  # of each byte's bits
    sure: list[np.ndarray]
    cell: list[np.ndarray]  # four times that of the guess's record, and 2 if the guessed bit is the bit, and the bit


def expand(b: Bytes, code: Code, table_bits: int) -> Bits:
    four = b.rest.astype(np.uint32)
    o = four >> np.uint32(24)
    lengths = code.length.take(o)
    start = np.cumsum(lengths) - lengths
    byte = np.repeat(np.arange(len(o)), lengths)
    path = (code.start.take(o) - start).take(byte)
    path += np.arange(len(byte))
    steps = code.step.take(path)
    parts = steps.view(np.uint16).reshape(-1, 4)
    depth, bit = np.ascontiguousarray(parts[:, 2]), parts[:, 3].astype(np.uint8)
    node = steps.astype(np.uint32)
    mask = np.uint32((1 << table_bits) - 1)
    three = _mixed((four & np.uint32(0xFFFFFF)).astype(np.uint64))
    slots = [(((h >> np.uint64(32)).astype(np.uint32).take(byte) + node) & mask).astype(np.intp) for h in (three, b.word)]
    out = Bits(slots, bit, byte, start, [], [])
    place = (b.rest >> np.uint64(54)).astype(np.uint8)
    depth = depth.astype(np.uint8)
    for k in range(GUESSES):
        g = (b.rest >> np.uint64(32 + 12 * k)).astype(np.uint16)
        # A guess is live until its path and the byte's part; one that is the byte itself never errs.
        sure = (g >> np.uint16(8)).astype(np.uint8) & np.uint8(15)
        cell = np.uint8(4 * PLACES) * sure + (place & np.uint8(12))
        until = g.astype(np.uint8).take(byte)
        live = depth < until
        out.sure.append(sure.take(byte) * live)
        right = (depth + np.uint8(1) < until).view(np.uint8)
        out.cell.append((cell.take(byte) * live + (right << np.uint8(1)) + bit).astype(np.intp))
    return out


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _step(z: np.ndarray) -> np.ndarray:
    return ((np.clip(z, -8, 8) + np.float32(8)) * np.float32((STEPS - 1) / 16) + np.float32(0.5)).astype(np.intp)


def _by_cell(odds: np.ndarray) -> np.ndarray:
    """Log odds of a one for each of a guess's cells in Bits: those of its being right, turned by its bit."""
    return odds.reshape(-1, 2)[:, [1, 0, 0, 1]].ravel()


#: Of 16 times the one's and the other's sureness: the gate, that of the words before, or else of the text itself.
_GATES = np.array([a or (b and b + SURE - 1) for a in range(16) for b in range(16)])


def _gate(e: Bits) -> np.ndarray:
    return _GATES.take(e.sure[0] << np.uint8(4) | e.sure[1])


def _record_odds(record: np.ndarray) -> np.ndarray:
    """Log odds of each guess's cells, for a guessed zero and one; none for cell 0, which no guess has."""
    out = np.log((record[..., 1] + DELTA) / (record[..., 0] + DELTA)).astype(np.float32)
    out[:, :PLACES] = 0
    return np.stack((-out, out), axis=2).reshape(GUESSES, -1)


def _cut(b: Bytes, code: Code, table_bits: int) -> Iterator[tuple[slice, Bits]]:
    for k in range(0, len(b.word), SLICE):
        s = slice(k, min(k + SLICE, len(b.word)))
        yield s, expand(b.at(s), code, table_bits)


def _slices(octets: np.ndarray, w: Words, info: np.ndarray, i: int, j: int, code: Code, table_bits: int) -> Iterator[tuple[slice, Bits]]:
    """Every byte of tokens i to j, in their order."""
    yield from _cut(contexts(octets, w, info, i, j, code), code, table_bits)


def _joined(parts: list[Bytes]) -> Bytes:
    return Bytes(np.concatenate([b.word for b in parts]), np.concatenate([b.rest for b in parts]))


def _units(octets: np.ndarray, w: Words, info: np.ndarray, code: Code) -> Iterator[tuple[int, int, Bytes]]:
    """Runs of tokens of about UNIT bytes, and their bytes."""
    parts: list[Bytes] = []
    begin, size = 0, 0
    for i, j in w.pieces():
        parts.append(contexts(octets, w, info, i, j, code))
        size += len(parts[-1].word)
        if size >= UNIT or j == len(w.end):
            yield begin, j, _joined(parts)
            parts, begin, size = [], j, 0


@dataclass
class Model:
    """Log odds of each table's slots and of the guesses' cells, weights and map."""

    code: Code
    table_bits: int
    odds: list[np.ndarray]
    record: np.ndarray
    weights: np.ndarray  # input x gate
    map: np.ndarray

    def log10_bits(self, e: Bits) -> np.ndarray:
        """Log probability of each bit."""
        gate = _gate(e)
        inputs = [t.take(x) for t, x in zip(self.odds, e.slots, strict=True)] + [_by_cell(r).take(x) for r, x in zip(self.record, e.cell, strict=True)]
        z = sum(w.take(gate) * x for w, x in zip(self.weights, inputs, strict=True))
        p = (_squash(z) + self.map.take(gate * STEPS + _step(z))) / 2
        p = np.where(e.bit, p, 1 - p)
        return np.log(np.clip(p, 1e-7, 1 - 1e-7)) * np.float32(1 / math.log(10))

    def score(self, octets: np.ndarray, info: np.ndarray) -> np.ndarray:
        """Log probability of each text of a stream."""
        w = Words(octets)
        texts = np.cumsum(w.new_text) - 1
        out = np.zeros(int(texts[-1]) + 1 if len(texts) else 0)
        for i, j, found in _units(octets, w, info, self.code):
            some, times, order = found.distinct(self.table_bits)
            lp = np.concatenate([np.add.reduceat(self.log10_bits(e), e.start, dtype=np.float64) for _, e in _cut(some, self.code, self.table_bits)])
            each = np.empty(len(order), np.float32)
            each[order] = np.repeat(lp.astype(np.float32), times)
            first = np.concatenate(([0], w.start[i + 1 : j][w.new_text[i + 1 : j]] - w.start[i]))
            out[texts[i] : texts[j - 1] + 1] += np.add.reduceat(each, first, dtype=np.float64)
        return out


class Learner:
    """One task's tables, weights and map: it predicts a slice and then learns from it."""

    def __init__(self, code: Code, table_bits: int):
        self.code, self.table_bits = code, table_bits
        # Numbers of zeros and ones of a slot, in the halves of one number.
        self.tables = [np.zeros(1 << table_bits, np.uint64) for _ in CONTEXTS]
        self.weights = np.tile(np.array([0.3, 0.3, 0.5, 0.5]), (GATES, 1))
        self.slopes = np.zeros(self.weights.shape)
        self.record = np.zeros((GUESSES, SURE * PLACES, 2))  # wrong, right
        self.map = np.zeros((GATES * STEPS, 2))
        self.seen = 0  # bytes

    @property
    def bits(self) -> np.ndarray:
        """How many bits each gate has had."""
        return self.map.reshape(GATES, -1).sum(axis=1)

    def learn(self, octets: np.ndarray, info: np.ndarray, mine: np.ndarray) -> None:
        """A stream's texts, of those that mine marks, in their order."""
        if not mine.any():
            return
        if not mine.all():
            ends = np.flatnonzero((octets == SPACE) | (octets == FEED))
            last = np.flatnonzero(octets[ends] == FEED)
            keep = np.repeat(mine, np.diff(last, prepend=-1))
            octets, info = octets[np.repeat(mine, np.diff(ends[last], prepend=-1))], info[keep]
        w = Words(octets)
        parts: list[Bytes] = []
        size = 0
        for i, j in w.pieces():
            if self.seen < PIECE:  # little comes twice
                for s, e in _slices(octets, w, info, i, j, self.code, self.table_bits):
                    self.step(e, np.ones(s.stop - s.start, np.float32))
                    self.seen += s.stop - s.start
                continue
            parts.append(contexts(octets, w, info, i, j, self.code))
            size += len(parts[-1].word)
            # No more at once than was learned before, so that what predicts is never much behind.
            if size >= min(UNIT, self.seen) or j == len(w.end):
                some, times, _ = _joined(parts).distinct(self.table_bits)
                for s, e in _cut(some, self.code, self.table_bits):
                    self.step(e, times[s].astype(np.float32))
                self.seen += size
                parts, size = [], 0

    def step(self, e: Bits, times: np.ndarray) -> None:
        """Predict a slice, then learn from it; its bytes occur so many times each."""
        times = times.take(e.byte)
        odds = []
        for t, x in zip(self.tables, e.slots, strict=True):
            n = t.take(x)
            zeros, ones = (n & _LOW).astype(np.float32), (n >> _HIGH).astype(np.float32)
            odds.append(np.log((ones + _DELTA) / (zeros + _DELTA)))
        gate = _gate(e)
        odds += [_by_cell(r).take(x) for r, x in zip(_record_odds(self.record), e.cell, strict=True)]
        weights = self.weights.T.astype(np.float32, order="C")
        z = sum(w.take(gate) * x for w, x in zip(weights, odds, strict=True))
        wrong = (e.bit - _squash(z)) * times
        for j, x in enumerate(odds):
            slope = np.bincount(gate, wrong * x, GATES)
            self.slopes[:, j] += slope**2
            self.weights[:, j] += RATE * slope / np.sqrt(self.slopes[:, j] + 1)
        cell = 2 * (gate * STEPS + _step(z)) + e.bit
        self.map += np.bincount(cell, times, self.map.size).reshape(self.map.shape)
        for r, x in zip(self.record, e.cell, strict=True):
            r += np.bincount(x, times, 2 * r.size).reshape(*r.shape, 2).sum(axis=2)
        one = _ONE.take(e.bit) * times.astype(np.uint64)
        for t, x in zip(self.tables, e.slots, strict=True):
            np.add.at(t, x, one)


# --- What the corpus gathers: words' counts, and the words that follow two others.


def _packed(x: np.ndarray, octets: int) -> bytes:
    """The lowest octets of each number, plane by plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :octets].T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes, octets: int, n: int) -> np.ndarray:
    p = np.frombuffer(pa.decompress(data, n * octets, "zstd"), np.uint8).reshape(octets, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :octets] = p.T
    return out.reshape(-1).view("<u8")


@dataclass
class Asked:
    """What a batch asks: its distinct (key, first letters) in the order of keys, and its distinct words in that of hashes."""

    octets: np.ndarray
    words: Words
    mine: np.ndarray  # texts that are learned from
    text: np.ndarray  # of each token
    key: np.ndarray
    follower: np.ndarray
    n: np.ndarray  # twice the occurrences in training texts, and 1 if other texts have it
    inverse: np.ndarray
    word: np.ndarray  # a token of each distinct word
    word_n: np.ndarray  # occurrences in training texts
    word_inverse: np.ndarray


def _order(x: np.ndarray, bits: int, *then: np.ndarray) -> np.ndarray:
    """Places in the order of x, numbers of so many bits, and where x are equal in that of `then`.

    One sort of numbers that carry their places; only what is together in the leading bits is sorted again.
    """
    n = len(x)
    low = max(1, n - 1).bit_length()
    if n:  # a shard's keys begin alike
        x = x - x.min()
        bits = min(bits, max(1, int(x.max()).bit_length()))
    both = x << np.uint64(64 - bits)
    both >>= np.uint64(low)
    both <<= np.uint64(low)
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << low) - 1)).astype(np.int64)
    if then and n:
        new = np.ones(n + 1, bool)
        new[1:-1] = (both[1:] ^ both[:-1]) >> np.uint64(low) != 0
        again = np.flatnonzero(~(new[:-1] & new[1:]))
        if len(again):
            some = order[again]
            order[again] = some[np.lexsort((*(y[some] for y in reversed(then)), x[some]))]
    return order


def _distinct(order: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each run of equal values in an order, and each place's run."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in of:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def key_bits(size: int) -> int:
    """Bits of a context in a corpus of so many bytes: few of those that a shard has fall together."""
    return min(64, max(40, 10 + size.bit_length()))


def _asked(batch: pa.Table, bits: int) -> Asked:
    packed = zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), strict=True)
    octets = np.frombuffer(b"".join([pa.decompress(t, n, "zstd", asbytes=True) for t, n in packed]), np.uint8)
    mine = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
    w = Words(octets)
    text = np.cumsum(w.new_text) - 1
    weight = mine[text]
    key = w.keys(bits)
    letters = w.letters()
    at, inverse = _distinct(_order(key, bits, letters), key, letters)
    # Words whose hashes begin alike may come twice, which changes no sum.
    word, word_inverse = _distinct(_order(w.hash, 64), w.hash)
    return Asked(
        octets, w, mine, text, key[at], letters[at],
        2 * np.bincount(inverse, weight, len(at)).astype(np.int64) + (np.bincount(inverse, ~weight, len(at)) > 0), inverse,
        word, np.bincount(word_inverse, weight, len(word)).astype(np.int64), word_inverse,
    )


def _cuts(x: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted numbers of so many bits begins."""
    of = (x >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))


ASK = "b bigint, shard bigint, n_keys bigint, key binary, follower binary, n binary, n_words bigint, n_letters bigint, words binary, counts binary"
ANSWER = "b bigint, shard bigint, held binary, own binary, counts binary, fresh bigint"
SCORED = "held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, length bigint"
PREPARED = (
    "held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, sums array<double>, size bigint, stream binary, "
    "info binary, n_train bigint, fresh bigint, octets array<bigint>"
)


def _ask(shards: int, bits: int):
    def run(key: tuple, batch: pa.Table) -> pa.Table:
        a = _asked(_ordered(batch), bits)
        w = a.words
        hashes, starts, ends = w.hash[a.word], w.start[a.word].tolist(), (w.end[a.word] + 1).tolist()
        keys, words = _cuts(a.key, bits, shards), _cuts(hashes, 64, shards)
        raw = a.octets.tobytes()
        rows = []
        for s in np.flatnonzero((np.diff(keys) > 0) | (np.diff(words) > 0)).tolist():
            x, y = slice(keys[s], keys[s + 1]), slice(words[s], words[s + 1])
            texts = b"".join([raw[i:j] for i, j in zip(starts[y], ends[y], strict=True)])
            rows.append((
                key[0].as_py(), s, x.stop - x.start, _packed(np.diff(a.key[x], prepend=np.uint64(0)), (bits + 7) // 8), _packed(a.follower[x], LETTERS),
                _packed(a.n[x], 4), y.stop - y.start, len(texts), pa.compress(texts, "zstd", asbytes=True), _packed(a.word_n[y], 4),
            ))
        schema = pa.schema(list(zip([c.split()[0] for c in ASK.split(", ")], (i8, i8, i8, bi, bi, bi, i8, i8, bi, bi), strict=True)))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    i8, bi = pa.int64(), pa.binary()
    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their tokens, compressed."""
    codec = pa.Codec("zstd")
    for batch in batches:
        found = [b" ".join(tokens(t)) for t in batch.column("text").to_pylist()]
        sizes, texts = pa.array([len(t) for t in found], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in found], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "held", "h")), sizes, texts], ["id", "held", "h", "size", "text"])


def _ordered(batch: pa.Table) -> pa.Table:
    """A batch's rows in an order that does not depend on how they came."""
    return batch.sort_by([("h", "ascending"), ("text", "ascending")])


def _follow(key: np.ndarray, follower: np.ndarray, n: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each asked (key, follower): the predicted follower for other texts and for an occurrence counted in n.

    Rows of three bytes: how many of the first LETTERS bytes agree, the first that doesn't, and how sure.
    """
    at, pair_of = _distinct(_order(key, bits, follower), key, follower)
    k, f = key[at], follower[at]
    m = np.bincount(pair_of, n, len(k)).astype(np.int64)
    # In each key the most frequent and the next, ties to the smaller, which comes first.
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    sizes = np.diff(first, append=len(k))
    group = np.repeat(np.arange(len(first)), sizes)
    total = np.add.reduceat(m, first)
    best, n1 = _most(m, first, group)
    rest = m.copy()
    rest[best] = -1  # where there is no other
    second, n2 = _most(rest, first, group)
    f1, f2, n2 = f[best], f[second], np.maximum(n2, 0)
    g = group[pair_of]
    own = best[g] == pair_of
    held = _answer(follower, f1[g], n1[g], total[g])
    less = n1[g] - own
    swap = own & (n2[g] > 0) & ((n2[g] > less) | ((n2[g] == less) & (f2[g] < f1[g])))
    return held, _answer(follower, np.where(swap, f2[g], f1[g]), np.where(swap, n2[g], less), np.maximum(total[g] - 1, 0))


def _most(m: np.ndarray, first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the first greatest number in each group."""
    most = np.maximum.reduceat(m, first)
    at = np.flatnonzero(m == most[group])
    return at[np.diff(group[at], prepend=-1) > 0], most


def _answer(actual: np.ndarray, guess: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.zeros((len(actual), 3), np.uint8)
    other = (actual ^ guess) << np.uint64(64 - 8 * LETTERS)
    agree = sum((other >> np.uint64(64 - 8 * k) == 0).astype(np.uint64) for k in range(1, LETTERS + 1))
    byte = guess >> (np.uint64(8) * (np.uint64(LETTERS - 1) - np.minimum(agree, np.uint64(LETTERS - 1)))) & np.uint64(255)
    sure = np.where(n > 0, 2 * _level(n) - 1 + (n == total), 0)
    out[:, 0], out[:, 1], out[:, 2] = agree, np.where(agree < LETTERS, byte, 0), sure  # one that agrees has no other byte
    out[sure == 0] = 0
    return out


def _every_word(texts: bytes) -> pa.Array:
    """The words, each with the space or the line feed that ends it."""
    octets = np.frombuffer(texts, np.uint8)
    ends = np.flatnonzero((octets == SPACE) | (octets == FEED)) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(texts)])


def _reply(bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("b")
        b = rows.column("b").to_pylist()
        sizes = rows.column("n_keys").to_pylist()
        key_of, follower, n = (
            [_numbers(x, o, k) for x, k in zip(rows.column(c).to_pylist(), sizes, strict=True)] for c, o in (("key", (bits + 7) // 8), ("follower", LETTERS), ("n", 4))
        )
        cuts = np.cumsum([0, *sizes])
        none = np.zeros((0, 3), np.uint8)
        held = own = none
        if cuts[-1]:
            every = np.concatenate(n).astype(np.int64)
            held, own = _follow(np.concatenate([np.cumsum(x) for x in key_of]), np.concatenate(follower), every >> 1, bits)
            # Answers that nobody reads pack to nothing.
            held[every & 1 == 0], own[every < 2] = 0, 0
        packed = zip(rows.column("words").to_pylist(), rows.column("n_letters").to_pylist(), strict=True)
        words = _every_word(b"".join(pa.decompress(x, k, "zstd", asbytes=True) for x, k in packed))
        ids = words.dictionary_encode().indices.to_numpy()
        sizes_of = rows.column("n_words").to_pylist()
        times = np.concatenate([_numbers(c, 4, k) for c, k in zip(rows.column("counts").to_pylist(), sizes_of, strict=True)]).astype(np.float64)
        total = np.bincount(ids, times).astype(np.int64)[ids]  # exact, being below 2 ** 53
        # A training word is new in the first batch that has it.
        fresh = (np.diff(np.maximum.accumulate(ids), prepend=-1) > 0) & (total > 0)
        word_cuts = np.cumsum([0, *sizes_of])
        spans = list(zip(word_cuts, word_cuts[1:], strict=False))

        def parts(x: np.ndarray) -> pa.Array:
            return pa.array([pa.compress(np.ascontiguousarray(x[i:j].T).tobytes(), "zstd", asbytes=True) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())

        return pa.table({
            "b": pa.array(b, pa.int64()), "shard": pa.array([key[0].as_py()] * len(b), pa.int64()), "held": parts(held), "own": parts(own),
            "counts": pa.array([_packed(total[i:j], 8) for i, j in spans], pa.binary()), "fresh": pa.array([int(fresh[i:j].sum()) for i, j in spans], pa.int64()),
        })

    return run


def _prepared(shards: int, bits: int, id_type: pa.DataType):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _ordered(texts)
        a = _asked(batch, bits)
        answers = answers.sort_by("shard")
        cuts = np.diff(_cuts(a.key, bits, shards))[answers.column("shard").to_numpy()]

        def whole(name: str) -> np.ndarray:
            parts = zip(answers.column(name).to_pylist(), cuts.tolist(), strict=True)
            return np.concatenate([np.frombuffer(pa.decompress(x, 3 * k, "zstd"), np.uint8).reshape(3, -1).T for x, k in parts])

        info = np.where(a.mine[a.text][:, None], whole("own")[a.inverse], whole("held")[a.inverse])
        sizes = np.diff(_cuts(a.words.hash[a.word], 64, shards))[answers.column("shard").to_numpy()]
        counts = np.concatenate([_numbers(x, 8, k) for x, k in zip(answers.column("counts").to_pylist(), sizes.tolist(), strict=True)])
        n = len(a.mine)
        octets = a.octets
        if not a.mine.all():
            octets = octets[np.repeat(a.mine[a.text], a.words.end - a.words.start + 1)]
        lists = pa.list_(pa.int64())
        return pa.table({
            "ids": pa.array([batch.column("id").to_pylist()], pa.list_(id_type)),
            "held": pa.array([~a.mine], pa.list_(pa.bool_())),
            "n_tokens": pa.array([np.bincount(a.text, minlength=n)], lists),
            "n_known": pa.array([np.bincount(a.text, (counts > 0)[a.word_inverse], n).astype(np.int64)], lists),
            "sums": pa.array([np.bincount(a.text, np.log10(counts + 0.5)[a.word_inverse], n)], pa.list_(pa.float64())),
            "size": pa.array([len(a.octets)], pa.int64()),
            "stream": pa.array([pa.Codec("zstd", compression_level=3).compress(a.octets.tobytes(), asbytes=True)], pa.binary()),
            "info": pa.array([pa.compress(np.ascontiguousarray(info.T).tobytes(), "zstd", asbytes=True)], pa.binary()),
            "n_train": pa.array([int(a.word_n.sum())], pa.int64()),
            "fresh": pa.array([sum(answers.column("fresh").to_pylist())], pa.int64()),
            "octets": pa.array([np.bincount(octets, minlength=256)], lists),
        })

    return run


def gather(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batches of coded texts with what the whole corpus says of their words, checkpointed."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0]
    batches, shards = max(1, math.ceil(size / BATCH)), max(1, math.ceil(size / SHARD))
    bits = key_bits(int(size))
    name = F.col(id_col).cast("string")
    hashed = F.xxhash64(name, text, F.spark_partition_id())
    rows = docs.select(F.col(id_col).alias("id"), (~training(id_col)).alias("held"), text.alias("text"), hashed.alias("h"))
    id_type = docs.schema[id_col].dataType
    coded = StructType([StructField("id", id_type), *_parse_datatype_string("held boolean, h bigint, size bigint, text binary").fields])
    rows = rows.mapInArrow(_coded, coded).withColumn("b", F.pmod("h", F.lit(batches)))
    asked = rows.groupBy("b").applyInArrow(_ask(shards, bits), ASK)
    answers = asked.groupBy("shard").applyInArrow(_reply(bits), ANSWER)
    schema = StructType([StructField("ids", ArrayType(id_type)), *_parse_datatype_string(PREPARED).fields])
    met = rows.groupBy("b").cogroup(answers.groupBy("b"))
    return met.applyInArrow(_prepared(shards, bits, to_arrow_type(id_type)), schema).checkpoint()


def _unpacked(size: int, stream: bytes, info: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    octets = np.frombuffer(pa.decompress(stream, size, "zstd"), np.uint8)
    return octets, np.ascontiguousarray(np.frombuffer(pa.decompress(info, 3 * n, "zstd"), np.uint8).reshape(3, -1).T)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        yield tuple(batch.column(c)[k].as_py() for c in names)


PARTS = "k int, b int, n bigint, part binary"


def _part(k: int, b: int, n: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([n]), pa.array([data])], ["k", "b", "n", "part"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the parts of each block and turn counts to log odds; memory is the blocks', however many learners sent them."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, b, n, part in _rows(batch, "k", "b", "n", "part"):
            if k < 0:
                x = np.frombuffer(part, "<f8")
                sums[k, b] = sums[k, b] + x if (k, b) in sums else x
                continue
            have = sums.setdefault((k, b), np.zeros((1 << BLOCK_BITS, 2), np.int64))
            x = _numbers(part, 8, 2 * n)
            have[np.cumsum(x[:n])] += x[n:].view("<u4").reshape(-1, 2)
    for (k, b), x in sums.items():
        if k >= 0:
            l = np.log(x + DELTA)
            data = (l[:, 1] - l[:, 0]).astype("<f4").tobytes()
        yield _part(k, b, len(x), data if k >= 0 else x.tobytes())


def train(gathered: DataFrame, table_bits: int = TABLE_BITS, learner: int = LEARNER) -> tuple[Model, int, int]:
    """The model, the number of training tokens and that of distinct ones."""
    spark = gathered.sparkSession
    context = spark.sparkContext

    def totals(batches):
        sums = np.zeros(259, np.int64)
        for batch in batches:
            for octets, n, v, size in _rows(batch, "octets", "n_train", "fresh", "size"):
                sums[:256] += np.array(octets)
                sums[256:] += n, v, size
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["at", "n"])

    sums = np.zeros(259, np.int64)
    counted = gathered.select("octets", "n_train", "fresh", "size").mapInArrow(totals, "at int, n bigint")
    for r in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():  # 259 rows at most
        sums[r["at"]] = r["n"]
    code = Code(sums[:256])
    shared = context.broadcast((code, table_bits))

    def learn(batches):
        mine = None
        for batch in batches:
            for size, stream, info, n, held in _rows(batch, "size", "stream", "info", "n_tokens", "held"):
                mine = mine or Learner(*shared.value)
                mine.learn(*_unpacked(size, stream, info, sum(n)), ~np.array(held))
        if mine is None:
            return
        block = 1 << BLOCK_BITS
        for k, t in enumerate(mine.tables):
            for b in range(0, len(t), block):
                cut = t[b : b + block]
                at = np.flatnonzero(cut).astype(np.uint64)
                if len(at):
                    # Places as differences, and both counts in one number.
                    yield _part(k, b // block, len(at), _packed(np.concatenate((np.diff(at, prepend=np.uint64(0)), cut[at.astype(np.intp)])), 8))
        values = np.concatenate(((mine.weights * mine.bits[:, None]).ravel(), mine.bits, mine.map.ravel(), mine.record.ravel()))
        yield _part(-1, 0, len(values), values.astype("<f8").tobytes())

    learners = max(1, round(int(sums[258]) / learner))
    learned = gathered.select("size", "stream", "info", "n_tokens", "held").coalesce(learners)
    sent = learned.mapInArrow(learn, PARTS).repartition("k", "b").mapInArrow(_merge, PARTS)
    first = Learner(code, BLOCK_BITS)
    n = first.weights.size
    values = np.zeros(n + GATES + first.map.size + first.record.size)
    odds = [np.zeros(1 << table_bits, np.float32) for _ in CONTEXTS]
    for r in sent.collect():  # the tables, whose size is fixed
        if r["k"] < 0:
            values = np.frombuffer(r["part"], "<f8")
            continue
        at = r["b"] << BLOCK_BITS
        size = min(1 << BLOCK_BITS, (1 << table_bits) - at)
        odds[r["k"]][at : at + size] = np.frombuffer(r["part"], "<f4", size)
    weights, bits, seen, record = np.split(values, np.cumsum([n, GATES, first.map.size]))
    w = np.where(bits[:, None] > 0, weights.reshape(first.weights.shape) / np.maximum(bits[:, None], 1), first.weights)
    # The map starts from the identity, as if each cell had been seen a few times.
    middle = _squash((np.tile(np.arange(STEPS), GATES) * 16 / (STEPS - 1)) - 8)
    seen = seen.reshape(first.map.shape)
    refined = ((seen[:, 1] + 8 * middle) / (seen.sum(axis=1) + 8)).astype(np.float32)
    record = _record_odds(record.reshape(first.record.shape))
    model = Model(code, table_bits, odds, record, w.T.astype(np.float32, order="C"), refined)
    return model, int(sums[256]), int(sums[257])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """Scores of all texts, learned from the training ones."""
    gathered = gather(docs, id_col, text_col)
    model, total, distinct = train(gathered, table_bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    z = math.log10(total + 0.5 * (distinct + 1))
    id_type = docs.schema[id_col].dataType
    arrow = to_arrow_type(id_type)

    def run(batches):
        m = shared.value
        for batch in batches:
            for size, stream, info, ids, held, n, known, sums in _rows(batch, "size", "stream", "info", "ids", "held", "n_tokens", "n_known", "sums"):
                octets, info = _unpacked(size, stream, info, sum(n))
                lp = m.score(octets, info)
                # The bytes of a text are those of its words, joined by spaces.
                ends = np.flatnonzero(octets == FEED)
                length = np.maximum(np.diff(np.concatenate(([-1], ends))) - 2, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, arrow), pa.array(held), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                        pa.array(np.array(sums) - np.array(n) * z), pa.array(lp), pa.array(length),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "length"],
                )

    schema = StructType([StructField("id", id_type), *_parse_datatype_string(SCORED).fields])
    names = ("size", "stream", "info", "ids", "held", "n_tokens", "n_known", "sums")
    return gathered.select(*names).mapInArrow(run, schema).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("length", F.lit(1))).alias("bits_per_byte"),
    )
