"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items go into one suffix automaton. Each document's words stream
through it; the automaton's state is the longest suffix of the words read so far that occurs in an
item. A position where that suffix has `window` words or more ends an occurrence of a window, and
so does one where a whole shorter item is a suffix. All words of an occurrence are hit.

The items are broadcast only in bounded parts: `MAX_WORDS` item words each, from which a worker
builds an automaton once, for all its tasks. The driver reads the items as a stream and holds the parts of
one pass. A pass over the documents takes `AT_ONCE` parts; a larger benchmark takes several
passes, with a checkpoint between, in which hits add up. The documents are never shuffled.

Null and empty texts have no words and no hits; an empty table or benchmark finds none. A text of any
length is scanned whole. Repeated rows stay. Other columns may have any names. Items without words match nothing. An item without
an id counts for hits but is not named; items with the same id are one item.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, utf8

WINDOW = 13
#: Item words of one automaton: at most two states a word, kept in arrays. 250,000 words took 42 MB and 3 s to build.
MAX_WORDS = 250_000
#: Automata that a worker holds in one pass.
AT_ONCE = 4
#: Upper-case ASCII letters to lower case; what is no ASCII letter or digit, or beyond ASCII, to a space.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(NORMAL).split()


class Automaton:
    """Suffix automaton of the word sequences of several items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        # Most states have one edge: its word and target. Other edges are in `more`.
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str | None] = []
        owned: list[tuple[int, array]] = []  # item, the states of its prefixes
        whole: dict[int, list] = {}  # state of a whole short item: (words, item)
        least = window + 1
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            number, last = len(self.names), 0
            self.names.append(item)
            ends = array("i")
            for w in words:
                last = self._extend(last, w)
                ends.append(last)
            owned.append((number, ends))
            if 0 < len(words) < window:
                whole.setdefault(self._walk(words), []).append((len(words), item))
            if words:
                least = min(least, len(words), window)
        self.least = least  # no occurrence is shorter
        n = len(self.link)
        # The items whose prefix a state is: the first one, and in `others` any more.
        self.owner, self.others = array("i", [-1]) * n, {}
        for number, ends in owned:
            for s in ends:
                if self.owner[s] < 0:
                    self.owner[s] = number
                elif self.owner[s] != number:
                    self.others.setdefault(s, set()).add(number)
        # The states below a state: its first, and of each the next beside it.
        self.below, self.beside = array("i", [-1]) * n, array("i", [-1]) * n
        for s in range(1, n):
            up = self.link[s]
            self.beside[s], self.below[up] = self.below[up], s
        # The nearest state upwards, itself included, that is a whole short item.
        self.short = array("i", [-1]) * n
        self.whole = whole
        for s in sorted(range(n), key=self.length.__getitem__) if whole else ():
            self.short[s] = s if s in whole else self.short[self.link[s]] if s else -1
        self._of: dict[int, frozenset] = {}

    def _step(self, s: int, w: int) -> int:
        """The state that w leads to, or -1."""
        if self.word[s] == w:
            return self.to[s]
        edges = self.more.get(s)
        return -1 if edges is None else edges.get(w, -1)

    def _lead(self, s: int, w: int, t: int) -> None:
        if self.word[s] in (-1, w):
            self.word[s], self.to[s] = w, t
        else:
            self.more.setdefault(s, {})[w] = t

    def _walk(self, words: list[int]) -> int:
        s = 0
        for w in words:
            s = self._step(s, w)
        return s

    def _new(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        """Append w after the state last; the state of the longer sequence."""
        there = self._step(last, w)
        if there >= 0 and self.length[there] == self.length[last] + 1:
            return there
        cur = -1 if there >= 0 else self._new(self.length[last] + 1, 0)
        p = last
        while cur >= 0 and p >= 0 and self._step(p, w) < 0:
            self._lead(p, w, cur)
            p = self.link[p]
        if p < 0:
            return cur
        q = self._step(p, w)
        if self.length[q] == self.length[p] + 1:
            self.link[cur] = q
            return cur
        clone = self._new(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        if cur >= 0:
            self.link[cur] = clone
        while p >= 0 and self._step(p, w) == q:
            self._lead(p, w, clone)
            p = self.link[p]
        return clone if cur < 0 else cur

    def items_of(self, state: int) -> frozenset:
        """Items in which the state's sequences occur: those of all states below it."""
        if state not in self._of:
            found, left = set(), [state]
            while left:
                s = left.pop()
                if self.owner[s] >= 0:
                    found.add(self.owner[s])
                    found |= self.others.get(s, frozenset())
                s = self.below[s]
                while s >= 0:
                    left.append(s)
                    s = self.beside[s]
            self._of[state] = frozenset(self.names[k] for k in found)
        return self._of[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged half-open spans of hit words, in order, and the items that occur."""
        get, spans, items = self.ids.get, [], set()
        known = [get(w, -1) for w in words]
        at, n = 0, len(known)
        step, link, length, window, least = self._step, self.link, self.length, self.window, self.least
        # An occurrence lies within words that the items have, so every least-th word is one of them.
        while at + least <= n:
            probe = at + least - 1
            if known[probe] < 0:
                at = probe + 1
                continue
            start = probe
            while start > at and known[start - 1] >= 0:
                start -= 1
            end = probe + 1
            while end < n and known[end] >= 0:
                end += 1
            at = end + 1
            if end - start < least:
                continue
            state = matched = 0
            for pos in range(start, end):
                w = known[pos]
                after = step(state, w)
                while state and after < 0:
                    state = link[state]
                    matched = length[state]
                    after = step(state, w)
                if after >= 0:
                    state = after
                    matched += 1
                if matched >= window:
                    s = state
                    while length[link[s]] >= window:
                        s = link[s]
                    items |= self.items_of(s)
                    _add(spans, pos + 1 - window, pos + 1)
                s = self.short[state]
                while s >= 0:
                    for size, item in self.whole[s]:
                        if size <= matched:
                            items.add(item)
                            _add(spans, pos + 1 - size, pos + 1)
                    s = self.short[link[s]] if s else -1
        return spans, items


def _add(spans: list[tuple[int, int]], a: int, b: int) -> None:
    """Add a span that ends at or after all others."""
    while spans and spans[-1][1] >= a:
        a = min(a, spans.pop()[0])
    spans.append((a, b))


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = MAX_WORDS) -> Iterator[list]:
    """The items in lists of at most `most` words, or of one item that alone has more."""
    part, total = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    for item, text in rows:
        n = len(words_of(text))
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append((item, text))
        total += n
    yield part


#: The automata of the last broadcast that this worker has built, by its name.
_BUILT: dict[str, list[Automaton]] = {}


def built(name: str, some: list[list], window: int) -> list[Automaton]:
    """The automata of a broadcast, built once in a worker and kept for its next tasks, in place of an earlier one's."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = [Automaton(part, window) for part in some]
    return _BUILT[name]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    window: int = WINDOW,
    most: int = MAX_WORDS,
) -> DataFrame:
    """row (a struct of the columns of keep), n_words, n_hit, spans (word numbers: start, end, start, ...), items."""
    spark = docs.sparkSession
    prepare(spark)
    found = docs.select(
        F.struct(*keep).alias("row"),
        F.col(text_col).cast("string").alias("text"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("n_words", "n_hit")],
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = found.schema
    for k, some in enumerate(batched(parts(benchmark, text_col="text", most=most), AT_ONCE)):
        if k:
            found = found.checkpoint()
        shared, name = spark.sparkContext.broadcast((some, window)), uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            automata = built(name, *shared.value)
            for batch in batches:
                n_words, n_hit, spans, items = [], [], [], []
                rows = zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True)
                for text, had, named in rows:
                    words = words_of(text)
                    new, which = automata[0].scan(words)
                    every = [*new, *zip(had[::2], had[1::2], strict=True)]
                    for automaton in automata[1:]:
                        more, also = automaton.scan(words)
                        every += more
                        which |= also
                    if len(every) > len(new):
                        new = []
                        for a, b in sorted(every, key=lambda s: s[1]):
                            _add(new, a, b)
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in new))
                    spans.append([x for s in new for x in s])
                    items.append(sorted({*named, *(x for x in which if x is not None)}))
                values = dict(zip(("n_words", "n_hit", "spans", "items"), (n_words, n_hit, spans, items), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[f.name], f.type) if f.name in values else batch.column(f.name) for f in batch.schema],
                    schema=batch.schema,
                )

        found = found.mapInArrow(run, schema)
    return found


def _contaminated(share: int):
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", share: int = 20, **options) -> DataFrame:
    """Per document: words, hit words, items found, and whether a share-th of its words or more are hit."""
    named = F.array_sort(F.col("items"))
    return scan(docs, benchmark, [id_col], **options).select(
        F.col("row")[id_col].alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"),
        _contaminated(share).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """docs without the contaminated rows."""
    return scan(docs, benchmark, docs.columns, **options).where(~_contaminated(share)).select("row.*")


def cut(text: str | None, spans: list[int]) -> str | None:
    """The text without the words of the spans, from a span's first word to its last."""
    if not spans:
        return text
    octets = utf8(text)
    places = [m.span() for m in WORD.finditer(octets)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(octets[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, octets[at:]]).decode("utf-8", "surrogatepass")


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = WINDOW, share: int = 20, **options
) -> DataFrame:
    """docs with spans of `least` hit words or more cut from texts, and the rows beyond the share dropped."""
    found = scan(docs, benchmark, docs.columns, text_col, **options).where(~_contaminated(share))

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            at = row.type.get_field_index(text_col)
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                long = [x for a, b in zip(spans[::2], spans[1::2], strict=True) if b - a >= least for x in (a, b)]
                texts.append(cut(text, long))
            columns = row.flatten()
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in row.type])

    return found.select("row", "text", "spans").mapInArrow(run, docs.schema)
