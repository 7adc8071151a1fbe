"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers (`features`), each number a bin. The model is a table for each
feature and one for each chosen pair of features; a text's logit is the sum of the entries of its
bins. The tables are learned by cyclic boosting: round after round, every feature in turn gets a
shallow tree, fitted to the gradient of the logistic loss and added into its table at a low rate.
After that the pairs whose residuals separate best get tables in the same way.

Learning takes at most `SAMPLE` labelled rows, those whose ids have the smallest hashes; only their
numbers go to the driver. Scoring is one pass over all texts and shuffles nothing.

Null and empty texts have zeros for all numbers and get a score like any other; a text of any length is
counted whole, and an empty table gives no rows. Of labelled ids with equal hashes the smaller is taken.
Repeated rows stay, but count once in learning. Columns other than id, text and label play no part. A row without an id
is never learned from. An id with several labels has their mean, rounded. Without labelled rows, or
with labels of one kind only, every score is the share of label 1, smoothed by a half each way.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, per_text, prepare, utf8

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 10, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 200, 60, 0.08, 4
CUT = 0.3

PUNCTUATION = [c for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
NAMES = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "longest_word", "distinct", "top_word", "short_words",
    "upper", "lower", "digits", "other_ascii", "beyond_ascii", "spaces", "marked_words", "upper_words", "capital_words",
    "digit_words", "lone_marks", "lines", "line_words", "line_repeats", "top_line", "pair_repeats", "triple_repeats",
    "half_repeats", "ends", "commas", "sentence_words", "byte_entropy",
    *[f"mark_{c:02x}" for c in PUNCTUATION],
]
_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 beyond ASCII, 5 white space
for _b in range(256):
    _KIND[_b] = (
        1 if 0x41 <= _b <= 0x5A else 2 if 0x61 <= _b <= 0x7A else 3 if 0x30 <= _b <= 0x39
        else 4 if _b >= 0x80 else 5 if _b in b" \t\n\r\x0b\x0c" else 0
    )
#: Punctuation that stands in or ends ordinary words is left; other marks become a bar, letters x, digits 0.
_MARKS = bytes(0x7C if b in b"#$%&*+<=>@[\\]^_`{|}~!/" else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def features(text: str | None) -> list[float]:
    """The numbers of one text, in the order of NAMES."""
    raw = utf8(text)
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    octets = np.frombuffer(raw, np.uint8)
    counts = np.bincount(octets, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / n
    shares = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    coded = {w: k for k, w in enumerate(seen)}
    ids = np.fromiter(map(coded.__getitem__, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    k = len(ids)
    pairs = len(np.unique(ids[1:] * k + ids[:-1]))
    triples = len(np.unique(ids[2:] * 1_000_003**2 + ids[1:-1] * 1_000_003 + ids[:-2])) / (k - 2) if k > 2 else 1.0
    marked = raw.translate(_MARKS).split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_line = Counter(lines)
    ln = max(1, len(lines))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    half = k // 2
    ends = int(counts[0x2E] + counts[0x21] + counts[0x3F])
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), len(seen) / m,
        max(seen.values(), default=0) / m, float((sizes <= 3).mean()),
        kinds[1], kinds[2], kinds[3], kinds[0], kinds[4], kinds[5],
        sum(1 for w in marked if b"|" in w) / m, upper / m, sum(1 for w in words if w[:1].isupper()) / m,
        sum(1 for w in marked if b"0" in w) / m, sum(1 for w in marked if not w.strip(b"|.,;:-()\"'")) / m,
        np.log1p(len(lines)), len(words) / ln, 1 - len(by_line) / ln, max(by_line.values(), default=0) / ln,
        1 - pairs / max(1, k - 1), 1 - triples,
        float((ids[half : 2 * half] == ids[:half]).mean()) if half else 0.0,
        ends / m, counts[0x2C] / m, len(words) / (1 + ends), float(-(shares * np.log2(shares)).sum()),
        *(counts[PUNCTUATION] / m),
    ]


@dataclass
class Model:
    """base + the tables' entries is the logit; edges cut features into bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        logit = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            logit += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            logit += t[_coarse(b[:, f], self.edges[f]), _coarse(b[:, g], self.edges[g])]
        return 1 / (1 + np.exp(-logit))


def _coarse(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A feature's bins, put together to PAIR_BINS at most."""
    return b * min(PAIR_BINS, len(edges) + 1) // (len(edges) + 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton steps of a tree over ordered bins: split the leaf that gains most until there are enough."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    ridge = 1.0
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        left, right = cg[k] - cg[a], cg[b] - cg[k]
        hl, hr = ch[k] - ch[a], ch[b] - ch[k]
        gain = left**2 / (hl + ridge) + right**2 / (hr + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        gain[(hl < 1e-6) | (hr < 1e-6)] = 0
        return float(gain.max()), int(k[gain.argmax()])

    while len(parts) < leaves:
        gain, at, part = max((*best(a, b), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from feature rows x and labels y of 0 and 1."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        flat = [np.empty(0) for _ in NAMES]
        return Model(base, flat, [np.zeros(1) for _ in NAMES], [], [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    b = model.bins(x)
    logit = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * _tree(np.bincount(b[:, f], y - p, len(t)), np.bincount(b[:, f], p * (1 - p), len(t)))
            t += step
            logit += step[b[:, f]]
    p = 1 / (1 + np.exp(-logit))
    coarse = [_coarse(b[:, f], edges[f]) for f in range(x.shape[1])]
    wide = [min(PAIR_BINS, len(e) + 1) for e in edges]

    def gain(f: int, g: int) -> float:
        cell = coarse[f] * wide[g] + coarse[g]
        r, h = np.bincount(cell, y - p, wide[f] * wide[g]), np.bincount(cell, p * (1 - p), wide[f] * wide[g])
        return float((r**2 / (h + 1)).sum())

    strong = sorted(range(x.shape[1]), key=lambda f: -np.ptp(model.tables[f]))[:16]
    model.pairs = sorted(combinations(sorted(strong), 2), key=lambda fg: -gain(*fg))[:PAIRS]
    model.pair_tables = [np.zeros((wide[f], wide[g])) for f, g in model.pairs]
    for r in range(PAIR_ROUNDS):
        for (f, g), t in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-logit))
            cell = coarse[f] * wide[g] + coarse[g]
            rg, rh = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p)))
            # A tree of depth two: a cut of one feature, by turns, and cuts of the other on either side.
            if r % 2:
                rg, rh = rg.T, rh.T
            step = _two(rg, rh)
            t += RATE * (step.T if r % 2 else step)
            logit += RATE * (step.T if r % 2 else step)[coarse[f], coarse[g]]
    return model


def _two(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    first = _tree(g.sum(axis=1), h.sum(axis=1), 2)
    at = int(np.flatnonzero(np.diff(first))[0]) + 1 if np.ptp(first) > 0 else len(first)
    out = np.empty(g.shape)
    for a, b in ((0, at), (at, len(first))):
        if b > a:
            out[a:b] = _tree(g[a:b].sum(axis=0), h[a:b].sum(axis=0), 2)
    return out


def fold(id_col: str = "doc_id") -> Column:
    """True for rows that are never learned from: crc32(id as text) mod 5 is 0, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows of docs outside the held-out fold."""
    prepare(docs.sparkSession)
    marked = (
        labels.where(F.col(label).isNotNull() & ~fold("doc_id"))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("__id"))
    rows = met.groupBy("__id", "__y").agg(F.min("text").alias("text"))  # a repeated id counts once

    def make():
        return lambda texts: [[features(t) for t in texts]]

    got = per_text(rows, ["__id", "__y"], "text", "x array<double>", make).toPandas()
    got = got.sort_values("__id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return fit(x, got["__y"].to_numpy(float))


def _scorer(model: Model):
    def run(texts):
        if not texts:
            return np.empty(0)
        return model.score(np.array([features(t) for t in texts], float))

    return run


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        run = _scorer(shared.value)
        return lambda texts: [run(texts)]

    scored = per_text(docs, ["doc_id"], "text", "score double", make)
    return scored.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        run = _scorer(shared.value)
        return lambda texts: (run(texts) >= cut).tolist()

    return keep_texts(docs, "text", make)
