"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxgauge.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """(item, rank, doc, score) for rows (id, text)."""
    known = [(i, terms(t)) for i, t in docs]
    known = [(i, t) for i, t in known if t]
    n_docs, n_terms = len(known), sum(len(t) for _, t in known)
    df = Counter(w for _, t in known for w in set(t))
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, t in known:
            tf, m = Counter(t), 100 - 75 + (75 * len(t) * n_docs) // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w, c in asked.items() if tf[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda x: (str(x[0]), x[1:2], str(x)))


def frame(spark, rows, name):
    wide = spark.createDataFrame(rows, f"{name} bigint, text string")
    return wide.withColumns({c: F.lit("x") for c in ("ids", "words", "item", "doc", "score", "rank", "id", "t")})


def ranked(spark, docs, items, **more):
    got = lexical.rank(frame(spark, docs, "doc_id").repartition(3), frame(spark, items, "item_id"), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=lambda x: (str(x[0]), x[1:2], str(x)))


def texts(n, seed=0, most=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aéi0XYz") for _ in range(rng.randint(1, 3))) for _ in range(250)]
    return [rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_equals_scoring_everything(spark, block):
    docs = list(enumerate(texts(400)))
    items = [(i, t) for i, t in enumerate(texts(25, 1, 20))]
    assert ranked(spark, docs, items, block=block) == plain(docs, items)


def test_ties_copies_nulls_and_long_texts(spark):
    docs = [(i, "Same text again") for i in range(30)] + [(None, "same TEXT again"), (None, None), (50, ""), (51, "!!! --"), (5, "Same text again")]
    docs += [(60, "word " * 50_000 + "rare"), (61, "ß straße STRASSE \x7f ok"), (62, "x" * 100_000)]
    items = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (4, "rare rare word"), (5, "Straße"), (None, "again"), (6, "absent"), (7, "x" * 100_000)]
    assert ranked(spark, docs, items) == plain(docs, items)


def test_words_of_all_documents_weigh_little_but_count(spark):
    docs = [(i, "the " + t) for i, t in enumerate(texts(60, 5))]
    items = [(0, "the"), (1, "the the the")]
    assert ranked(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    some = [(1, "a b")]
    assert ranked(spark, [], some) == ranked(spark, some, []) == ranked(spark, [], []) == []


def test_parts_of_items_give_the_same(spark, monkeypatch):
    docs, items = list(enumerate(texts(120, 7))), list(enumerate(texts(20, 8, 15)))
    monkeypatch.setattr(lexical, "CELLS", 60)
    assert len(list(lexical.parts(frame(spark, items, "item_id"), "item_id", "text"))) > 4
    assert ranked(spark, docs, items) == plain(docs, items)


def test_large_scores_are_exact(spark):
    docs, items = [(i, f"a{'b' * i} c") for i in range(5)], [(0, "ab " * 700_000 + "c"), (1, "c")]
    assert ranked(spark, docs, items) == plain(docs, items)


def test_blocks_are_pruned_where_documents_differ(spark):
    """Items whose terms are in few blocks never score the others."""
    docs = frame(spark, [(i, " ".join(f"t{i // 64} u{i // 64} w{i}" for _ in range(2))) for i in range(2048)], "doc_id")
    row_list = [r.asDict() for r in lexical.index(docs.coalesce(1)).collect()]
    part = lexical.Part()
    for i in range(8):
        part.add(i, Counter({b"t%d" % (3 * i): 1, b"u%d" % (3 * i): 2}))
    scorer = lexical.Scorer(part.terms, [5000] * len(part.terms), [c for _, c in part.items], 2048, 100_000, 10, 64)
    best = lexical.Best(8, 10)
    for row in row_list:
        if (r := scorer.opened({k: v if k == "ids" else bytes(v) for k, v in row.items()})) is not None:
            lexical._rank(r, best)
    assert scorer.scored <= 8 * 32 / 8 and scorer.pruned > scorer.scored
    assert all(len(f) == 10 for f in best.found)
