"""The mixing operator: targets and balance against plain computations."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fluxgauge.llm import mixing

DOCS = "doc_id bigint, text string, source string, size string, n string, target string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], DOCS)


def plain_targets(sizes: dict) -> dict:
    """By the rule: shares by weight; what is above twice a source's size is dealt anew to the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, Fraction(0))
    left, free = Fraction(3, 2) * sum(sizes.values()), set(names)
    while left and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                target[s] = Fraction(2 * sizes[s])
                free.discard(s)
    return target


def many(n, seed=0, sources=7):
    rng = random.Random(seed)
    names = [None if i == sources - 1 else f"s{i}" if i else "Ünï" for i in range(sources)]
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200])), rng.choices(names, [20] + [1] * (sources - 1))[0]) for i in range(n)]


def test_targets_follow_the_weights_and_the_mix_comes_near_them(spark):
    rows = many(4000)
    got = mixing.mix(frame(spark, rows), group=256).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    size, source = {i: len((t or "").split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    whole = Counter()
    for i in size:
        whole[source[i]] += size[i]
    target = plain_targets(whole)
    taken, docs, fractions = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == whole[source[r.doc_id]]
        assert r.target == pytest.approx(float(target[source[r.doc_id]]))
        rate = r.target / r.source_size
        low = int(rate) * r["size"]
        assert r.taken in (low, low + r["size"]) and r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        if r["size"]:
            docs[source[r.doc_id]] += r.taken // r["size"]
    for s, words in taken.items():
        assert abs(words - target[s]) <= 200  # the longest document
    # Documents are balanced too, but for those without words, which the count of words can't show.
    n = Counter(s for i, s in source.items() if size[i])
    empty = Counter(s for i, s in source.items() if not size[i])
    for s in n:
        assert abs(docs[s] - n[s] * target[s] / whole[s]) <= 3 + 3 * (empty[s] ** 0.5)


def test_any_partitioning_gives_the_same_mix(spark):
    d = frame(spark, many(1500, 3))
    found = [sorted((r.doc_id, r.taken) for r in mixing.mix(x, group=128).collect()) for x in (d.coalesce(1), d.repartition(7), d.orderBy(F.desc("doc_id")))]
    assert found[0] == found[1] == found[2]


def test_no_document_is_favoured(spark):
    """Over many seeds each document of a source is taken as often as its probability says."""
    size = [1, 2, 3, 5, 8, 13, 21, 34]
    rounds, taken = 4000, [0] * len(size)
    draw = random.Random(5)
    for _ in range(rounds):
        p = [0.4] * len(size)
        mixing.settle(size, p, draw, True)
        assert all(x in (0.0, 1.0) for x in p)
        taken = [a + b for a, b in zip(taken, p, strict=True)]
    assert all(abs(t / rounds - 0.4) < 0.04 for t in taken)


def test_flight_keeps_words_and_documents():
    rng = random.Random(1)
    size = [rng.choice([0, 1, 5, 5, 300]) for _ in range(500)]
    p = [0.3] * len(size)
    mixing.settle(size, p, random.Random(2), False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(150) and sum(a * b for a, b in zip(size, p, strict=True)) == pytest.approx(0.3 * sum(size))


def test_null_repeated_empty_and_very_long(spark):
    """Repeated rows are documents; a null id, source or text is one like another."""
    rows = [(None, None, None)] * 3000 + [(None, "a b", None)] * 6000 + [(1, "a b c", "s")] * 5 + [(2, "long " * 200_000, "t"), (3, "\x1c\x85 x\x0bz", "s"), (4, " ", "t")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t.encode().split()) if t else 0) for i, t, _ in rows)
    target = plain_targets(Counter({None: 12000, "s": 18, "t": 200_000}))
    named = {(1, 3): "s", (3, 3): "s", (2, 200_000): "t", (4, 0): "t"}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(float(target[named.get((r.doc_id, r["size"]))])) and r.taken <= 2 * r["size"]
        taken[named.get((r.doc_id, r["size"]))] += r.taken
    assert abs(taken[None] - target[None]) <= 2 and abs(taken["s"] - target["s"]) <= 3


def test_empty_tables_and_sources_without_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_targets_where_no_source_can_give_more(spark):
    got = {r.doc_id: r for r in mixing.mix(frame(spark, [(1, "a b c d", "a")]), share=2.0).collect()}
    assert (got[1].target, got[1].taken) == (8.0, 8)
    with pytest.raises(ValueError, match="share"):
        mixing.mix(frame(spark, [(1, "a", "a")]), share=2.5)


def test_sources_are_numbered_by_code_point(spark):
    names = ["b", "a", "ÿ", "z", "\U0001f642", "", None, "B"]
    sources = spark.createDataFrame([(s, 100) for s in names], "source string, source_size bigint").repartition(5)
    got = {r.source: r.number for r in mixing.numbered(sources).collect()}
    assert sorted(got, key=got.get) == ["", "B", "a", "b", "z", "ÿ", "\U0001f642", None] and sorted(got.values()) == list(range(8))
