"""The numbered operators on small frames, against brute force or the library they must equal."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fluxgauge.llm import (
    bpe, decontaminate, html_text, licenses, lm_scoring, quality, sharding, simhash, token_counts, topk,
)
from fluxgauge.llm.queries import oracle_sql, queries, vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string, text_2 string"
ODD = [None, "", " ", "\n\n", "a", "ß", "word " * 3000, "x" * 30000, "the cat sat on the mat", "the cat sat on the mat", "🙂 ok", "\x00\x1c odd\x85 spaces"]


def docs(spark, texts, ids=None):
    """Documents with columns beside those needed, some with names that operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t or ""), 0.5, "f", "t") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def sentences(n, seed=0, vocabulary=400, words=60):
    rng = random.Random(seed)
    known = ["".join(rng.choice("etaoinsr") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(known[: 40 if rng.random() < 0.6 else vocabulary]) for _ in range(words)) for _ in range(n)]


EMPTY = [
    lambda d: token_counts.count(d, vocabulary("piece_bpe_32k.model")),
    lambda d: lm_scoring.score(d, table_bits=14),
    lambda d: licenses.scan(d, ["doc_id"]),
    lambda d: sharding.place(d, "doc_id"),
    lambda d: simhash.components(d),
    lambda d: simhash.keep_first(d),
    lambda d: bpe.digests(d, vocabulary("word_bpe_49k.json")),
    lambda d: decontaminate.report(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    lambda d: quality.score(d, quality.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    lambda d: topk.search(topk.quantise(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(0.5)).alias("embedding")))),
    lambda d: html_text.extract(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")), ["page_id"]),
]


@pytest.mark.parametrize("op", range(len(EMPTY)))
def test_empty_tables(spark, op):
    assert EMPTY[op](docs(spark, [])).count() == 0


INTERNAL = (
    "id h b held text_ row key order kept n_words n_hit spans items __text __n __kept __items __p __flat __row __slot __shard __best "
    "fingerprint component_id tile q_tile floor word stream info shard"
).split()


def test_columns_may_have_the_names_that_operators_use(spark):
    d = docs(spark, ["a b c d e f"] * 3 + ["Released under the MIT License."] + sentences(6, 30)).withColumns({c: F.lit(c) for c in INTERNAL})
    bench = d.limit(1).withColumnRenamed("doc_id", "item_id")
    labels = d.select("doc_id", (F.col("doc_id") % 2).alias("quality"), *INTERNAL)
    found = [
        token_counts.count(d, vocabulary("piece_bpe_32k.model")), lm_scoring.score(d, table_bits=12), simhash.components(d),
        bpe.digests(d, vocabulary("word_bpe_49k.json")), decontaminate.report(d, bench), quality.score(d, quality.train(d, labels)),
    ]
    assert [x.count() for x in found] == [10] * len(found)
    for kept in (simhash.keep_first(d), decontaminate.drop_contaminated(d, bench), decontaminate.remove_spans(d, bench), quality.keep_good(d, quality.train(d, labels))):
        assert kept.columns == d.columns and all(r["__n"] == "__n" and r["row"] == "row" for r in kept.collect())
    assert simhash.keep_first(d).count() == 8 and decontaminate.drop_contaminated(d, bench).count() == 7
    some = licenses.scan(d, ["doc_id", "__p", "__row", "__text"]).collect()
    assert [(r.doc_id, r["__p"], r["__row"], r.license) for r in some] == [(3, "__p", "__row", "MIT/notice")]
    assert sharding.place(d, "doc_id").where("__shard LIKE 'shard-%'").count() == 10
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), *INTERNAL)
    assert topk.search(topk.quantise(vectors)).count() == 9
    pages = d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), *INTERNAL)
    assert html_text.extract(pages, ["page_id"]).count() == 10


def test_all_are_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries())] == []
    assert set(oracle_sql()) <= set(queries())


# 1


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("piece_bpe_32k.model")
    pieces = [("<unk>", 0.0), *token_counts.pieces(path), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, True))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abc the ing é\n ▁日👍🏽\t01.,") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)


def test_token_counts_ties():
    # "ab" + "c" and "a" + "bc" score the same: the longest last piece was found first; "abc" needs one.
    c = token_counts.Counter([("a", -1.0), ("b", -9.0), ("c", -1.0), ("ab", -1.0), ("bc", -1.0), ("▁", -1.0)])
    assert c.word("abc") == 2 and c.word("ab") == 1 and c.word("é") == 2 and c.count("") == 0


# 2


PAGE = """<html><head><title>t</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class=has-sidebar>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, yes, all.</div>
<div class=wrap><div class="post content"><h1>Title &amp; more</h1><p>One,  two
&nbsp; three<br>four <b>bold <i>x</b> y</i><p>Five, six, seven, eight.<div class="ad">buy, now</div><ul><li>i<li>j</ul>
<form><input name=q>search</form><!-- hidden --><div class="comments"><p>first, comment, of, many</p></div></div>
<aside>side, bar</aside><div id=sidebar><p>a, b, c, d, e</p></div></div><footer>&copy; me</footer></body></html>"""


def test_html_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)], "page_id bigint, url string, html string")
    got = html_text.extract(pages, ["page_id", "url"]).orderBy("page_id").collect()
    want = "Title & more\nOne, two three four bold x y\nFive, six, seven, eight.\ni\nj"
    assert [r.text for r in got] == [want, want, "", ""] and got[0].n_chars == len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>T</h1><p>a &lt;b&gt; &#233; &eacute;</p></article>", "T\na <b> é é"),
        ("<article><p>cut off in a ta<a hre", "cut off in a ta"),
        ("<article><p>x <3 y & z</p>", "x <3 y & z"),
        ("<main><header><nav>m</nav></header><section><p>one</p></section><section><p>two</p></section></main>", "one\ntwo"),
        ("<div>" * 3000 + "<p>deep, text</p>", "deep, text"),
        ("plain", "plain"),
        ("<article class=post><p>text</p></article><div id=comments><article class=comment-body><p>me, too</p></article></div>", "text"),
        ("<article class='post comments-open'><p>text</p></article>", "text"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p>text</p><ul><li><a href=1>source one</a><li><a href=2>source two</a></ul></article>", "text\nsource one\nsource two"),
        ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><object>seen</object></article>", "if x=2 then\nseen"),
        ("<article><p class='notice-period'>a month</p><p class=share>of all</p><section class=related-work><p>others</p></section></article>", "a month\nof all\nothers"),
        ("<article><p>text</p><div class='cookie-notice'>ok?</div><div class=share-buttons>tweet</div><ul class=related-links><li>x</ul></article>", "text"),
        ("<i><div><b>a</i>b</div>c", "ab"),
    ],
)
def test_html_cases(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<article><p>x</p>" + "<b>" * 50000 + "</i>" * 50000, "<i><div>" + "<b>" * 50000 + "</i>" * 50000, "<ul>" * 50000 + "<li>" * 50000])
def test_html_time_is_linear(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20  # quadratic time is minutes


def test_html_ties_go_to_the_first():
    box = "<div><p>one, two, three, four, five, six, seven</p></div>"
    assert html_text.main_text(f"<section>{box}</section><section>{box.replace('one', 'uno')}</section>").startswith("one")


# 3


def test_lm_base_scores_and_learning(spark):
    texts = ODD + sentences(300, 1)
    ids = [*range(len(texts) - 1), None]
    got = lm_scoring.score(docs(spark, texts, ids), table_bits=16).toPandas()
    assert len(got) == len(texts)
    train = Counter()
    for i, t in zip(ids, texts, strict=True):
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(lm_scoring.tokens(t))
    n, v = sum(train.values()), len(train)
    by_id = {i: t for i, t in zip(ids, texts, strict=True) if i is not None}
    for r in got.itertuples():
        assert r.train_tokens == n
        if r.doc_id == r.doc_id:
            found = Counter(lm_scoring.tokens(by_id[int(r.doc_id)]))
            assert r.n_tokens == sum(found.values())
            assert r.n_known == sum(k for w, k in found.items() if w in train)
            assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 1)
            want = sum(k * math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w, k in found.items())
            assert r.base_score == pytest.approx(want, rel=1e-9)
        else:
            assert r.held_out
        assert r.score < 0 and math.isfinite(r.score)


def test_lm_does_not_learn_from_held_out_texts(spark):
    texts = sentences(120, 2)
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 1]
    changed = list(texts)
    changed[held[0]] = "qqqq zzzz " * 50
    a = lm_scoring.score(docs(spark, texts), table_bits=14).toPandas().set_index("doc_id").score
    b = lm_scoring.score(docs(spark, changed), table_bits=14).toPandas().set_index("doc_id").score
    rest = [i for i in range(120) if i != held[0]]
    assert np.allclose(a[rest], b[rest], rtol=1e-4)  # batches, and so the order of learning, are by hash
    assert b[held[0]] < a[held[0]]


@pytest.mark.parametrize("kind", ["double", "smallint", "string", "decimal(20,2)"])
def test_lm_takes_any_id(spark, kind):
    d = docs(spark, sentences(20, 3)).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = lm_scoring.score(d, table_bits=12)
    assert got.schema["doc_id"].dataType == d.schema["doc_id"].dataType and {r.doc_id for r in got.collect()} == {r.doc_id for r in d.collect()}


def test_lm_copies_are_likelier(spark):
    texts = sentences(200, 4, vocabulary=3000)
    got = lm_scoring.score(docs(spark, texts + texts[:20]), table_bits=16).toPandas().set_index("doc_id")
    each = got.score / got.n_tokens
    learned = [i for i in range(20) if zlib.crc32(str(200 + i).encode()) % 5 != 1]  # the copy is
    assert each[learned].min() > each[range(20, 200)].max()


def plain_bits(text, code, info, bits):
    """The bits of a text by loops: for each its slots, the bit, and per guess (sure, place, right)."""
    m64 = (1 << 64) - 1
    phi, mix = int(lm_scoring._PHI), int(lm_scoring._MIX)

    def mixed(h):
        h = h * mix & m64
        return (h ^ h >> 29) * phi & m64

    words = [w + b" " for w in lm_scoring.tokens(text)[:-1]] + [b"\n"]
    stream, at = b"".join(words), 0
    last: dict[bytes, list[int]] = {}  # what followed each beginning of a word in this text
    out = []
    level = lambda n: 1 + sum(n >= x for x in (2, 4, 9, 27))
    paths = [list(zip(code.node[s : s + n], code.bit[s : s + n], strict=True)) for s, n in zip(code.start, code.length, strict=True)]
    for w, (agree, other, sure) in zip(words, info.tolist(), strict=True):
        so_far, power = 0, 1
        for place, c in enumerate(w):
            three = [stream[at - k] if at >= k else 10 for k in (1, 2, 3)]
            word = mixed(so_far + place & m64)
            hashes = [mixed(three[0] << 16 | three[1] << 8 | three[2]), word]
            seen = last.setdefault(w[:place], [])
            guesses = [(0, 0), (0, 0)]
            if sure and place <= agree and place < lm_scoring.LETTERS:
                guesses[0] = (sure, w[place] if place < agree else other)
            if seen:
                guesses[1] = (2 * level(len(seen)) - 1 + (len(seen) > 1 and seen[-1] == seen[-2]), seen[-1])
            alive = [bool(s) for s, _ in guesses]
            for depth, (node, bit) in enumerate(paths[c]):
                mine = []
                for g, (s, guess) in enumerate(guesses):
                    right = bool(s and paths[guess][depth][1] == bit) if alive[g] else False
                    mine.append((s if alive[g] else 0, min(place, 3), right))
                    alive[g] &= right
                slots = [((h >> 32) + int(node) & 0xFFFFFFFF) & ((1 << bits) - 1) for h in hashes]
                out.append((slots, int(bit), mine))
            seen.append(c)
            so_far = so_far + (c + 1) * power & m64
            power = power * phi & m64
            at += 1
    return out


def plain_score(text, m, info):
    total = 0.0
    for slots, bit, guesses in plain_bits(text, m.code, info, m.table_bits):
        x = [float(t[s]) for t, s in zip(m.odds, slots, strict=True)]
        for g, (sure, place, right) in enumerate(guesses):
            odds = float(m.record[g][2 * (sure * lm_scoring.PLACES + place) + 1]) if sure else 0.0
            x.append(odds if right == bool(bit) else -odds)
        gate = guesses[0][0] or (guesses[1][0] + lm_scoring.SURE - 1 if guesses[1][0] else 0)
        z = sum(float(m.weights[j][gate]) * v for j, v in enumerate(x))
        step = int((min(max(z, -8), 8) + 8) * (lm_scoring.STEPS - 1) / 16 + 0.5)
        p = (1 / (1 + math.exp(-z)) + float(m.map[gate * lm_scoring.STEPS + step])) / 2
        total += math.log10(min(max(p if bit else 1 - p, 1e-7), 1 - 1e-7))
    return total


def random_model(code, bits, seed=0):
    rng = np.random.default_rng(seed)
    odds = [rng.normal(size=1 << bits).astype(np.float32) for _ in lm_scoring.CONTEXTS]
    record = lm_scoring._record_odds(rng.random((lm_scoring.GUESSES, lm_scoring.SURE * lm_scoring.PLACES, 2)) * 9)
    weights = rng.random((len(odds) + lm_scoring.GUESSES, lm_scoring.GATES)).astype(np.float32) * 0.5
    middle = lm_scoring._squash(np.tile(np.arange(lm_scoring.STEPS), lm_scoring.GATES) / 2 - 8).astype(np.float32)
    return lm_scoring.Model(code, bits, odds, record, weights, middle)


def stream(texts):
    return np.frombuffer(b"".join(b" ".join(lm_scoring.tokens(t)) for t in texts), np.uint8)


def test_lm_scores_are_those_of_a_plain_loop(monkeypatch):
    texts = ["the cat the cat the dog", "", "One word", "aa aa ab aab " * 20, "x" * 40 + " y", "é 日本 é 日本"]
    o = stream(texts)
    w = lm_scoring.Words(o)
    rng = np.random.default_rng(2)
    # Words before predict what follows: here the right word, another, or none.
    other = w.letters() ^ np.where(rng.random(len(w.end)) < 0.5, 0, rng.integers(0, 1 << 32, len(w.end), dtype=np.uint64))
    info = lm_scoring._answer(w.letters(), other, rng.integers(0, 40, len(w.end)), np.full(len(w.end), 20))
    m = random_model(lm_scoring.Code(np.bincount(o, minlength=256)), 12)
    of = np.cumsum(w.new_text) - 1
    want = [plain_score(t, m, info[of == k]) for k, t in enumerate(texts)]
    assert np.allclose(m.score(o, info), want, atol=1e-3)
    monkeypatch.setattr(lm_scoring, "SLICE", 7)  # slices change nothing
    assert np.allclose(m.score(o, info), want, atol=1e-3)


def test_lm_learns_what_a_plain_loop_counts():
    texts = sentences(6, 8, vocabulary=30, words=20)
    o = stream(texts)
    code = lm_scoring.Code(np.bincount(o, minlength=256))
    info = np.zeros((len(lm_scoring.Words(o).end), 3), np.uint8)
    mine = np.array([True, False, True, True, False, True])
    learner = lm_scoring.Learner(code, 10)
    learner.learn(o, info, mine)
    want = [Counter() for _ in lm_scoring.CONTEXTS]
    for t in (t for t, m in zip(texts, mine, strict=True) if m):
        for slots, bit, _ in plain_bits(t, code, np.zeros((len(lm_scoring.tokens(t)), 3), int), 10):
            for c, s in zip(want, slots, strict=True):
                c[s, bit] += 1
    for c, t in zip(want, learner.tables, strict=True):
        got = {(s, b): int(t[s] >> np.uint64(32 * b)) & 0xFFFFFFFF for s in range(1 << 10) for b in (0, 1)}
        assert {k: v for k, v in got.items() if v} == dict(c)


def test_lm_prices_and_learns_equal_bytes_once(monkeypatch):
    once, again = sentences(40, 8, vocabulary=30, words=200), 20
    texts = once * again
    o = stream(texts)
    info = np.zeros((len(lm_scoring.Words(o).end), 3), np.uint8)
    code = lm_scoring.Code(np.bincount(o, minlength=256))
    bits, done = int(code.length[o].sum()), [0]
    expand = lm_scoring.expand

    def counted(*args):
        e = expand(*args)
        done[0] += len(e.bit)
        return e

    monkeypatch.setattr(lm_scoring, "expand", counted)
    m = random_model(code, 12)
    got = m.score(o, info)
    assert done[0] < bits / 5
    assert np.allclose(got.reshape(again, -1), got[: len(once)], atol=1e-3)
    monkeypatch.setattr(lm_scoring, "PIECE", 1 << 12)
    done[0] = 0
    learner = lm_scoring.Learner(code, 12)
    learner.learn(o, info, np.ones(len(texts), bool))
    assert done[0] < bits / 2 and learner.bits.sum() == bits
    for t in learner.tables:
        assert int((t & np.uint64(2**32 - 1)).sum() + (t >> np.uint64(32)).sum()) == bits


def test_lm_probabilities_add_up():
    m = random_model(lm_scoring.Code(np.ones(256)), 10)
    total = 0.0
    for x in range(256):
        if bytes([x]).isspace() and x != 32:
            continue
        o = np.frombuffer(b"ab a" + bytes([x]) + (b"" if x == 32 else b" ") + b"\n", np.uint8)
        w = lm_scoring.Words(o)
        found = next(lm_scoring._slices(o, w, np.zeros((len(w.end), 3), np.uint8), 0, len(w.end), m.code, 10))[1]
        total += 10 ** float(m.log10_bits(found)[found.byte == 4].sum())
    assert 0.9 < total <= 1 + 1e-3  # but for the bytes that no word has


def test_lm_following_words_equal_brute_force():
    rng = np.random.default_rng(9)
    key, follower = rng.integers(0, 6, 300).astype(np.uint64), rng.integers(1, 5, 300).astype(np.uint64) << np.uint64(8)
    n = rng.integers(0, 3, 300)
    held, own = lm_scoring._follow(key, follower, n)
    for i in range(300):
        for less, got in ((0, held), (1, own)):
            if less and not n[i]:
                continue
            counts = Counter()
            for k, f, c in zip(key.tolist(), follower.tolist(), n.tolist(), strict=True):
                if k == key[i]:
                    counts[f] += c
            counts[int(follower[i])] -= less
            best = max(counts, key=lambda f: (counts[f], -f))
            want = lm_scoring._answer(follower[i : i + 1], np.array([best], np.uint64), np.array([counts[best]]), np.array([sum(counts.values())]))
            assert got[i].tolist() == want[0].tolist()


def test_lm_batches_shards_and_learners_change_little(spark, monkeypatch):
    d = docs(spark, ODD + sentences(200, 5))
    a = lm_scoring.score(d, table_bits=14).toPandas().set_index("doc_id").sort_index()
    monkeypatch.setattr(lm_scoring, "BATCH", 4000)
    monkeypatch.setattr(lm_scoring, "SHARD", 3000)
    b = lm_scoring.score(d, table_bits=14).toPandas().set_index("doc_id").sort_index()
    same = ["held_out", "n_tokens", "n_known", "train_tokens"]
    assert (a[same] == b[same]).all().all() and np.allclose(a.base_score, b.base_score)
    words = slice(len(ODD), None)
    assert a.score[words].sum() == pytest.approx(b.score[words].sum(), rel=0.1)  # the order of learning alone


# 4


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    n, dims = 700, 12
    x = np.round(rng.normal(size=(n, dims)) * (rng.random((n, 1)) * 3), 1).astype(np.float32)
    ids = [*range(n - 2), 40, 45]  # two ids come twice
    names = "vec_id bigint, embedding array<float>, score int, row string, tile string, floor double, wide int"
    rows = [(i, [float(c) for c in v], 1, "a", "b", 0.5, 3) for i, v in zip(ids, x, strict=True)]
    odd = [(5000, None), (5020, [1.0, None]), (5040, [float("nan")] * dims), (5060, [float("inf")] * dims), (None, [1.0] * dims)]
    df = spark.createDataFrame(rows + [(*r, 1, "a", "b", 0.5, 3) for r in odd], names)
    q = np.floor(64 * x.astype(float)).astype(np.int64)
    want = []
    for i in range(n):
        if ids[i] % 20 == 0:
            s = q @ q[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
            want += [(ids[i], k + 1, ids[j], int(s[j])) for k, j in enumerate(order)]
    for tile in (256, 100_000):
        got = topk.search(topk.quantise(df), tile=tile).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_topk_prunes_and_breaks_ties():
    d = np.zeros((1000, 3), np.int64)
    d[600:603] = 7
    t = topk.Tile(np.arange(1000), np.arange(1000), d, 100)
    top = t.best(np.array([-1]), np.array([[1, 1, 1]]), 5)
    ids, scores = t.scores(np.sort(top[0])[::-1])
    assert ids.tolist() == [600, 601, 602, 0, 1] and scores.tolist() == [21, 21, 21, 0, 0]


def test_topk_prunes_clustered_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(64 * (np.repeat(rng.normal(size=(32, 24)) * 2, 256, axis=0) + 0.2 * rng.normal(size=(8192, 24)))).astype(np.int64)
    x = x[rng.permutation(len(x))]
    order = topk._together(x.astype(float))
    t = topk.Tile(order, order, x[order])
    top = t.best(np.arange(0, len(x), 20), x[::20], 20)
    assert t.pruned > 0.5 * (t.scored + t.pruned)
    ids, _ = t.scores(top)
    for k, i in enumerate(range(0, len(x), 20)):
        s = x @ x[i]
        s[i] = -(1 << 60)
        assert sorted(s[ids[k]].tolist()) == sorted(np.sort(s)[-20:].tolist())


def test_topk_refuses_scores_that_do_not_fit():
    big = np.full((2, 2), 1 << 24, np.int64)
    with pytest.raises(ValueError, match="don't fit"):
        topk.Tile(np.arange(2), np.arange(2), big).best(np.arange(2), big, 1)


def test_topk_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.search(topk.quantise(df)).collect()] == [(0, 1, 1, 64 * 128)]


# 5


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT/text"]
    texts = [*ODD, "Intro.\nReleased under the MIT License.\nMore text here", mit, mit.replace("charge", "cost", 1).upper(), "x\n\n" + mit + "\n\ny", "Licensed under CC BY-NC 4.0."]
    got = licenses.scan(docs(spark, texts + texts[-1:]), ["doc_id", "source"]).collect()
    k = len(ODD)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.license, r.score))
    assert {i: sorted(v)[0][0] for i, v in found.items()} == {
        k: "MIT/notice", k + 1: "MIT/text", k + 2: "MIT/text", k + 3: "MIT/text", k + 4: "CC-BY-NC-4.0/notice", k + 5: "CC-BY-NC-4.0/notice",
    }
    assert found[k + 1] == [("MIT/text", 1.0)] and 0.9 < found[k + 2][0][1] < 1


def test_license_sizes_lose_nothing():
    for n in range(1, 60):
        able = {a for a in range(1, 400) if 2 * min(a, n) / (a + n) >= licenses.THRESHOLD - 1e-12}
        assert able <= set(licenses.sizes(n, licenses.THRESHOLD))


APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {0}General Public License for more details.

You should have received a copy of the GNU {0}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD_FILE = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licenses_across_lines_and_within_them(spark):
    filler = sentences(40, 3)
    heads = [APACHE_HEADER, GPL_HEADER.format(""), GPL_HEADER.format("Lesser "), GPL_HEADER.format("Affero "), BSD_FILE.format(""), BSD_FILE.format(BSD_THIRD)]
    want = ["Apache-2.0/header", "GPL-3.0/header", "LGPL-3.0/header", "AGPL-3.0/header", "BSD-2-Clause/text", "BSD-3-Clause/text"]
    texts = ["\n".join([*filler[:20], h, *filler[20:]]) for h in heads]
    texts += ["It was released under the MIT License. " + filler[0], "Released under the MIT License.\n" + filler[1] + "\n\nthen " + filler[2], filler[3]]
    found = {}
    for r in licenses.scan(docs(spark, texts), ["doc_id"]).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.score, r.passage))
    assert sorted(x[0] for x in found[0]) == ["Apache-2.0/header", "Apache-2.0/notice"]  # its first line is a passage of its own
    for i, name in enumerate([*want, "MIT/notice", "MIT/notice"]):
        assert i == 0 or [x[0] for x in found[i]] == [name], i
        assert all(x[1] >= 0.85 for x in found[i])
    assert found[6][0][1:] == (1.0, "released under the mit license") == found[7][0][1:]
    assert 8 not in found


def test_one_line_headers_are_their_own_licences(spark):
    names = ["GPL-3.0/header", "LGPL-3.0/header", "AGPL-3.0/header", "LGPL-2.1/header", "BSD-3-Clause/text", "BSD-2-Clause/text"]
    lines = [" ".join(licenses.TEMPLATES[n].split()) for n in names]
    texts = [x for line in lines for x in (line, f"Some words before it. {line} And some words behind it.")]
    got = {}
    for r in licenses.scan(docs(spark, texts), ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.score))
    assert {i: [x[0] for x in v] for i, v in got.items()} == {i: [names[i // 2]] for i in range(12)}
    # A line that is near enough as a whole counts as a whole.
    assert all(v[0][1] == 1.0 if i % 2 == 0 else 0.9 < v[0][1] < 1.0 for i, v in got.items())


def plain_windows(text, templates, threshold):
    """All runs of words from one of a template's bigrams to another, compared by counting; the best of those that overlap."""
    words = licenses.words_of(text)
    grams = list(zip(words, words[1:], strict=False))
    found = []
    for name, template in templates.items():
        have = Counter({tuple(g.split(" ")): k for g, k in licenses.bigrams_of(template).items()})
        n = sum(have.values())
        at = [i for i, g in enumerate(grams) if g in have]
        for i in at:
            for j in at:
                if j >= i:
                    c = sum((Counter(grams[i : j + 1]) & have).values())
                    dice = 2 * c / (j - i + 1 + n)
                    if dice >= threshold:
                        found.append((j - i + 1 + n - 3 * c, -dice, name, i, j))
    kept = []
    for w in sorted(found):
        if not any(x[3] <= w[4] and w[3] <= x[4] for x in kept):
            kept.append(w)
    return sorted({(w[2], round(-w[1], 6), w[4] - w[3] + 1, " ".join(words[w[3] : w[4] + 2])) for w in kept})


def test_windows_are_those_of_a_plain_search(spark):
    """On texts whose windows overlap, repeat bigrams and lack words."""
    rng = random.Random(11)
    templates = {"A": "a b c d e f g h", "B": "a b a b c d a b e", "C": "e f g h i j", "D": "x y"}
    texts = []
    for _ in range(120):
        words = rng.choices("abcdefghijxyz", k=rng.randint(0, 5))
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(list(templates.values())).split()
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = rng.choice("abcdez")
            words += part + rng.choices("abcdefghijxyz", k=rng.randint(0, 4))
        texts.append(" ".join(words))
    rows = docs(spark, texts).select(F.struct("doc_id").alias("r"), "text")
    got = {}
    for r in licenses.by_window(rows, ["r"], "text", templates, 0.8).collect():
        got.setdefault(r.r.doc_id, []).append((r.license, r.score, r.n_bigrams, r.passage))
    whole = {r.r.doc_id for r in licenses.by_passage(rows, ["r"], "text", templates, 0.8).collect()}
    # A text that is a passage as a whole has no windows left.
    want = {i: plain_windows(t, templates, 0.8) for i, t in enumerate(texts) if i not in whole}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert sum(map(len, want.values())) > 150


def test_a_bundle_of_many_notices(spark):
    """A file of 160 licences, in paragraphs that hold other words too, takes seconds, not minutes."""
    import time

    filler = sentences(160, 5, words=12)
    bundle = "\n".join(f"{f}. {licenses.TEMPLATES['MIT/text']} Copyright {i}" for i, f in enumerate(filler))
    licenses.scan(docs(spark, ["Released under the MIT License, maybe. " + filler[0]]), ["doc_id"]).collect()
    began = time.perf_counter()
    got = licenses.scan(docs(spark, [bundle.replace("\n", " ")]), ["doc_id"]).groupBy("license").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()
    took = time.perf_counter() - began
    # Equal passages of a text count once.
    assert [(r.license, r.s) for r in got] == [("MIT/text", 1.0)] and took < 40


def test_license_keywords_lose_nothing():
    every = licenses.TEMPLATES
    keys = licenses.keywords(every, licenses.THRESHOLD)
    for text in every.values():
        grams = licenses.bigrams_of(text)
        without = sum(n for g, n in grams.items() if not any(k in w for w in g.split() for k in keys))
        assert 2 * without / (without + sum(grams.values())) < licenses.THRESHOLD


# 6


def test_sharding_table_is_fair_and_steady():
    a = sharding.fill(sharding.SHARDS)
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(a) == sharding.SLOTS
    b = sharding.fill(sharding.SHARDS[:-1])
    gone = len(sharding.SHARDS) - 1
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != gone)
    assert moved < 0.05 * len(a)
    with pytest.raises(ValueError):
        sharding.fill(["a", "a"])
    with pytest.raises(ValueError):
        sharding.fill(["a"], 16)


def test_sharding_places_all_rows(spark, tmp_path):
    d = docs(spark, ["a"] * 50, [*range(48), None, 3])
    placed = sharding.place(d, "doc_id")
    assert placed.count() == 50 and len({r["__shard"] for r in placed.where("doc_id = 3").collect()}) == 1
    table = sharding.fill(sharding.SHARDS)
    for r in placed.collect():
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r["__slot"] == slot and r["__shard"] == sharding.SHARDS[table[slot]]
    sharding.write(d, "doc_id", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    assert sharding.loads(placed).agg(F.sum("n_rows")).first()[0] == 50


# 7


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return [least[find(i)] for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    base = sentences(30, 5, words=150)
    rng = random.Random(6)
    near = []
    for t in base[:10]:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    texts = ODD + base + near + base[:5] + ["One TWO", "one two", "one two three"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: r for r in simhash.components(docs(spark, texts, ids)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(prints, ids)
    for i, p, c in zip(ids, prints, want, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", c)
    kept = simhash.keep_first(docs(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs(spark, []).columns


def test_simhash_chunks_lose_no_link(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {s ^ (1 << a) ^ (1 << b) for s in seeds for a in range(0, 64, 3) for b in range(0, 64, 5)} | set(seeds)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    for chunk in (4096, 7):
        edges = simhash.links(df, chunk)
        roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
        want = brute_components(sorted(prints), sorted(range(len(prints))))
        groups = {}
        for p, c in zip(sorted(prints), want, strict=True):
            groups.setdefault(c, set()).add(roots.get(p - (1 << 64) if p >> 63 else p, p))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_ids_null_and_repeated(spark):
    got = simhash.components(docs(spark, ["a b c d"] * 3 + ["z y x w"], [None, 5, 5, None])).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(None, 5): 1, (5, 5): 2, (None, None): 1}
    assert sorted(str(r.doc_id) for r in simhash.keep_first(docs(spark, ["a b c d"] * 3 + ["z y x w"], [None, 5, 5, None])).collect()) == ["5", "None", "None"]


def test_counters_count():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x[100:] = x[:200] ^ np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    hits = dict(simhash.linked(x, simhash.sliced(x), len(x)))
    for k in range(len(x)):
        want = {j for j in range(len(x)) if int(x[k] ^ x[j]).bit_count() <= 2}
        assert {j for j in range(len(x)) if hits[k] >> j & 1} == want


# 8


def test_quality_learns_and_keeps(spark):
    good = sentences(200, 9)
    bad = [" ".join(w + "$$$" for w in t.split()) for t in sentences(200, 10)]
    texts = good + bad + ODD
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 400)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(d, labels)
    got = quality.score(d, model).toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & (got.doc_id < 400)]
    assert len(held) > 40 and ((held.doc_id < 200) == (held.predicted == 1)).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    kept = quality.keep_good(d, model)
    assert {r.doc_id for r in kept.collect()} == set(got[got.predicted == 1].doc_id) and kept.schema == d.schema


def test_quality_is_tables_alone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.NAMES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # neither feature alone says anything
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.8 and len(m.pairs) == quality.PAIRS


def test_quality_without_labels(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(d, quality.train(d, none)).collect()} == {0.5}


# 9


def brute_hits(words, items, window=13):
    hit, found = set(), set()
    for item, text in items:
        w = decontaminate.words_of(text)
        k = min(window, len(w))
        grams = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
        for a in range(len(words) - k + 1):
            if k and tuple(words[a : a + k]) in grams:
                hit.update(range(a, a + k))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = "abc"[: rng.choice([1, 2, 3])]
        window = rng.choice([3, 4, 13])
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))) for i in range(rng.randint(1, 5))]
        a = decontaminate.Automaton(items, window)
        words = decontaminate.words_of(" ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 60))))
        spans, found = a.scan(words)
        assert ({x for s in spans for x in range(*s)}, found) == brute_hits(words, items, window)


def test_decontamination(spark):
    items = sentences(20, 11, words=30) + ["short item", "", None, "..."]
    long = items[0].split()
    texts = ODD + ["Pre " + items[0].upper().replace(" ", "-") + " post", "a SHORT, item.", " ".join(long[:12]), " ".join(long[3:16]), " ".join(["w"] * 400 + long[:13])] + sentences(20, 12)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(0, items[0], "x")], "item_id bigint, text string, doc_id string")
    d = docs(spark, texts)
    for most in (decontaminate.MAX_WORDS, 50):  # in one pass, and in several
        got = {r.doc_id: r for r in decontaminate.report(d, bench, most=most).collect()}
        for i, t in enumerate(texts):
            words = decontaminate.words_of(t)
            hit, found = brute_hits(words, [(str(k), x) for k, x in enumerate(items)])
            named = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            want = (len(words), len(hit), len(found), named, bool(hit) and 20 * len(hit) >= len(words))
            assert tuple(got[i])[1:] == want
    clean = decontaminate.drop_contaminated(d, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated} and clean.columns == d.columns
    k = len(ODD)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, bench).collect()}
    assert cut[k + 4] == " ".join(["w"] * 400) + " " and k not in cut and cut[0] is None


# 10


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(13)
    marks = ["<|startoftext|>", "<|endoftext|>", "'s", "'LL", "Σς", "İ", "é"]
    texts = ODD + ["".join(rng.choice([*"abcthein 019!?\n\té日👍🏽Ⅷ²", *marks]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("etaonhrisd") for _ in range(20000)), "a" * 9000]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in bpe.digests(d, path).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(d, path), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert back[8] == "the cat sat on the mat "


def test_bpe_keeps_constant_memory():
    v = bpe.codec(vocabulary("word_bpe_49k.json")).v
    e, most, out = bpe.Encoder(v), 0, []
    rng = random.Random(1)
    word = "".join(rng.choice("thein") for _ in range(60000))
    for at in range(0, len(word), 500):
        out += e.feed(word[at : at + 500])
        most = max(most, len(e.found))
    assert most < 2 * bpe.BLOCK + 500 and sum(len(v.texts[t]) for t in out) > len(word) - 2 * bpe.BLOCK


def test_bpe_digest_decodes_ids_a_few_at_a_time(monkeypatch):
    c = bpe.codec(vocabulary("word_bpe_49k.json"))
    text = " ".join(sentences(40, 21)) + " " + "ab" * 20000 + "<|endoftext|> end é"
    ids = [i for part in c.encode(text) for i in part]
    assert max(map(len, c.encode(text))) <= bpe.SEGMENT and max(map(len, c.encode("thein" * 40000))) < 2 * bpe.BLOCK + bpe.BLOCK
    fed = []
    feed = bpe.Decoder.feed
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, part: fed.extend(part) or feed(self, part))
    n, ids_hash, text_hash = bpe.digest(c, text)
    assert fed == ids and n == len(ids) and ids_hash == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert text_hash == hashlib.sha256(" ".join(c.v.texts[i] for i in ids).encode()).hexdigest()
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    assert bpe.digest(c, text) == (n, ids_hash, text_hash)


def test_bpe_lookahead_follows_the_merges():
    assert bpe.sufficient_lookahead([("a", "b"), ("ab", "c"), ("abc", "ab")]) == 5 and bpe.sufficient_lookahead([]) == 1
    v = bpe.codec(vocabulary("word_bpe_49k.json")).v
    assert v.lookahead >= max(len(v.symbols(t)) for t in v.ids if t not in v.added)


def test_decoder_is_incremental():
    v = bpe.codec(vocabulary("word_bpe_49k.json")).v
    ids = [t for w in ("日本", "é") for part in bpe.encode_word(w, v) for t in part]
    d = bpe.Decoder(v)
    assert "".join([*(d.push(t) for t in ids), d.finish()]) == "日本 é "


def test_bpe_reads_short_words_at_once_as_the_encoder_does():
    v = bpe.Vocabulary(vocabulary("word_bpe_49k.json"))
    words = ["a", "the", "entwicklung", "naïve", "日本語", "x" * 64, "zq" * 30, "1234567", "\x1fé", "😀😀"]
    for _ in range(2):  # with and without what was tried before
        for w in words:
            assert bpe.encode_short(w, v) == [i for ids in bpe.encode_word(w, v) for i in ids]
