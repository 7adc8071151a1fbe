"""Queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, conversations, decontaminate, html_text, lexical, licenses, lm_scoring, mixing, quality, sharding, simhash, token_counts, topk,
)
from .common import table

#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """A vocabulary file's path."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.quantise(table(spark, sf_dir, "embeddings")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), "doc_id")
    return placed.select("doc_id", F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")), F.col("copies"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts, op2_html_extraction, op3_lm_scoring, op4_topk_search, op5_license_scan, op6_sharding,
        op7_simhash_dedup, op8_quality_classifier, op9_decontamination, op10_bpe,
        op11_mixing, op12_conversation_repair, op13_lexical_search,
    ]
    return {f.__name__: f for f in found}


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(coalesce({ASCII_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(coalesce({ASCII_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), grams AS (
  SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
), found AS (
  SELECT g.doc_id, g.i, g.k, v.item_id FROM grams g JOIN windows v ON g.k = v.k AND g.gram = v.gram
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.named, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


OP4_SQL = """
WITH ok AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, cast(list_inner_product(cast(q.v AS DOUBLE[]), cast(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q JOIN ok d ON q.vec_id % 20 = 0 AND q.r <> d.r
)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""


def op5_sql() -> str:
    grams = ", ".join(
        f"('{name}', {sum(found.values())}, '{gram}', {n})"
        for name, text in sorted(licenses.TEMPLATES.items())
        for found in (licenses.bigrams_of(text),)
        for gram, n in found.items()
    )
    t = licenses.THRESHOLD
    return f"""
WITH tg(license, n, gram, k) AS (VALUES {grams}), t AS (SELECT DISTINCT license, n FROM tg),
flat AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_replace({ASCII_LOWER}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS f FROM documents
), units AS (
  SELECT DISTINCT r, doc_id, trim(regexp_replace(replace(p, chr(10), ' '), ' +', ' ', 'g')) AS p FROM (
    SELECT r, doc_id, unnest(list_concat(
      string_split(f, chr(10)), string_split_regex(f, '\\n *\\n'), [f])) AS p FROM flat)
), sized AS (
  SELECT *, row_number() OVER () AS u, string_split(p, ' ') AS w, len(string_split(p, ' ')) - 1 AS n FROM units
), near AS (
  SELECT s.*, t.license, t.n AS tn FROM sized s JOIN t
    ON s.n >= 1 AND s.n >= t.n * {t} / (2 - {t}) - 1e-9 AND s.n <= t.n * (2 - {t}) / {t} + 1e-9
), wanted AS (
  SELECT DISTINCT u, w, n FROM near
), ug AS (
  SELECT u, gram, count(*) AS k FROM (SELECT u, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT u, w, unnest(range(1, n + 1)) AS i FROM wanted))
  GROUP BY u, gram
), dice AS (
  SELECT near.u, near.doc_id, near.p, near.n, near.license, 2.0::DOUBLE * sum(least(ug.k, tg.k)) / (near.n + near.tn) AS score
  FROM near JOIN ug ON near.u = ug.u JOIN tg ON tg.license = near.license AND tg.gram = ug.gram
  GROUP BY near.u, near.doc_id, near.p, near.n, near.license, near.tn
)
SELECT doc_id, license, round(score, 6) AS score, cast(n AS BIGINT) AS n_bigrams, p AS passage FROM (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, license) AS best FROM dice WHERE score >= {t}
) WHERE best = 1
"""


def op6_sql() -> str:
    filled = " ".join(map(str, sharding.fill(sharding.SHARDS)))
    return f"""
SELECT doc_id, slot, 'shard-' || lpad(string_split('{filled}', ' ')[slot + 1], 2, '0') AS shard FROM (
  SELECT doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
    % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
"""


#: CRC-32 of a text, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS k FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, {CRC32} % 20 AS f FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT again AND NOT blank) AS truncated,
    count_if(before || '>' || c NOT IN ('s>u', 'u>a', 'a>u')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id
), leads(state, c, next) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), wants(state, next, role) AS (
  VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), inserts(state, next, price, letters, said) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
    (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])
), edits AS (
  SELECT conv_id, i, state, state AS next, 3 AS price, 'D' AS letter, cast([] AS VARCHAR[]) AS said FROM marked, (SELECT DISTINCT state FROM wants)
  UNION ALL
  SELECT conv_id, i, state, next, cast(cut AS INTEGER), 'K', [marked.role || ':' || text] FROM marked JOIN leads USING (c) WHERE NOT blank AND NOT again
  UNION ALL
  SELECT conv_id, i, state, next, 2 + cast(cut AS INTEGER), 'R', [wants.role || ':' || text] FROM marked, wants WHERE NOT blank AND NOT again
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, next AS state, {{'cost': price, 'audit': letters, 'said': cast(said AS VARCHAR[])}} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations), inserts WHERE state = 0
  UNION ALL
  SELECT p.conv_id, p.i + 1, x.next, min({{'cost': p.best.cost + e.price + x.price, 'audit': p.best.audit || e.letter || x.letters,
    'said': p.best.said || e.said || cast(x.said AS VARCHAR[])}})
  FROM paths p JOIN edits e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = p.i + 1 AND e.state = p.state JOIN inserts x ON x.state = e.next
  GROUP BY p.conv_id, p.i, x.next
), ended AS (
  SELECT p.conv_id, min(p.best) AS best FROM paths p LEFT JOIN counted n ON p.conv_id IS NOT DISTINCT FROM n.conv_id
  WHERE p.i = coalesce(n.n, 0) AND p.state IN (0, 3) GROUP BY p.conv_id
)
SELECT e.conv_id, cast(coalesce(gaps, 0) AS BIGINT) AS gaps, cast(coalesce(blank, 0) AS BIGINT) AS blank, cast(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  cast(coalesce(truncated, 0) AS BIGINT) AS truncated, cast(coalesce(illegal, 0) AS BIGINT) AS illegal, cast(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit,
  sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM ended e LEFT JOIN counted n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({ASCII_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(coalesce({ASCII_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), total AS (
  SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, doc_id, n, term
), df AS (
  SELECT term, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, total.n
), asked AS (
  SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM b) GROUP BY q, item_id, term
), scored AS (
  SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * total.n) // total.l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), total GROUP BY q, item_id, r, doc_id
)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk_search": OP4_SQL,
        "op5_license_scan": op5_sql(),
        "op6_sharding": op6_sql(),
        "op9_decontamination": OP9_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }
