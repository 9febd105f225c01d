"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import byte_bpe, decontaminate, filter_audit, html_text, language_id, local_parse, media, pii, prefix_trie, quality, simhash, token_store, toxicity
from lakewright.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def register(function):
    QUERIES[function.__name__] = function
    return function


@register
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents", "doc_id", "text", "lang"))


@register
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents", "doc_id", "text"))


@register
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return toxicity.score_documents(docs, table(spark, folder, "labels", "doc_id", "toxic"))


#: What op4 appends to each document.
END_ID = 2


@register
def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return token_store.store_and_read(docs, TOKENIZER, end_id=END_ID, id_width=2, ids=False)


@register
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@register
def op6_media(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_of_texts(table(spark, folder, "documents", "doc_id", "text"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS run FROM (
  SELECT item, w, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS run FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM d, z WHERE len(w) >= size)),
hit AS (SELECT doc_id, s, size, item FROM dw JOIN iw USING (size, run)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY ALL),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@register
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, table(spark, folder, "benchmark", "item_id", "text")).drop("h", "hit_items", "spans")


@register
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, ids=False)


@register
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return quality.score_documents(docs, table(spark, folder, "labels", "doc_id", "quality", "toxic"))


@register
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(table(spark, folder, "pages", "page_id", "url", "html"))


#: CRC-32 of the decimal conv_id, bit by bit, gives the turns that it is lent.
_LENT = """(xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6)"""
ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {_LENT} AS h, c - c % 100 AS b FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS part, i, s, n FROM h JOIN t ON t.c = h.b AND t.i <= h.h UNION ALL SELECT c, 1, i, s, n FROM h JOIN t USING (c) WHERE t.i > h.h),
w AS (SELECT c, list(s ORDER BY part, i) AS ss, list(n ORDER BY part, i) AS ns FROM r GROUP BY c),
p AS (SELECT c, len(ss) AS size, d, array_to_string(ss[1:d], '') AS k, CASE WHEN d = 0 THEN 0 ELSE ns[d] END AS n
  FROM (SELECT h.c, coalesce(ss, []) AS ss, coalesce(ns, []) AS ns FROM h LEFT JOIN w USING (c)), LATERAL (SELECT unnest(generate_series(0, len(ss))) AS d)),
v AS (SELECT d, k, min(c) AS conv, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends FROM p GROUP BY d, k),
f AS (SELECT d - 1 AS d, k[:64 * (d - 1)] AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN f USING (d, k)),
a AS (SELECT g AS d, k[:64 * g] AS k, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved FROM x, LATERAL (SELECT unnest(generate_series(0, d)) AS g) GROUP BY ALL)
SELECT x.conv AS conv_id, x.d::BIGINT AS depth, u.conv AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN a USING (d, k) LEFT JOIN v u ON u.d = x.d - 1 AND u.k = x.k[:64 * (x.d - 1)]
"""


@register
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text")).drop("prefix_digest")


ORACLES["op13_filter_audit"] = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, (len(words) < 50) AS a, (100 * len(list_distinct(words)) < 65 * len(words)) AS b,
  (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, LATERAL (SELECT unnest(generate_series(1, 5)) AS step)),
z AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost FROM g, k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""


@register
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, folder, "labels", "doc_id", "quality", "toxic"))


@register
def op11_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return local_parse.fingerprints(table(spark, folder, "documents", "doc_id", "text"))
