"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscape.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL query, and hosts whose pages are not wanted where no rule fits.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
BLOCKED_HOSTS = [f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES, BLOCKED_HOSTS).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.decontamination import contamination, digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(contamination(docs, table(spark, sf_dir, "benchmark")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.token_output import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.lm_scoring import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.conversation_trie import prefix_trie, share_openings, turn_arrays

    return prefix_trie(share_openings(turn_arrays(table(spark, sf_dir, "conversations"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomscape.llm.lexical_search import search_documents

    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_text": op4_html_text,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_token_shards": op7_token_shards,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_lexical_search": op13_lexical_search,
}

_URL_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN url ELSE '' END AS url FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
f AS (
  SELECT p.page_id, p.host, p.path, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS best
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)),
b AS (SELECT DISTINCT page_id FROM p, (SELECT unnest({BLOCKED_HOSTS!r}) AS h) x WHERE host = h OR ends_with(host, '.' || h))
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, f.rule, coalesce(f.v, CASE WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND best = 1 LEFT JOIN b ON b.page_id = p.page_id"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _linked(size: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of documents by the similarity of word runs."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE array_to_string(w[k : k + {size - 1}], ' ') END AS run
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= {percent} * (i.n + j.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n ON n.doc_id = id"""


_DEDUP_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({_linked(5, 75)})"

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LEAK_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
u AS (SELECT DISTINCT item_id, m, w[k : k + m - 1] AS words FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
g AS (SELECT doc_id, m, k, w[k : k + m - 1] AS words FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM u) x WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.m, g.k, u.item_id FROM g JOIN u ON u.m = g.m AND u.words = g.words),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_STEP = "lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), {_STEP}), 4294967295)"
_TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT *, 0 AS x FROM t)),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(h.own, h + 1, len(h.own))) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.base),
m AS (SELECT conv_id, len(turns) AS n, d, list_slice(turns, 1, d) AS p FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
k AS (SELECT *, min(conv_id) OVER (PARTITION BY d, p) AS node FROM m),
v AS (
  SELECT node, d, count(*) AS n_convs, coalesce(max(length(p[d].text)), 0) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM k GROUP BY node, d),
w AS (SELECT v.*, k.node AS parent FROM v LEFT JOIN k ON k.conv_id = v.node AND k.d = v.d - 1),
c AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM w WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT k.node, k.d, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM w LEFT JOIN c ON c.node = w.node AND c.d = w.d JOIN k ON k.conv_id = w.node AND k.d <= w.d GROUP BY k.node, k.d)
SELECT w.node AS conv_id, w.d AS depth, parent AS parent_conv_id, n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM w JOIN s ON s.node = w.node AND s.d = w.d LEFT JOIN c ON c.node = w.node AND c.d = w.d"""

_TERMS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
q AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN f ON f.term = q.term JOIN g ON g.term = q.term, a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _URL_SQL,
    "op2_minhash_near_dedup": _DEDUP_SQL,
    "op5_benchmark_decontamination": _LEAK_SQL,
    "op11_ngram_jaccard": _linked(4, 85),
    "op12_conversation_trie": _TRIE_SQL,
    "op13_lexical_search": _SEARCH_SQL,
}
