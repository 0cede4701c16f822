"""The dealt operators as driver queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawlkit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query()
def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LEAK_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LEAK_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LEAK_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
        FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
depth AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, depth, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
m AS (SELECT rid, i, n, item FROM grams JOIN win USING (g, n)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, i, n FROM m) AS s, unnest(generate_series(s.i, s.i + s.n - 1)) AS u(p) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
""")
def op10_suffix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.decontaminate import leak_report

    found = leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query()
def op2_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.langid import language_report

    return language_report(table(spark, sf_dir, "documents"))


@query()
def op3_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query()
def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query()
def op7_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""")
def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.warc import archive_report

    return archive_report(table(spark, sf_dir, "pages"))


@query()
def op5_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.embeddings import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"))


# what is left of a page when head, menu, advert, footer and comments are cut away
@query(r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?(?:</footer>|$)|<(script|style)[^>]*>.*?</(script|style)>', chr(10) || '<br>', 'g') AS body FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(body, '(?i)</?(?:h1|p|br|article|body|html)[^>]*>')) AS block, generate_subscripts(regexp_split_to_array(body, '(?i)</?(?:h1|p|br|article|body|html)[^>]*>'), 1) AS i FROM a),
t AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM b),
j AS (SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text FROM t GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
""")
def op8_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawlkit.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))
