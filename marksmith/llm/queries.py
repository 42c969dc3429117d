"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, exact_dedup, gif_media, license_scan, packing, pii, quality, sentencepiece_bpe, simhash_dedup, token_store, toxicity, url_filter, whitening
from .common import table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.read_back(gif_media.store(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), digest=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.domain_table(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_pii, op2_gif_media, op3_exact_dedup, op4_quality, op5_sentencepiece, op6_packing, op7_url_filter, op8_toxicity, op9_simhash, op10_token_store,
            op11_conversation_trie, op12_license_scan, op13_whitening,
        )
    }


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op7_sql() -> str:
    domains = ", ".join(f"'{d}'" for d in url_filter.LISTED_DOMAINS)
    fits = "\n".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = "\n".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in url_filter.RULES)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM c),
l AS (SELECT unnest([{domains}]) AS domain)
SELECT page_id, host, path, rule,
       CASE {verdicts}
            WHEN EXISTS (SELECT 1 FROM l WHERE host = domain OR ends_with(host, '.' || domain)) THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""


#: crc32 of a text of digits: for each byte the byte itself, then eight steps of one bit.
CRC32_SQL = """
xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1 FOR k IN range(8)])))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)
"""

OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, length(coalesce(text, '')) AS n, turn
           FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT c, digest, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS rank FROM t),
h AS (SELECT c, c - c % 100 AS anchor, {CRC32_SQL} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
shared AS (SELECT h.c, r.rank AS depth, r.digest, r.n FROM h JOIN r ON r.c = h.anchor AND r.rank <= h.h),
m AS (SELECT h.c, h.h, count(s.c) AS m FROM h LEFT JOIN shared s ON s.c = h.c GROUP BY 1, 2),
turns AS (SELECT * FROM shared UNION ALL SELECT r.c, r.rank - m.h + m.m, r.digest, r.n FROM r JOIN m ON r.c = m.c WHERE r.rank > m.h),
paths AS (SELECT c, string_agg(digest, '' ORDER BY depth) AS path, count(*) AS len FROM turns GROUP BY c),
every AS (SELECT h.c, coalesce(p.path, '') AS path, coalesce(p.len, 0) AS len FROM h LEFT JOIN paths p ON p.c = h.c),
rows AS (SELECT e.c, d.depth, substr(e.path, 1, 64 * d.depth) AS node, e.len, coalesce(t.n, 0) AS n
         FROM (SELECT c, path, len, unnest(range(len + 1)) AS depth FROM every) d JOIN every e ON e.c = d.c LEFT JOIN turns t ON t.c = d.c AND t.depth = d.depth),
nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = depth) AS ends FROM rows GROUP BY 1, 2),
kids AS (SELECT substr(node, 1, 64 * (depth - 1)) AS node, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT substr(n.node, 1, 64 * u.up) AS node, sum((k.k IS NULL)::BIGINT) AS leaves, sum((n.n_convs - 1) * n.n) AS saved
          FROM (SELECT node, unnest(range(depth + 1)) AS up FROM nodes) u JOIN nodes n ON n.node = u.node LEFT JOIN kids k ON k.node = n.node GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.k, 0) AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = substr(n.node, 1, 64 * (n.depth - 1))
"""


def op12_sql() -> str:
    tokens = [(label, license_scan.words_of(text)) for label, text in license_scan.TEMPLATES]
    stride = max(len(t) for _, t in tokens)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(sorted(set(t)))}, {license_scan.needed(len(set(t)))})" for label, t in tokens)
    places = ", ".join(
        f"list_transform(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + {len(p.split())}) = {quoted(p.split())}), lambda i: {{'start': i, 'label': '{label}'}})" for p, label in license_scan.PHRASES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM documents),
base AS (SELECT r, doc_id, len(w) AS n_words, flatten([{places}]) AS places FROM d),
blocks AS (SELECT r, w[k * {stride} + 1 : (k + 2) * {stride}] AS block FROM (SELECT r, w, unnest(range(greatest(1, ceil(len(w) / {stride})::BIGINT - 1))) AS k FROM d)),
templates(label, tokens, need) AS (VALUES {templates}),
met AS (SELECT b.r, t.label, len(list_intersect(t.tokens, b.block)) / len(t.tokens) AS share FROM blocks b JOIN templates t ON len(list_intersect(t.tokens, b.block)) >= t.need),
found AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY r)
SELECT b.doc_id, b.n_words, len(b.places) AS n_base, list_min(list_transform(b.places, lambda x: x.start)) AS first_word, list_max(list_transform(b.places, lambda x: x.start)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(b.places, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(b.places, lambda x: x.label), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN len(b.places) > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0)::DOUBLE END AS score
FROM base b LEFT JOIN found f ON f.r = b.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op7_url_filter": op7_sql(), "op11_conversation_trie": OP11_SQL, "op12_license_scan": op12_sql()}
