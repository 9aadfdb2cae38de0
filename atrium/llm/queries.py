"""The registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from atrium.llm import alignment, byte_bpe, language_id, media, near_dedup, one_bit_search, packing, prefix_trie, resampling, secrets, sharding, speculative_bpe, token_table
from atrium.llm.common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_column(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.token_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.findings(docs, secrets.fit(docs))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative_bpe.encode_column(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: Prefixes are told by the MD5 sums of their turns; crc goes through the digits of an id bit by bit (3988292384: the polynomial of CRC-32).
_TRIE_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || '|' || coalesce(role, '') || coalesce(text, '')) AS m,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, m, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS p FROM t),
crc AS (SELECT c, c::VARCHAR AS s, 0 AS i, 8 AS b, 4294967295::UBIGINT AS v FROM (SELECT DISTINCT c FROM t)
    UNION ALL SELECT c, s, CASE WHEN b = 8 THEN i + 1 ELSE i END, CASE WHEN b = 8 THEN 0 ELSE b + 1 END,
        CASE WHEN b = 8 THEN xor(v, ascii(s[i + 1])::UBIGINT) WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END
    FROM crc WHERE NOT (b = 8 AND i = length(s))),
h AS (SELECT c, (xor(v, 4294967295::UBIGINT) % 4)::INT AS h FROM crc WHERE b = 8 AND i = length(s)),
head AS (SELECT h.c, o.p AS d, o.m, o.words FROM h JOIN own o ON o.c = h.c - h.c % 20 AND o.p <= h.h),
taken AS (SELECT h.c, h.h, count(head.d) AS n FROM h LEFT JOIN head ON head.c = h.c GROUP BY ALL),
rebuilt AS (SELECT c, d, m, words FROM head UNION ALL SELECT o.c, o.p - k.h + k.n, o.m, o.words FROM own o JOIN taken k ON k.c = o.c WHERE o.p > k.h),
pre AS (SELECT c, d, words, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS k FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM h),
node AS (SELECT d, k, min(c) AS c, count(*) AS n, max(words) AS words FROM pre GROUP BY ALL),
up AS (SELECT node.*, a.k AS pk, top.c AS pc FROM node LEFT JOIN pre a ON a.c = node.c AND a.d = node.d - 1 LEFT JOIN node top ON top.d = a.d AND top.k = a.k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT up.*, coalesce(kids.n, 0) AS children FROM up LEFT JOIN kids ON kids.d = up.d AND kids.k = up.k),
below AS (SELECT a.d, a.k, count(*) FILTER (f.children = 0) AS leaves, sum((f.n - 1) * f.words) AS saved FROM full_node f JOIN pre a ON a.c = f.c AND a.d <= f.d GROUP BY ALL),
ended AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS most FROM pre) WHERE d = most GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, f.pc AS parent_conv_id, f.n AS n_convs, f.children AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_node f JOIN below b ON b.d = f.d AND b.k = f.k LEFT JOIN ended e ON e.d = f.d AND e.k = f.k
"""

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_one_bit_search, op3_retrieval_packing, op4_secret_scan, op5_hypergeometric_shards, op6_importance_resampling, op7_token_table, op8_byte_cnn_language, op9_gif_media, op10_near_duplicates, op11_prefix_trie, op12_speculative_bpe, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": _TRIE_SQL}
