"""Queries of the corpus operators over the synthetic tables, with the same results in SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scrivel.llm import attribution, binary, bpe, conversations, exact_dedup, html_text, mixing, packing, sharding, simhash, substring_dedup, topk, toxicity

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies", "text_hash")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text_hash")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    return conversations.report(given, conversations.damage(given))


def op12_click_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "sales"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_best_fit_pack, op3_token_planes, op4_extendible_shards, op5_exact_topk, op6_simhash_groups, op7_source_mix, op8_toxicity, op9_substring_dedup, op10_exact_dedup, op11_conversation_repair, op12_click_attribution, op13_byte_bpe)}

_W = substring_dedup.WIDTH
ORACLES = {
    "op4_extendible_shards": sharding.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {_W - 1}], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - {_W - 2})) AS i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM ranked, range({_W}) AS t(k) WHERE r > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
left_ AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_ ON left_.doc_id = d.doc_id
""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
""",
    "op11_conversation_repair": conversations.ORACLE,
    "op12_click_attribution": attribution.ORACLE,
}
