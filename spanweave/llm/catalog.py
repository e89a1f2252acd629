"""Registered queries of the training-data operators and their DuckDB statements.

Every query applies its operator, with production parameters, to its whole
table.  Where SQL cannot say what the operator does, tests/llm compares it with
a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import hadamard_codes, importance, mixing, phrases, pitman_yor, risk_rules, secret_forest, simhash_trie, spaced_seed, suffix_dedup, token_counts, url_rules, warc
from .common import new_folder, table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op2_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = risk_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "rejected_by")


def op3_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spaced_seed.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "equal_words", "window_words", "first_word")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return removed.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed")).drop("kept")


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "path", "word_no", "secret", "score")


def op8_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v) for v in rule]) for rule in URL_RULES]))).toDF("action", "host", "path")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
t AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id,
        row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS i FROM d),
b AS (SELECT *, array_to_string([to_base(('0x' || substr(h, 1 + 5 * x, 5))::BIGINT, 32, 4) FOR x IN range(8)], '') AS b32 FROM t)
SELECT page_id, payload_bytes, translate(upper(b32), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN i > 1 THEN first_id END AS refers_to
FROM b"""

_URL_SQL = """
WITH rules(action, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
best AS (SELECT url, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS verdict
         FROM (SELECT DISTINCT url, host, path FROM u) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (url)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pitman_yor, op2_risk_rules, op3_spaced_seed, op4_source_mix, op5_suffix_dedup, op6_simhash_trie, op7_secret_forest, op8_content_archive, op9_importance, op10_url_rules,
           op11_token_counts, op12_hadamard_codes, op13_phrase_automata)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mix": mixing.mix_sql(),
        "op8_content_archive": _WARC_SQL,
        "op10_url_rules": _URL_SQL.format(rules=", ".join(str(r) for r in URL_RULES)),
        "op12_hadamard_codes": hadamard_codes.compress_sql(),
        "op13_phrase_automata": phrases.mine_sql(),
    } | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
