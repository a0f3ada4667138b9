"""The queries that apply each operator, with its production parameters, to its whole table; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.llm import bpe, decontaminate, lm, media, neardup, oracles, quality, shards, substring, token_counts, url_rules

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), media.store(media.padded(text)).alias("media"), F.lit("application/octet-stream").alias("declared_type"))
    got = media.sniff(docs)
    return got.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "declared_type", "media_type", "valid", F.size("embedded").alias("n_embedded"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    index = decontaminate.build_index(docs)
    found = decontaminate.find_exact(index, _read(spark, sf_dir, "benchmark"))
    rows = decontaminate.with_columns(index, found, docs.schema, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    trained, counts = lm.learn(docs.where("not held_out").select("text"))
    rows = lm.score(docs, trained, counts, ["doc_id", "held_out"])
    return rows.withColumn("train_tokens", F.lit(trained.total).cast("long"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_read(spark, sf_dir, "pages"), url_rules.rules_frame(spark, RULES))


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.similar_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.drop("group_key")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    dims = {"size": F.log2(size), "source": F.col("source"), "lang": F.col("lang")}
    keep = {"doc_id": F.col("doc_id"), "size": size.cast("long"), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}
    rows = shards.assign(docs, dims, size, F.coalesce("text", F.lit("")), [F.col("doc_id")], keep)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_sniffing,
        op2_benchmark_decontamination,
        op3_lm_scoring,
        op4_url_rules,
        op5_substring_dedup,
        op6_byte_bpe,
        op7_ngram_jaccard_join,
        op8_hilbert_shards,
        op9_quality_classifier,
        op10_token_counts,
    )
}
ORACLES: dict[str, str] = {"op2_benchmark_decontamination": oracles.DECONTAMINATION, "op4_url_rules": OP4_SQL, "op5_substring_dedup": oracles.SUBSTRING, "op7_ngram_jaccard_join": oracles.JACCARD}
