"""The queries opN_<name> over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprints, jaccard_join, language_id, mixing, quality, token_store, toxicity, url_filters
from ._labels import fold
from ._shared import documents

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs, 3, 1))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "language.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.score_documents(docs, quality.fit(docs, labels(spark, sf_dir), 3, 1), out="q")
    score = F.col("q.score")
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "q.quality", "q.lines", "q.bad_lines")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.score_documents(docs, toxicity.fit(docs, labels(spark, sf_dir), 5, 0), out="t")
    score = F.col("t.score")
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "t.hits")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.format_preferences(turns)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(token_store.write_store(documents(spark, sf_dir), tokenizer_path()))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item that it holds."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


OP5_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
"""


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_toxicity": op4_toxicity,
        "op5_url_filters": op5_url_filters,
        "op6_token_store": op6_token_store,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_mixing": op8_mixing,
        "op9_decontamination": op9_decontamination,
        "op10_fingerprints": op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat_format.ORACLE_SQL, "op5_url_filters": OP5_SQL, "op7_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
