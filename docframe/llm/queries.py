"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, decontamination, language_id, licenses, near_duplicates, oracles, packing, perplexity, pii, quality_rules, secret_scan, toxicity

#: The surrogates' key for the registered queries; a deployment gives its own secret.
PII_KEY = "docframe-example-key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels call good; an empty table where there are no labels."""
    return _spark.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_spark.table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    return out.drop("text")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that do not depend on what is learned: op2 as a whole is beyond SQL (its buckets are hashes)."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_spark.table(spark, sf_dir, "documents"), _spark.table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _spark.table(spark, sf_dir, "documents"), _spark.remainder("doc_id", 3)
    return language_id.identify(docs, docs.where(fold != 1), fold == 1)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with its lists as text: families, and paragraph:family:probability (in ten-thousandths) of each notice."""
    found = licenses.scan_licenses(_spark.table(spark, sf_dir, "documents"))
    one = F.transform("notices", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"], F.round(x["probability"] * 10000).cast("long").cast("string")))
    return found.select("doc_id", "n_notices", "n_unknown", F.array_join("families", ",").alias("families"), F.array_join(one, ",").alias("notices"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_spark.table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_spark.table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.RULES[: secret_scan.BASE]]
    count = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    digest = F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))).cast("binary"), 256)
    return found.select("doc_id", *count, digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "n_entities", "text")


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity(_spark.table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _spark.table(spark, sf_dir, "documents"), _spark.remainder("doc_id", 5)
    labelled = toxicity.with_labels(docs, _spark.table(spark, sf_dir, "labels"), "toxic").where(fold != 0)
    return toxicity.toxicity(docs, labelled, fold == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_duplicates, op2_quality_rules, op3_decontamination, op4_language_id, op5_licenses, op6_packing, op7_secrets, op8_pii, op9_perplexity, op10_toxicity)
    return {f.__name__: f for f in (*found, quality_base_counts)}


def oracle_sql() -> dict[str, str]:
    """The others learn from the tables, draw keyed values or tokenize, which SQL cannot: tests/llm holds them against brute force,
    a round trip or held-out accuracy."""
    return {"op1_near_duplicates": oracles.near_duplicates(), "quality_base_counts": oracles.QUALITY_BASE, "op5_licenses": oracles.licences(), "op7_secrets": oracles.secrets()}
