"""A training-data pipeline over ``documents``: quality rules, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents; run() writes each stage's rows into the shared folder and reads them again.
Rows are decided by doc_id; rows that repeat a doc_id are reduced to one by the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import _spark, decontamination, near_duplicates, packing, pii, quality_rules
from docframe.llm.queries import PII_KEY, tokenizer_path, trusted_ids

#: Names that no column of documents has.
_ID, _OWN = "_docframe_id", "_docframe_own_n_entities"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and short texts are rejected too."""
    judged = quality_rules.quality_rules(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), trusted_ids(spark, sf_dir))
    return judged.where("kept").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8): the one with the smallest doc_id, once.

    Rows that share a doc_id are one document, read by the least of their texts: they go together, and the row with that text stays. Rows without a doc_id stay.
    """
    judged = _spark.materialize(near_duplicates.near_duplicates(docs, words=5, similarity=0.8), "judged")
    dropped = judged.where("not kept").select(F.col("doc_id").alias(_ID)).distinct()
    out = docs.join(_spark.small(dropped, dropped.count()), F.col("doc_id") == F.col(_ID), "left_anti")
    repeated, n = near_duplicates.repeated_ids(out)
    if n:
        again = out.join(_spark.small(repeated, n), "doc_id", "left_semi").select(*out.columns)
        one = again.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in out.columns if c != "text"])).alias("_row")).select("_row.*").select(*out.columns)
        out = out.join(_spark.small(repeated, n), "doc_id", "left_anti").select(*out.columns).unionByName(one)
    return out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.leaks(docs, _spark.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(_ID)).distinct()
    found = _spark.materialize(found, "leaked")
    return docs.join(_spark.small(found, found.count()), F.col("doc_id") == F.col(_ID), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by surrogates; a column n_entities of documents stays what it is."""
    found = pii.surrogates(docs.withColumnRenamed("n_entities", _OWN), PII_KEY).drop("n_entities")
    return found.withColumnRenamed(_OWN, "n_entities").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts."""
    return packing.pack(docs, tokenizer_path(), 1024)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Circulant signatures, fitted thresholds, keyed surrogates and token ids are beyond SQL: tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; the last stage's rows."""
    docs = _spark.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _spark.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
