"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last
return the columns of documents; the last returns the packing plan.  Labels and benchmark come from sf_dir.
The cases of nulls, empty and long texts, repeated rows and empty tables are those of the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontam, minhash, packing, quality, secrets
from quadrille.llm.common import Scratch, table

_spent: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    """Scratch tables for one stage; the stages before it have been written, so theirs go."""
    while _spent:
        _spent.pop().clear()
    _spent.append(Scratch(spark))
    return _spent[-1]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"), scratch=_scratch(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.drop_near_duplicates(docs, scratch=_scratch(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    _scratch(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are blotted out; every document stays."""
    return secrets.redact(docs, scratch=_scratch(spark))


def related_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of the documents that fill each window."""
    return packing.pack(docs, scratch=_scratch(spark))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("related_packing", related_packing),
]
#: The classifier, the signatures and the packing can't be written in SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for position, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if position == len(STAGES) - 1:
            return done
        before, docs = docs, scratch.table(done)
        scratch.drop(before)
    return docs
