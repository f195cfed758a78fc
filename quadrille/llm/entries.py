"""One query for each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, media, minhash, packing, quality, secrets, sharding, toxicity, urlfilter
from .common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item found in a document within its edit budget."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each secret of each document with its hash's counts over the corpus and the verdict."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each toxic document, its score and the threshold."""
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page, and what blocks it of the list of URLs, hosts and domains served over plain http."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.blocked(pages, urlfilter.downgraded(pages)).withColumn("blocked", F.col("matched_entry").isNotNull())


def op5_media_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, size and frequency hash of each embedding drawn as a PNG in a binary column."""
    return media.hashes(media.rendered(table(spark, sf_dir, "embeddings")), "vec_id", "image")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, calibrated probability and verdict of every document."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents that fill each window."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical turns of the conversations, from records in five layouts."""
    return chat.canonical_turns(chat.heterogeneous(table(spark, sf_dir, "conversations")))


def op9_bounded_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near-duplicate document with the document of its group that stays."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_media_hash": op5_media_hash,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_related_packing": op7_related_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_bounded_sharding": op9_bounded_sharding,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": secrets.oracle_sql(),
    "op4_url_filter": urlfilter.oracle_sql(),
    "op8_chat_formatting": chat.ORACLE_SQL,
}
