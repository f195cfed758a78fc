"""Streams of results and of quads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import terms
from ..operators import mining
from ..storage import COMPACT, delete, exists, names_in, shuffled

QUAD = "g string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"


def rows(df: DataFrame, most: int | None = None) -> Iterator:
    """The rows one by one, a partition at a time on the driver."""
    return (df if most is None else df.limit(most)).toLocalIterator(prefetchPartitions=True)


def pages(df: DataFrame, size: int, most: int | None = None) -> Iterator[list]:
    """The rows in lists of ``size``."""
    page: list = []
    for row in rows(df, most):
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def class_counts(stream: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Instances of each class in a stream of quads, each (graph, subject, class) once.  With a watermark on the
    column ``time``, what is older is forgotten, and a triple that returns after it counts again."""
    typed = stream.where(F.col("p") == terms.TYPE)
    if watermark:
        typed = typed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["g", "s", "o"])
    else:
        typed = typed.dropDuplicates(["g", "s", "o"])
    return typed.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("instances"))


def keep_class_counts(stream: DataFrame, seen_path: str, counts_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the instances of each class, each (graph, subject, class) once in the whole stream; ``latest`` reads them.

    What was seen is a table, not the state of a streaming operator, which would hold every instance in memory.  A batch
    adds what isn't in the batches before it under its own number, so that a repeated batch replaces itself.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark, key = new.sparkSession, ["g", "s", "c"]
        fresh = new.where(F.col("p") == terms.TYPE).select("g", "s", F.col("o").alias("c")).distinct()
        if number:
            fresh = fresh.join(shuffled(spark.read.parquet(seen_path).where(F.col("batch") < number)), key, "left_anti")
        fresh.write.mode("overwrite").options(**COMPACT).parquet(f"{seen_path}/batch={number}")
        whole = number and exists(spark, f"{counts_path}/{number - 1}/_SUCCESS")
        seen = spark.read.parquet(f"{seen_path}/batch={number}") if whole else spark.read.parquet(seen_path).where(F.col("batch") <= number)
        counts = seen.groupBy(F.col("c").alias("class")).agg(F.count("*").alias("instances"))
        if whole:
            counts = counts.unionByName(spark.read.parquet(f"{counts_path}/{number - 1}")).groupBy("class").agg(F.sum("instances").alias("instances"))
        counts.write.mode("overwrite").parquet(f"{counts_path}/{number}")
        if number > 1:  # the batch before stays, in case this one is done again
            delete(spark, f"{counts_path}/{number - 2}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(stream: DataFrame, quads_path: str, patterns_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the patterns of a growing set of quads.

    Counts don't add up batch by batch: a type that arrives late moves links from untyped to typed.  Each batch
    is therefore added to the stored quads, under its number so that a repeated batch replaces itself, and the
    patterns of the classes that the batch touches, as subject or through a retyped object, are mined again; of the
    first batch all are.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.write.mode("overwrite").options(**COMPACT).parquet(f"{quads_path}/batch={number}")
        quads = spark.read.parquet(quads_path).drop("batch")
        before = f"{patterns_path}/{number - 1}"
        if not number or not exists(spark, f"{before}/_SUCCESS"):  # the first batch, or the one before was lost: all quads
            fresh = mining.mine(quads)
        else:
            retyped = new.where(F.col("p") == terms.TYPE).select(F.col("s").alias("o")).distinct()
            linking = quads.join(shuffled(retyped), "o", "left_semi").select("s")
            subjects = new.select("s").union(linking).distinct()
            classes = mining.types(quads).join(shuffled(subjects), "s", "left_semi").select(F.col("c").alias("class")).distinct()
            fresh, old = mining.mine(quads, only=classes), spark.read.parquet(before)
            fresh = old.join(classes.withColumnRenamed("class", "subject_class"), "subject_class", "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{patterns_path}/{number}")
        if number > 1:  # the batch before stays, in case this one is done again
            delete(spark, f"{patterns_path}/{number - 2}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, patterns_path: str) -> DataFrame:
    """The patterns after the last whole batch; those of older batches but one are deleted."""
    whole = [name for name in names_in(spark, patterns_path) if name.isdigit() and exists(spark, f"{patterns_path}/{name}/_SUCCESS")]
    return spark.read.parquet(f"{patterns_path}/{max(map(int, whole))}")
