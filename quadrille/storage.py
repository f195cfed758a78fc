"""Tables that an operator writes to cut lineage or to share a result between queries of one session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is hinted for broadcast only when its estimated size in bytes is at most this.
BROADCAST_LIMIT = 32 << 20
#: How tables of quads are written: what neighbouring IRIs begin with alike is stored once.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quadrille-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted when the driver ends."""
    made = f"{shared_folder(spark)}/quadrille-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def in_buckets(df: DataFrame, n: int, column: str, path: str) -> DataFrame:
    """df as a table of n buckets by column under path.  A df in as many partitions by it is written as it lies."""
    name = f"quadrille_{uuid.uuid4().hex}"
    out = df.write.bucketBy(n, column).option("path", path).options(**COMPACT)
    out.saveAsTable(name)
    return df.sparkSession.table(name)


def clustered(df: DataFrame, column: str) -> bool:
    """Whether df is a selection from one table in buckets by column."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() != 1 or leaves.head().getClass().getSimpleName() != "LogicalRelation" or (table := leaves.head().catalogTable()).isEmpty():
        return False
    buckets = table.get().bucketSpec()
    return buckets.isDefined() and buckets.get().bucketColumnNames().mkString(",") == column


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    made = new_folder(df.sparkSession)
    df.write.parquet(made)
    return df.sparkSession.read.schema(df.schema).parquet(made)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df hinted for broadcast when the optimiser's estimate is within the limit, else for a shuffle of both sides."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df, data that meet data: neither side of their join is broadcast, however small the optimiser takes compressed files to be."""
    return df.hint("merge")
