"""Helpers shared by the operators: scratch tables on the cluster's shared folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its estimated size in bytes is at most this; otherwise the join shuffles.
BROADCAST_LIMIT = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local session that has none gets one of its own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quadrille-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables written to the shared folder to cut lineage, so that lost executors cost no recomputation.

    ``clear`` deletes those whose results have been written out; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self) -> str:
        made = f"{shared_folder(self.spark)}/quadrille-{uuid.uuid4().hex}"
        self.paths.append(made)
        jvm_path, fs = self._fs(made)
        fs.deleteOnExit(jvm_path)
        return made

    def table(self, df: DataFrame) -> DataFrame:
        made = self.path()
        df.write.parquet(made)
        back = self.spark.read.schema(df.schema).parquet(made)
        back._scratch_path = made
        return back

    def drop(self, df: DataFrame | None) -> None:
        made = getattr(df, "_scratch_path", None)
        if made in self.paths:
            jvm_path, fs = self._fs(made)
            fs.delete(jvm_path, True)
            self.paths.remove(made)

    def clear(self) -> None:
        for made in self.paths:
            jvm_path, fs = self._fs(made)
            fs.delete(jvm_path, True)
        self.paths = []

    def _fs(self, made: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(made)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint when the optimiser's size estimate allows it, else df for a shuffled join."""
    return F.broadcast(df) if estimated_bytes(df) <= (BROADCAST_LIMIT if limit is None else limit) else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
