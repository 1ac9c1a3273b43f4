"""Helpers shared by the training-data operators: tables, the shared folder and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder, as in tests.
    """
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattika.scratch.dir", None)
    if given:
        return given.rstrip("/")
    if not conf.get("spark.master", "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lattika-")
    spark.conf.set("lattika.scratch.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables and files of one operator run, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lattika-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again, which ends its lineage: a lost executor costs no recomputation before this."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lattika_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that cut() wrote and that nothing needs any more."""
        path = getattr(df, "_lattika_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and, but for single longer rows, so many bytes."""
    for batch in batches:
        a = 0
        while a < batch.num_rows:
            n = min(rows, batch.num_rows - a)
            while n > 1 and batch.slice(a, n).nbytes > size:
                n //= 2
            yield batch.slice(a, n)
            a += n
        del batch
        pa.default_memory_pool().release_unused()


def least_hashes(share: float) -> int:
    """The greatest of that share of all 64-bit hashes: `hash <= this` holds for the share, however small it is."""
    return -(1 << 63) + max(0, int((1 << 64) * min(1.0, share)) - 1)


def task_number() -> int:
    """The number of the partition that this task computes: the same for each attempt."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
