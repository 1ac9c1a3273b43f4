"""A folder for tables that a query writes: below the cluster's shared folder, or a temporary one of a local master."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; only a local master may go without."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattika.scratch.dir", None)
    if given:
        return given.rstrip("/")
    if conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lattika-")
    spark.conf.set("lattika.scratch.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattika-{name}-{uuid.uuid4().hex}"
