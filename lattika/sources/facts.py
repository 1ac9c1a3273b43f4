"""Fact streams: JSON objects appended under a name, scanned by ingest time, deleted by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.spec import OPERATION, CubeSpec
from . import files

SALTS = 16


def needed(spec: CubeSpec) -> list[str]:
    """The keys of a fact that a cube reads."""
    return list(dict.fromkeys([*spec.dimensions, OPERATION, *(m.name for m in spec.measures)]))


def from_json(df: DataFrame, spec: CubeSpec, content: str = "content", bad: str = "null") -> DataFrame:
    """Facts' needed keys as texts; other keys are never built.

    bad: what a text that isn't a JSON object does: `null` gives nulls, so defaults apply; `skip` leaves it out (see
    set_aside); `fail` makes whoever reads it fail.
    """
    names = needed(spec)
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = df.filter(is_object(F.col(content))) if bad == "skip" else df
    if bad == "fail":
        checked = F.when(is_object(F.col(content)), F.col(content)).otherwise(F.raise_error(F.concat(F.lit("not a JSON fact: "), F.substring(F.coalesce(content, F.lit("null")), 1, 200))).cast("string"))
        rows = df.withColumn(content, checked)
    return rows.select(F.from_json(content, schema).alias("_f")).select(*[F.col("_f").getField(n).alias(n) for n in names])


def is_object(content: Column) -> Column:
    """Whether a text is one JSON object."""
    return F.coalesce(F.ltrim(content).startswith("{") & F.try_parse_json(content).isNotNull(), F.lit(False))


def set_aside(df: DataFrame, content: str = "content") -> DataFrame:
    """The rows whose text is no JSON object."""
    return df.filter(~is_object(F.col(content)))


def to_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("content"))


def append(df: DataFrame, root: str, name: str, ingest: Column | None = None, content: str = "content") -> None:
    """Adds facts to a stream, stored by name, spread over salts and sorted by ingest time for row-group skipping."""
    when = (F.current_timestamp() if ingest is None else ingest).cast("timestamp")
    rows = df.select(F.col(content).alias("content"), when.alias("ingest")).withColumn("salt", F.pmod(F.xxhash64("content", "ingest"), F.lit(SALTS)).cast("int"))
    rows.repartition(SALTS, "salt").sortWithinPartitions("ingest").select("content", "ingest").write.mode("append").parquet(f"{root}/{name}")


def scan(spark: SparkSession, root: str, name: str, start=None, stop=None) -> DataFrame:
    """A stream's facts with start <= ingest < stop; an unknown stream is empty."""
    kind = "content string, ingest timestamp"
    if not files.exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], kind)
    out = spark.read.schema(kind).parquet(f"{root}/{name}")
    out = out if start is None else out.filter(F.col("ingest") >= F.lit(start).cast("timestamp"))
    return out if stop is None else out.filter(F.col("ingest") < F.lit(stop).cast("timestamp"))


def delete(spark: SparkSession, root: str, name: str) -> bool:
    return files.delete(spark, f"{root}/{name}")


def compact(spark: SparkSession, root: str, name: str, n: int) -> None:
    """A stream in n files instead of many; readers see the old files until the new folder takes their place."""
    scan(spark, root, name).repartitionByRange(n, "ingest").sortWithinPartitions("ingest").write.mode("overwrite").parquet(f"{root}/{name}.new")
    files.delete(spark, f"{root}/{name}")
    spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.new"), spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"))
