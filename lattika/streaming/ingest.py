"""Streams of facts into cubes, and windowed counts of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..engine import CubeEngine
from ..plans.spec import CubeSpec


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None, clean: str | None = None) -> DataFrame:
    """A folder as a stream; clean: `delete` or `archive` consumed files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if clean:
        reader = reader.option("cleanSource", clean)
    return reader.format(kind).load(path)


def into_cube(engine: CubeEngine, spec: CubeSpec, stream: DataFrame, checkpoint: str, json_facts: bool = False, name: str = "stream", once: bool = True, bad: str = "fail") -> StreamingQuery:
    """Each micro-batch becomes one segment. The batch id goes with it, so a replayed batch is counted once. A batch whose facts cancel adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        engine.ingest(spec, df, json_facts=json_facts, batch=f"{name}-{number}", bad=bad, empty="skip")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window of event time, with a watermark for late rows. An extra; works on batches too."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    got = stream.withWatermark(time, late).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "cnt", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions per key that end after a gap. An extra."""
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("cnt"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cnt")
