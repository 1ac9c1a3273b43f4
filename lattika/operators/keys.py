"""Keyed access to tables: seeks, multi-gets, prefixes, upserts, deletes and sequence ids."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh


def seek(df: DataFrame, key: str, at) -> DataFrame:
    """The first row with key >= at."""
    return df.filter(F.col(key) >= F.lit(at)).orderBy(key).limit(1)


def seek_before(df: DataFrame, key: str, at) -> DataFrame:
    """The last row with key < at."""
    return df.filter(F.col(key) < F.lit(at)).orderBy(F.desc(key)).limit(1)


def listing(df: DataFrame, key: str, start, n: int) -> DataFrame:
    """n rows in key order from a start key."""
    return df.filter(F.col(key) >= F.lit(start)).orderBy(key).limit(n)


def multi_get(df: DataFrame, key: str, keys: list) -> DataFrame:
    """The rows of the given keys; misses are dropped. The list is the caller's, so it goes into the scan's filter."""
    return df.filter(F.col(key).isin(keys))


def key_range(df: DataFrame, key: str, start=None, stop=None) -> DataFrame:
    """start <= key < stop; an open end is None."""
    out = df if start is None else df.filter(F.col(key) >= F.lit(start))
    return out if stop is None else out.filter(F.col(key) < F.lit(stop))


def with_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.filter(F.col(key).startswith(prefix))


def row_count(df: DataFrame) -> DataFrame:
    """(n): the rows, from partial counts; a file scan reads footers only."""
    return df.agg(F.count(F.lit(1)).alias("n"))


class Cursor:
    """Rows of a result one by one or in batches: partitions come to the driver in turn. count says how many were taken."""

    def __init__(self, df: DataFrame):
        self.rows, self.columns, self.count = df.toLocalIterator(prefetchPartitions=True), df.columns, 0

    def next(self):
        """The next row, or None behind the last."""
        return next(iter(self.take(1)), None)

    def take(self, n: int) -> list:
        """Up to n further rows."""
        got = list(islice(self.rows, n)) if self.rows is not None else []
        self.count += len(got)
        return got

    def close(self) -> None:
        self.rows = None


def upsert(old: DataFrame, new: DataFrame, key: str, version: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those of the same key. Of several new rows of a key the one with the greatest version counts; without a version keys must be unique."""
    new = new if version is None else latest(new, key, version)
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(df: DataFrame, key: str, version: Column) -> DataFrame:
    """Each key's row with the greatest version: an aggregate, so a hot key combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), version).alias("r")).select("r.*")


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def order_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Consecutive ids in an order, without a single-partition window; ties in any order.

    The range-partitioned rows are written once, each with its partition and its place in it, so that counts
    and rows are of the same ranges: planned twice, a range shuffle draws its bounds twice.
    """
    spark = df.sparkSession
    path = fresh(spark, "ids")
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # The lower 33 bits of this number count a partition's rows.
    parts = parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts.write.parquet(path)
    written = spark.read.schema(parts.schema).parquet(path)
    sizes = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by their number.
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return written.join(F.broadcast(before), "_part").withColumn(name, F.col("_row") + F.col("_before") + start).drop("_part", "_row", "_before")


def merged_order(streams: list[DataFrame], order: list[str]) -> DataFrame:
    """Sorted streams as one sorted stream."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.orderBy(*order)


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Each key's first n rows."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
