"""Dense and tag vectors: similarity top-k, tag learning and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cosine, undecayed
from .keys import top_per_key


def nearest(df: DataFrame, row: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows most similar to a query vector; ties by row. A top-k per task comes before the merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(row, cosine(F.col(vector), q).alias("sim")).orderBy(F.desc("sim"), row).limit(k)


def tag_rows(df: DataFrame, row: str, tags: str) -> DataFrame:
    """(row, word, weight) of a map column."""
    return df.select(row, F.explode(tags).alias("word", "weight"))


def nearest_tags(tags: DataFrame, row: str, query: dict[str, float], k: int) -> DataFrame:
    """The k rows whose tags (row, word, weight) have the largest cosine with the query's; rows that share nothing score 0 and are left out."""
    spark = tags.sparkSession
    q = spark.createDataFrame([(w, float(x)) for w, x in query.items()], "word string, q double")
    length = sum(x * x for x in query.values()) ** 0.5
    got = tags.join(F.broadcast(q), "word", "left").groupBy(row).agg(F.sum(F.col("weight") * F.coalesce("q", F.lit(0.0))).alias("d"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    return got.filter("d <> 0 and n > 0").select(row, (F.col("d") / (F.col("n") * F.lit(length))).alias("sim")).orderBy(F.desc("sim"), row).limit(k)


def top_tags(tags: DataFrame, row: str, k: int = 100) -> DataFrame:
    """Each row's k heaviest tags, ties by word."""
    return top_per_key(tags, row, [F.desc("weight"), F.col("word")], k)


def latent(row: Column, terms: int) -> Column:
    """A row's starting vector: numbers in [0, 1) that only the row and the term's place set, so that it is the same each time."""
    unit = lambda k: F.shiftrightunsigned(F.xxhash64(row, k), 11).cast("double") / float(1 << 53)
    return F.transform(F.sequence(F.lit(0), F.lit(terms - 1)), unit)


def with_term(vector: Column, place: Column, by: Column) -> Column:
    """A latent vector whose term at a place (from 0) has grown by a number."""
    return F.transform(vector, lambda x, k: F.when(k == place, x + by).otherwise(x))


def unit_length(tags: DataFrame, row: str) -> DataFrame:
    n = tags.groupBy(row).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    return tags.join(n, row).select(row, "word", F.when(F.col("_n") == 0, F.col("weight")).otherwise(F.col("weight") / F.col("_n")).alias("weight"))


def learned(old: DataFrame, lesson: DataFrame, row: str, rate: float, now_ms: int, coef: float = 0.99, k: int = 100) -> DataFrame:
    """Tags after a lesson (row, word, weight): weight times rate is added in terms of the origin, then the k heaviest stay."""
    more = lesson.select(row, "word", undecayed(F.col("weight") * rate, F.lit(now_ms), coef).alias("weight"))
    return top_tags(old.select(row, "word", "weight").unionByName(more).groupBy(row, "word").agg(F.sum("weight").alias("weight")), row, k)
