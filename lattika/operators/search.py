"""Postings, conjunctive search, ranges and TF-IDF ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import in_scope, words


def tokens(df: DataFrame, row: str, text: str, lower: bool = True) -> DataFrame:
    """(row, word) for each word of each text: split at white space, empty ones dropped."""
    t = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(F.col(row), F.explode(F.filter(F.split(t, "\\s+"), lambda x: x != "")).alias("word"))


def postings(df: DataFrame, row: str, text: str) -> DataFrame:
    """(word, row, tf, length): how often a word occurs in a row's text, and the text's words. Rows are unique; texts are read once."""
    own = df.select(F.col(row), F.filter(F.split(F.lower(F.col(text)), "\\s+"), lambda x: x != "").alias("_w"))
    each = own.select(F.col(row), F.size("_w").cast("long").alias("length"), F.explode("_w").alias("word"))
    return each.groupBy("word", row).agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def frequencies(posts: DataFrame, row: str) -> DataFrame:
    """(word, df): in how many rows each word occurs; those without rows are gone."""
    return posts.groupBy("word").agg(F.countDistinct(row).alias("df"))


def index(df: DataFrame, row: str, column: str, data: str | None = None) -> DataFrame:
    """Postings (column, value, row, data) of a column; null and empty values aren't indexed."""
    return df.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(F.lit(column).alias("column"), F.col(column).alias("value"), F.col(row).alias("row"), (F.col(data) if data else F.lit(None).cast("string")).alias("data"))


def replaced(posts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings with those of the fresh rows' (column, row) replaced."""
    return posts.join(fresh.select("column", "row").distinct(), ["column", "row"], "left_anti").select(*posts.columns).unionByName(fresh)


def removed(posts: DataFrame, rows: DataFrame, column: str | None = None) -> DataFrame:
    """Postings without the given rows, of one column or all."""
    gone = posts.filter(F.col("column") == column) if column else posts
    kept = posts.filter(F.col("column") != column) if column else posts.limit(0)
    return gone.join(rows.select("row").distinct(), "row", "left_anti").select(*posts.columns).unionByName(kept)


def dropped(posts: DataFrame, column: str | None = None) -> DataFrame:
    """An index without one column's postings, or without any."""
    return posts.limit(0) if column is None else posts.filter(F.col("column") != column)


def with_posting(rows: DataFrame, posts: DataFrame, row: str) -> DataFrame:
    """The candidate rows that a posting list holds."""
    return rows.join(posts.select(F.col("row").alias(row)).distinct(), row, "left_semi")


def intersected(lists: list[DataFrame]) -> DataFrame:
    """The rows (row) that are on every posting list."""
    every = [x.select("row").distinct() for x in lists]
    both = every[0]
    for x in every[1:]:
        both = both.unionByName(x)
    return both.groupBy("row").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(lists)).select("row")


def refreshed(posts: DataFrame, row: str) -> DataFrame:
    """Postings (word, row, tf, ...) with each row's length counted anew from its own postings."""
    return posts.select("word", row, "tf").join(posts.groupBy(row).agg(F.sum("tf").alias("length")), row)


@dataclass(frozen=True)
class Scope:
    """A range condition start <= column < stop; an open end is None, a null value counts as zero."""

    column: str
    start: object = None
    stop: object = None
    zero: object = 0

    def condition(self) -> Column:
        side = lambda x: None if x is None else F.lit(x)
        return in_scope(F.col(self.column), side(self.start), side(self.stop), self.zero)


def conjunctive(posts: DataFrame, terms: list[str], row: str, scopes: list[Scope] | None = None, rows: DataFrame | None = None, word: str = "word") -> DataFrame:
    """Rows that have every term and lie in every range. No terms, or an unknown one, give nothing.

    One pass: postings of the terms are counted per row, with a partial count before the shuffle; ranges are
    tested on the base rows that remain.
    """
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return posts.select(row).limit(0)
    hit = posts.filter(F.col(word).isin(wanted)).select(row, word).distinct().groupBy(row).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted)).select(row)
    for s in scopes or []:
        hit = hit.join(rows.filter(s.condition()).select(row), row, "left_semi")
    return hit


def search(df: DataFrame, row: str, text: str, query: str, scopes: list[Scope] | None = None) -> DataFrame:
    """Rows whose text holds all words of the query."""
    wanted = [w for w in dict.fromkeys(query.lower().split(" ")) if w]
    if not wanted:
        return df.select(row).limit(0)
    has = words(F.regexp_replace(F.lower(F.col(text)), "\\s+", " "))
    out = df.filter(F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(has, w)))
    for s in scopes or []:
        out = out.filter(s.condition())
    return out.select(row)


def tfidf(posts: DataFrame, terms: list[str], n_rows: int, row: str, k: int) -> DataFrame:
    """The k rows with all terms that score best: the sum of (0.01 + ln(N / df)) tf / length, ties by row."""
    wanted = list(dict.fromkeys(terms))
    own = posts.filter(F.col("word").isin(wanted))
    # One line per search term: as small as the query.
    df = F.broadcast(own.groupBy("word").agg(F.countDistinct(row).alias("df")))
    weight = (F.lit(0.01) + F.log(F.lit(float(n_rows)) / F.col("df"))) * F.col("tf") / F.col("length")
    score = own.join(df, "word").groupBy(row).agg(F.sum(weight).alias("score"), F.countDistinct("word").alias("_n")).filter(F.col("_n") == len(wanted))
    return score.select(row, "score").orderBy(F.desc("score"), row).limit(k)


def bag(df: DataFrame, row: str, text: str) -> DataFrame:
    """(word, n): the word bag of all texts."""
    return tokens(df, row, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bag_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bags added word by word; words that add up to 0 go."""
    return a.select("word", "n").unionByName(b.select("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).filter("n <> 0")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a minus b; negative numbers stay, zeros go."""
    return bag_sum(a, b.select("word", (-F.col("n")).alias("n")))


def bag_times(a: DataFrame, factor: float) -> DataFrame:
    return a.select("word", (F.col("n") * factor).alias("n"))


def adjusted(posts: DataFrame, changes: DataFrame, row: str) -> DataFrame:
    """Term counts after changes (word, row, tf), which may be negative; counts at 0 or below go."""
    both = posts.select("word", row, "tf").unionByName(changes.select("word", row, "tf"))
    return refreshed(both.groupBy("word", row).agg(F.sum("tf").alias("tf")).filter("tf > 0"), row)
