"""Connected components of large graphs: local forests, then large and small stars until every tree is a star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ALONE = 100_000
"""Edges that one task may finish alone (under 2 MB); beyond it, stars."""
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while (up := p.get(x, x)) != root:
            p[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        own = sorted(self.parent)
        return own, [self.find(x) for x in own]


def forest(batches, every: int = 1_000_000):
    """An edge list as stars to each local component's smallest member; memory is bounded by starting anew."""
    union = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            union.join(a, b)
        if len(union.parent) > every:  # an early start anew only leaves more edges
            yield pa.record_batch([pa.array(x, pa.int64()) for x in union.stars()], schema=EDGE)
            union = Union()
    yield pa.record_batch([pa.array(x, pa.int64()) for x in union.stars()], schema=EDGE)


def contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(forest, "u long, v long").distinct()


def named(stars: DataFrame) -> DataFrame:
    ends = stars.filter("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", alone: int = ALONE) -> DataFrame:
    """node and component (the smallest node that it reaches) for every node of the edges; ids are not null.

    Loops and repeated edges do no harm; no edges give an empty table. Each round is written to the shared
    folder; the driver sees counts only. Once local forests leave at most `alone` edges, one task ends it.
    """
    two = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now = scratch.cut(contracted(two).filter("u <> v"), "edges")
    while True:
        tops = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        n, twice, total = tops.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n == 0 or (twice == 0 and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            # Each node has one edge, to a node that has none: stars whose centres are the smallest members.
            return named(now)
        if total <= alone:
            return named(now.coalesce(1).mapInArrow(lambda batches: forest(batches, 2 * alone + 1), "u long, v long"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = scratch.cut(contracted(large).filter("u <> v"), "large")
        small_least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = small_least.select("u", F.col("m").alias("v"))
        small = large.join(small_least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = scratch.cut(contracted(own.unionByName(small)).filter("u <> v"), "edges")
        for old in (now, least, large, small_least):
            scratch.drop(old)
        now = after


def spanning(pairs: np.ndarray, ids: np.ndarray, union: Union) -> list[tuple[int, int]]:
    """The pairs (as places in ids) that join something not yet joined."""
    return [(int(ids[x]), int(ids[y])) for x, y in pairs if union.join(int(ids[x]), int(ids[y]))]
