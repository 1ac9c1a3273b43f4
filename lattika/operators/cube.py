"""Building cuboids: the base from facts, children from their smallest parents, or all at once by grouping sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import CubeSpec, cuboid_name, parents
from ..scratch import fresh
from . import keys, states

SURE, FEW = 8, 64
"""Standard errors that a sketch's estimate is trusted within (about 1e-15 of all estimates are further off), and estimates that are taken as equally small."""


def base(facts: DataFrame, spec: CubeSpec, raw: bool = False) -> DataFrame:
    """The base cuboid's states."""
    return states.projected(facts, spec, raw).groupBy(*spec.expanded()).agg(*states.partial(spec))


def rollup(parent: DataFrame, dims: Iterable[str], spec: CubeSpec) -> DataFrame:
    """A coarser cuboid from a finer one's states, or the same cuboid of several segments merged."""
    return parent.groupBy(*dims).agg(*states.merge(spec))


def staged(facts: DataFrame, spec: CubeSpec, raw: bool = False) -> dict[tuple[str, ...], DataFrame]:
    """Every cuboid of the lattice, each from its smallest parent. What has children is written to the shared folder once and read by them."""
    lattice = spec.lattice()
    spark, folder, above = facts.sparkSession, fresh(facts.sparkSession, "staged"), parents(lattice)
    needed = {above[c] for c in lattice[1:]} | {lattice[0]}
    out: dict[tuple[str, ...], DataFrame] = {}
    for k, dims in enumerate([lattice[0], *sorted(lattice[1:], key=len, reverse=True)]):
        df = base(facts, spec, raw) if k == 0 else rollup(out[above[dims] if above[dims] in out else lattice[0]], dims, spec)
        if dims in needed:
            df.write.parquet(f"{folder}/{k}")
            df = spark.read.schema(df.schema).parquet(f"{folder}/{k}")
        out[dims] = df
    return {c: out[c] for c in lattice}


def grouping_sets(source: DataFrame, spec: CubeSpec, cuboids: list[tuple[str, ...]], merged: bool = True) -> DataFrame:
    """All cuboids in one job: `cuboid` names the grouping set, dimensions outside it are null.

    merged: source holds states (as the base does) rather than projected facts. The set's bits tell a
    dimension that was rolled up from one that is null.
    """
    dims = spec.expanded()
    sets = [[F.col(d) for d in c] for c in cuboids]
    aggregates = states.merge(spec) if merged else states.partial(spec)
    out = source.groupingSets(sets, *[F.col(d) for d in dims]).agg(F.grouping_id().cast("long").alias("_set"), *aggregates)
    number = {sum(0 if d in c else 1 << len(dims) - 1 - i for i, d in enumerate(dims)): cuboid_name(c) for c in cuboids}
    name: Column = F.lit(None).cast("string")
    for k, v in number.items():
        name = F.when(F.col("_set") == k, v).otherwise(name)
    return out.select(name.alias("cuboid"), *dims, *states.columns(spec))


def event_bounds(facts: DataFrame, time: str, by: str | None = None) -> DataFrame:
    """Eldest and youngest event time, of each batch if `by` names one."""
    grouped = facts.groupBy(by) if by else facts.groupBy()
    return grouped.agg(F.min(time).alias("eldest"), F.max(time).alias("youngest"))


def distinct_order(cells: DataFrame, facts: DataFrame, dims: list[str], measure: str, name: str = "place") -> DataFrame:
    """Cells in descending order of a distinct measure, numbered from 1; ties in the order of their dimensions, nulls last.

    Their sketches order them where their errors tell them apart. A cell with another one in its class of estimates
    or beside it is counted exactly from the facts, missing values apart. Classes are so wide that estimates
    that aren't neighbours can't change places, though a sketch counts missing values as one.
    """
    spark, path, off = facts.sparkSession, fresh(facts.sparkSession, "estimates"), SURE * states.error_rate()
    width = log((1 + off) / (1 - off) + (1 + off) / FEW)
    own = [f"_k{k}" for k in range(len(dims))]
    same: Column = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(k)) for d, k in zip(dims, own, strict=True)], F.lit(True))
    estimates = cells.select(*[F.col(d).alias(k) for d, k in zip(dims, own, strict=True)], F.hll_sketch_estimate(f"{measure}_hll").alias("_e"))
    estimates = estimates.withColumn("_class", F.floor(F.log(F.greatest("_e", F.lit(FEW))) / width))
    estimates.write.parquet(path)
    estimates = spark.read.schema(estimates.schema).parquet(path)
    # At most 44 / width classes, whatever the cells: estimates are below 2^63.
    near = estimates.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*[F.col("_class") + k for k in (-1, 0, 1)])).alias("_class"), "_n")
    crowded = near.groupBy("_class").agg(F.sum("_n").alias("_n")).filter("_n > 1")
    unsure = estimates.join(F.broadcast(crowded), "_class", "left_semi").select(*own)
    exact = facts.select(*dims, measure).join(unsure, same, "left_semi").groupBy(*dims).agg(F.countDistinct(measure).alias("_x"))
    placed = estimates.join(exact, same, "left").select(*[F.col(k).alias(d) for d, k in zip(dims, own, strict=True)], (-F.coalesce(F.col("_x").cast("double"), F.col("_e"))).alias("_less"), *[F.col(k).isNull().alias(f"_no{k}") for k in own])
    return keys.order_ids(placed, ["_less", *[c for d, k in zip(dims, own, strict=True) for c in (f"_no{k}", d)]], name).select(*dims, name)
