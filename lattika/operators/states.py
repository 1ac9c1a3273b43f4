"""Aggregate states of cube cells: partial from facts, merged, and finished. All are built-in aggregates with map-side combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import COUNT, OPERATION, CubeSpec

SKETCH_BITS = 14
SIGN, CNT = "_sign", "cnt"
DIGIT_BITS, LOWEST, DIGITS = 28, -40, 6
"""A sum's digits: six of 28 bits, the last in units of 2^-40, so values below 2^128 (any float's) have their places."""


def error_rate(bits: int = SKETCH_BITS) -> float:
    """The standard error of a sketch of 2 ** bits registers."""
    return 1.04 / 2 ** (bits / 2)


def projected(facts: DataFrame, spec: CubeSpec, raw: bool = True) -> DataFrame:
    """Facts as dimension levels, sign, measure values and distinct texts.

    The operation defaults to ADD and REMOVE counts -1. A measure that is missing or no number is 0. A
    missing distinct value counts as the text `null`. raw: time is text in one of the three formats.
    """
    from ..functions.timedim import levels, text_levels

    have = set(facts.columns)
    col = lambda n: F.col(f"`{n}`") if n in have else F.lit(None).cast("string")
    out: dict[str, Column] = {}
    for d in spec.dimensions:
        if d == spec.time:
            as_text = raw or d not in have or facts.schema[d].dataType.simpleString() == "string"
            out |= (text_levels if as_text else levels)(col(d))
        elif d == OPERATION:
            out[d] = F.coalesce(col(d), F.lit("ADD"))
        else:
            out[d] = col(d)
    out[SIGN] = F.when(F.coalesce(col(OPERATION), F.lit("ADD")) == "REMOVE", -1).otherwise(1)
    out |= {f"v_{m}": F.coalesce(col(m).try_cast("double"), F.lit(0.0)) for m in spec.stats}
    out |= {f"d_{m}": F.coalesce(col(m).cast("string"), F.lit("null")) for m in spec.distincts}
    return facts.select(*[c.alias(n) for n, c in out.items()])


def sum_columns(m: str) -> list[str]:
    """The columns that hold a sum exactly: its digits, the greatest first, and what has no place in them."""
    return [*[f"{m}_sum{k}" for k in range(DIGITS)], f"{m}_rest"]


def digits(v: Column) -> list[Column]:
    """A double as signed digits of at most 2^27 (the first 2^28) and the rest, without rounding.

    The rest is what lies below 2^-41, and numbers of 2^128 and more, infinities and NaN as a whole. Digits of -v are
    those of v negated.
    """
    fits = F.abs(v) < F.lit(2.0**128)
    x = F.when(fits, v).otherwise(F.lit(0.0))
    at = [F.rint(x * F.lit(2.0 ** -(LOWEST + DIGIT_BITS * (DIGITS - 1 - k)))) for k in range(DIGITS)]
    own = [at[0], *[b - a * F.lit(2.0**DIGIT_BITS) for a, b in zip(at, at[1:], strict=False)]]
    return [*[d.cast("long") for d in own], F.when(fits, v - at[-1] * F.lit(2.0**LOWEST)).otherwise(v)]


def total(sums: list[Column]) -> Column:
    """The double of summed digits and rest. Carries are taken first: then only the last places round, whatever cancelled."""
    *places, value = sums
    carry = F.lit(0).cast("long")
    for k, d in enumerate(reversed(places)):
        d = d + carry
        carry = F.shiftright(d + F.lit(1 << DIGIT_BITS - 1), DIGIT_BITS)
        d = d if k == DIGITS - 1 else d - carry * F.lit(1 << DIGIT_BITS)
        value = value + d.cast("double") * F.lit(2.0 ** (LOWEST + DIGIT_BITS * k))
    return value


def summed(m: str, parts: list[Column]) -> list[Column]:
    """Aggregates of a sum: its double, digits and rest. Long sums have no order, so what was added and removed cancels; 2^35 facts of a cell fit."""
    sums = [F.sum(p) for p in parts]
    return [total(sums).alias(f"{m}_sum"), *[s.alias(c) for s, c in zip(sums, sum_columns(m), strict=True)]]


def with_digits(states: DataFrame, spec: CubeSpec) -> DataFrame:
    """Stored states with digits for sums that were written without them."""
    lacking = {c: F.coalesce(F.col(c), d) for m in spec.stats for c, d in zip(sum_columns(m), digits(F.col(f"{m}_sum")), strict=True)}
    return states.withColumns(lacking) if lacking else states


def partial(spec: CubeSpec) -> list[Column]:
    """Aggregates of projected facts. Removed facts still feed min, max and sketches: those can't be taken back."""
    out = [F.sum(SIGN).cast("long").alias(CNT)]
    for m in spec.stats:
        v = F.col(f"v_{m}")
        out += [F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max"), *summed(m, digits(v * F.col(SIGN)))]
    return out + [F.hll_sketch_agg(f"d_{m}", F.lit(SKETCH_BITS)).alias(f"{m}_hll") for m in spec.distincts]


def merge(spec: CubeSpec) -> list[Column]:
    """Aggregates of states, of any number of segments or of a finer cuboid."""
    out = [F.sum(CNT).cast("long").alias(CNT)]
    for m in spec.stats:
        out += [F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"), *summed(m, [F.col(c) for c in sum_columns(m)])]
    return out + [F.hll_union_agg(f"{m}_hll").alias(f"{m}_hll") for m in spec.distincts]


def valid(spec: CubeSpec) -> Column:
    """Whether a cell still stands for facts: a count or a sum that isn't 0. Sums are rounded: 0.1 + 0.2 - 0.3 isn't 0 in doubles."""
    return reduce(lambda a, m: a | (F.round(f"{m}_sum", 6) != 0), spec.stats, F.col(CNT) != 0)


def columns(spec: CubeSpec) -> list[str]:
    return [CNT, *[c for m in spec.stats for c in (*[f"{m}_{s}" for s in ("min", "max", "sum")], *sum_columns(m))], *[f"{m}_hll" for m in spec.distincts]]


def finished(spec: CubeSpec, average: bool = True) -> list[Column]:
    """Result columns of merged states: the count, min, max, sum and average of each measure, estimates of distinct ones."""
    out = [F.col(CNT)]
    for m in spec.stats:
        out += [F.col(f"{m}_{s}") for s in ("min", "max", "sum")]
        if average:
            out.append((F.col(f"{m}_sum") / F.nullif(F.col(CNT), F.lit(0))).alias(f"{m}_avg"))
    return out + [F.hll_sketch_estimate(f"{m}_hll").alias(f"{m}_distinct") for m in spec.distincts]


def published(states: DataFrame, spec: CubeSpec) -> DataFrame:
    """States in the published row shape; the time dimension is rebuilt as text and each sketch stays as `<m>.sketch`."""
    from ..functions.timedim import rebuilt
    from ..plans.spec import LEVELS

    have = set(states.columns)
    out = [F.col(x) for x in LEVELS if x in have]
    for d in spec.dimensions:
        if d == spec.time:
            if have & set(LEVELS):
                out.append(rebuilt({x: F.col(x) for x in LEVELS if x in have}).alias(d))
        elif d in have:
            out.append(F.col(d))
    out.append(F.col(CNT).alias(COUNT))
    for m in spec.measures:
        if m.distinct:
            out += [F.hll_sketch_estimate(f"{m.name}_hll").alias(f"{m.name}.distinct"), F.col(f"{m.name}_hll").alias(f"{m.name}.sketch")]
        else:
            out += [F.col(f"{m.name}_{s}").alias(f"{m.name}.{s}") for s in ("min", "max", "sum")]
    return states.select(*out)
