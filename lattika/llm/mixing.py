"""Mixing sources to target weights by Pfair scheduling.

Every stream (a source; rows without one are a stream too) is cut into blocks of documents. With
integer weights a_i that sum to q, block k of stream i may run from slot floor(k q / a_i) and must run
before slot ceil((k + 1) q / a_i); one block runs in each slot, by earliest deadline first. Such a schedule
repeats every q slots and keeps each stream within one block of its share at any slot. When a stream runs
out, a new phase starts for those that remain, with the same weights among them, until all is placed.
The driver computes one period of each phase, or the phase if that is shorter, so at most q slots a phase, one phase a
stream and never more slots than blocks; the documents get their places by a join with that table.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

#: Target weights in parts; the part of "*" is divided evenly among the other sources present.
WEIGHTS = {"src0": 12, "src1": 8, "src2": 8, "src3": 6, "*": 66}
BLOCK, LEAST_BUCKETS = 16, 64
"""Documents a block; buckets a stream at least, which spread a hot stream over tasks."""
POOL = "*"


def own_weights(sources: Iterable[str], targets: dict[str, int] | None = None) -> dict[str, int]:
    """A weight for each source present: its target, or an equal part of what "*" holds; rows without source count as one source, "*"."""
    targets = WEIGHTS if targets is None else targets
    named = {s: a for s, a in targets.items() if s != POOL}
    others = sorted(s for s in sources if s not in named)
    whole = {s: a * max(1, len(others)) for s, a in named.items() if s in set(sources)} | dict.fromkeys(others, targets.get(POOL, 1))
    shared = gcd(*whole.values())
    return {s: a // shared for s, a in whole.items()}


def period(weights: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots that each stream gets in one period of sum(weights) slots, by EDF over the Pfair windows.

    left: the streams' blocks; the period is cut off where a stream has none for its slot.
    """
    q = sum(weights.values())
    released: dict[int, list[str]] = {0: sorted(weights)}
    ready: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for t in range(q):
        for s in released.pop(t, []):
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * q // weights[s]), s))
        deadline, s = heapq.heappop(ready)
        if t >= deadline:
            raise ValueError("weights must be positive")
        if left is not None and len(slots[s]) == left[s]:
            break
        slots[s].append(t)
        k = len(slots[s])
        if k < weights[s]:
            released.setdefault(max(t + 1, k * q // weights[s]), []).append(s)
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """Phases in order: first slot, the streams' weights, period and first blocks, until every block has a slot."""
    left, done, start, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        own = {s: weights[s] for s in left}
        slots, q = period(own, left), sum(own.values())
        end = sum(map(len, slots.values()))
        cut = end < q
        if not cut:
            # The slot in which each stream would want a block that it no longer has; the earliest ends the phase.
            end = min(n // own[s] * q + slots[s][n % own[s]] for s, n in left.items())
        out.append({"start": start, "q": q, "weights": own, "slots": slots, "first": {s: done[s] for s in own}})
        for s in own:
            used = len(slots[s]) if cut else end // q * own[s] + bisect_left(slots[s], end % q)
            done[s] += used
            left[s] -= used
        left = {s: n for s, n in left.items() if n > 0}
        start += end
    return out


def plan_rows(weights: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """(stream, phase, from block, to block, k, a, q, start, slot): at most q rows a phase, and at most one phase a stream."""
    plan, rows = phases(weights, blocks), []
    for n, p in enumerate(plan):
        for s, a in p["weights"].items():
            to = plan[n + 1]["first"].get(s, blocks[s]) if n + 1 < len(plan) else blocks[s]
            if p["first"][s] < to:
                rows += [(s, n, p["first"][s], to, k, a, p["q"], p["start"], slot) for k, slot in enumerate(p["slots"][s])]
    return rows


def numbered(docs: DataFrame, weights: dict[str, int] | None, scratch: Scratch, key: str = "doc_id", source: str = "source", payload: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """docs with their stream and their number in it, in the order of a hash of the key; and the streams' sizes.

    Each source is a stream; with weights those that have one, and the rest is the pool. A stream is numbered
    in buckets of that hash, so no task gets more than a bucket of a hot stream.
    """
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, 4 * shuffle_partitions(spark))
    if weights is None:
        stream = F.coalesce(source, F.lit(POOL))
    else:
        named = [s for s in weights if s != POOL]
        stream = F.when(F.col(source).isin(named), F.col(source)).otherwise(F.lit(POOL)) if named else F.lit(POOL)
    rest = payload or []
    body = [F.col(c).alias(f"_p{i}") for i, c in enumerate(rest)]
    # Copies of a row under one key spread too: the hash takes the text where there is one.
    spread = [c for c in (key, "text") if c in docs.columns]
    d = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), stream.alias("_stream"), F.xxhash64(*spread).alias("_h"), *body)
    d = d.withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    sizes = scratch.cut(d.groupBy("_stream", "_bucket").count(), "mix-sizes")
    totals = {r["_stream"]: r["n"] for r in sizes.groupBy("_stream").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("_stream").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("_stream", "_bucket").orderBy("_h", "_key")
    d = d.withColumn("_n", F.row_number().over(inside) - 1).join(starts, ["_stream", "_bucket"])
    return d.withColumn("_n", F.col("_n") + F.col("_start")), totals


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, scratch: Scratch | None = None, payload: list[str] | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row with its place: stream, block, release, deadline, slot, phase and position; position orders the mixture.

    payload: columns of docs to carry along (as _p0, _p1, ...). Without weights each source present is a
    stream: those in WEIGHTS have their targets, the others equal parts of the rest; rows without source are
    the stream "*". With weights, rows of a source that has none belong to "*", too, which gets 1 if it has
    no weight. Repeated rows get places of their
    own. An empty table gives an empty result. Nothing is dropped or repeated: while all streams last, each
    prefix holds the target weights to less than a block; later ones hold them among the streams left.
    """
    weights = None if weights is None else {POOL: 1} | weights
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    d, totals = numbered(docs, weights, scratch, key, source, payload)
    weights = own_weights(totals) if weights is None else weights
    blocks = {s: -(-n // block) for s, n in totals.items()}
    kind = "_s string, phase long, _from long, _to long, _k long, _a long, _q long, _first long, _slot long"
    table = spark.createDataFrame(plan_rows(weights, blocks), kind)
    d = d.withColumn("block", F.floor(F.col("_n") / block)).withColumn("_in", F.col("_n") % block)
    # The block's row of the table: its phase is the one whose range holds it, its slot the one of its number in the period.
    ranges = table.groupBy("_s", "phase", "_from", "_to", "_a").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    d = d.join(F.broadcast(ranges.withColumnRenamed("_s", "_r").withColumnRenamed("phase", "_ph").withColumnRenamed("_a", "_ra")), (F.col("_stream") == F.col("_r")) & (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to")))
    d = d.withColumn("_local", F.col("block") - F.col("_from")).withColumn("_m", F.col("_local") % F.col("_ra")).drop("_from", "_to")
    d = d.join(F.broadcast(table.drop("_from", "_to")), (F.col("_stream") == F.col("_s")) & (F.col("_ph") == F.col("phase")) & (F.col("_m") == F.col("_k")))
    turn = F.floor(F.col("_local") / F.col("_a"))
    slot = F.col("_first") + turn * F.col("_q") + F.col("_slot")
    release = F.col("_first") + F.floor(F.col("_local") * F.col("_q") / F.col("_a"))
    deadline = F.col("_first") + F.ceil((F.col("_local") + 1) * F.col("_q") / F.col("_a"))
    out = d.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_stream").alias("stream"), F.col("block").cast("long").alias("block"), release.cast("long").alias("release"), deadline.cast("long").alias("deadline"), slot.cast("long").alias("slot"), "phase", (slot * block + F.col("_in")).cast("long").alias("position"), *[f"_p{i}" for i in range(len(payload or []))])
    return out


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """All rows of docs with their own columns, in the order of the mixture: each partition is a run of it, sorted."""
    names = docs.columns
    placed = schedule(docs, weights, block, scratch, payload=names)
    ordered = placed.repartitionByRange(shuffle_partitions(docs.sparkSession), "position").sortWithinPartitions("position")
    return ordered.select(*[F.col(f"_p{i}").alias(c) for i, c in enumerate(names)])
