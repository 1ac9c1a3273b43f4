"""Chat formatting: logged snapshots of one conversation collapse to the longest, which is rendered.

Each turn gets a rolling hash of the turns up to it (two 64-bit hashes of position, role and text, combined by
xor along the conversation). A conversation whose last hash is another's hash at the same position, with more
turns behind, is a prefix and goes by anti-join. Of identical conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns, role, text and the hashes h1, h2 of all turns up to this one.

    Repeated rows (same conv_id, turn, role and text) count once; ties of turn are ordered by role, then
    text, nulls first. A row without conv_id is a conversation of its own, told by its hash, so that no task gets
    all such rows. pos counts from 1 whatever turn holds.
    """
    t = turns.select("conv_id", "turn", "role", "text")
    t = t.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64(F.col("turn").isNull(), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")))
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    same = F.col("turn").eqNullSafe(F.lag("turn").over(order)) & F.col("role").eqNullSafe(F.lag("role").over(order)) & F.col("text").eqNullSafe(F.lag("text").over(order))
    t = t.withColumn("first", F.row_number().over(order) == 1).withColumn("same", same).filter(F.col("first") | ~F.col("same")).drop("first", "same")
    t = t.withColumn("pos", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null and empty must differ, as must ("a", "b") and ("ab", ""): the hash takes each column on its own, with its null flag.
    parts = ["pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    mixed = lambda seed: F.xxhash64(F.lit(seed), *parts)
    t = t.withColumn("h1", F.bit_xor(mixed(1)).over(so_far)).withColumn("h2", F.bit_xor(mixed(2)).over(so_far))
    return t.withColumn("n_turns", F.max("pos").over(Window.partitionBy("conv_id", "own")))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that prefix no longer one."""
    ends = prefixes.filter(F.col("pos") == F.col("n_turns")).groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min(F.when(F.col("conv_id").isNull(), F.col("own"))).alias("own"), F.count(F.lit(1)).alias("n_copies"))
    inner = prefixes.filter(F.col("pos") < F.col("n_turns")).select("pos", "h1", "h2").distinct()
    return ends.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.when(F.col("conv_id").isNull(), F.col("own")).alias("own"), F.col("pos").cast("long").alias("n_turns"), "n_copies")


def guarded(column: F.Column) -> F.Column:
    """Text that holds a marker of the format can't open or close a turn."""
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def collapse(turns: DataFrame) -> DataFrame:
    """One row per retained conversation: conv_id, n_turns, n_copies, rendered, assistant_chars.

    rendered holds `<|im_start|>role`, a line break, the text and `<|im_end|>` with a line break for every
    turn; a null role renders as `user`, a null text as nothing; texts are never cut. Identical conversations
    keep the least conv_id, and null only if none has one. An empty table gives an empty result; other
    columns are ignored.
    """
    p = turn_prefixes(turns)
    kept = maximal(p)
    role = guarded(F.coalesce(F.col("role"), F.lit("user")))
    one = F.struct("pos", F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), guarded(F.col("text")), F.lit("<|im_end|>\n")).alias("s"))
    said = F.sum(F.when(F.col("role") == "assistant", F.length(guarded(F.col("text")))).otherwise(0)).alias("assistant_chars")
    texts = p.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(one)).alias("all"), said)
    texts = texts.select(F.col("conv_id").alias("c"), F.col("own").alias("o"), F.concat_ws("", F.transform("all", lambda x: x["s"])).alias("rendered"), "assistant_chars")
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("own").eqNullSafe(F.col("o"))).select("conv_id", "n_turns", "n_copies", "rendered", "assistant_chars")


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
g AS (SELECT *, CASE WHEN conv_id IS NULL THEN coalesce(CAST(turn AS VARCHAR), 'n') || coalesce(' r' || length(role) || ':' || role, ' n') || coalesce(' t' || text, ' n') END AS own FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM g),
s AS (SELECT conv_id, own, pos, role, text,
             replace(coalesce(text, ''), '<|im_', '<| im_') AS body,
             '<|im_start|>' || replace(coalesce(role, 'user'), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS one,
             coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n') AS k FROM r),
p AS (SELECT conv_id, own, pos, md5(string_agg(k, '') OVER (PARTITION BY conv_id, own ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h,
             max(pos) OVER (PARTITION BY conv_id, own) AS n_turns FROM s),
e AS (SELECT pos, h, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(own) END AS own, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY pos, h),
k AS (SELECT conv_id, own, pos, n_copies FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = e.pos AND p.h = e.h))
SELECT k.conv_id, CAST(k.pos AS BIGINT) AS n_turns, k.n_copies, string_agg(s.one, '' ORDER BY s.pos) AS rendered,
       CAST(sum(CASE WHEN s.role = 'assistant' THEN length(s.body) ELSE 0 END) AS BIGINT) AS assistant_chars
FROM k JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.own IS NOT DISTINCT FROM s.own GROUP BY k.conv_id, k.own, k.pos, k.n_copies
"""
