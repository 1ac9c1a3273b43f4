"""One query per operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sql as sqlapi
from .engine import CubeEngine, Query
from .functions import scalar, timedim
from .operators import cube, keys, search, states, vectors
from .plans import timeplan
from .plans.spec import LEVELS, CubeSpec, cuboid_name, parents
from .scratch import fresh
from .sources import documents as documents_source
from .sources import facts as fact_streams
from .sources import files

LINEITEM = CubeSpec.parse("sales.lineitem", "l_returnflag:string|l_linestatus:string|l_shipdate:timestamp", "l_quantity:double,l_extendedprice:double,l_orderkey.distinct:long", time="l_shipdate", index="l_returnflag")
FLAGS = CubeSpec.parse("sales.flags", "l_returnflag:string|l_linestatus:string", "l_quantity:double,l_extendedprice:double")
PLACES = CubeSpec.parse("sales.places", "r_name:string|n_name:string", "l_quantity:double", hierarchies="r_name:n_name")
JOINT = CubeSpec.parse("sales.joint", "o_orderstatus:string|o_orderpriority:string|o_year:string", "o_totalprice:double", joints="o_orderstatus:o_orderpriority")
MANDATORY = CubeSpec.parse("sales.mandatory", "o_orderstatus:string|o_orderpriority:string", "o_totalprice:double", mandatory="o_orderstatus")
EVENTS = CubeSpec.parse("web.events", "event_type:string|ts:timestamp", "value:double", time="ts")
TYPES = CubeSpec.parse("web.types", "event_type:string", "value:double,user_id.distinct:long")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(name: str):
    return F.round(name, 2).alias(name)


# ---- aggregation


@query("d01_count", "SELECT l_returnflag, count(*) AS cnt FROM lineitem GROUP BY 1")
def d01(spark, sf):
    return cube.rollup(cube.base(table(spark, sf, "lineitem"), FLAGS), ["l_returnflag"], FLAGS).select("l_returnflag", "cnt")


@query("d02_sum_min_max", "SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_quantity), 2) AS s, min(l_quantity) AS mn, max(l_quantity) AS mx, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2")
def d02(spark, sf):
    b = cube.base(table(spark, sf, "lineitem"), FLAGS)
    return b.select("l_returnflag", "l_linestatus", "cnt", F.round("l_quantity_sum", 2).alias("s"), F.col("l_quantity_min").alias("mn"), F.col("l_quantity_max").alias("mx"), F.round("l_extendedprice_sum", 2).alias("price"))


@query("d03_avg_derived", "SELECT l_returnflag, round(sum(l_quantity) / count(*), 6) AS avg_quantity FROM lineitem GROUP BY 1")
def d03(spark, sf):
    b = cube.rollup(cube.base(table(spark, sf, "lineitem"), FLAGS), ["l_returnflag"], FLAGS).select("l_returnflag", *states.finished(FLAGS))
    return b.select("l_returnflag", F.round("l_quantity_avg", 6).alias("avg_quantity"))


@query("d05_distinct_within", "SELECT l_returnflag, true AS ok FROM lineitem GROUP BY 1")
def d05(spark, sf):
    # Three standard errors of the sketch.
    t, bound = table(spark, sf, "lineitem"), 3 * states.error_rate()
    est = cube.rollup(cube.base(t, LINEITEM), ["l_returnflag"], LINEITEM).select("l_returnflag", F.hll_sketch_estimate("l_orderkey_hll").alias("e"))
    exact = t.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("x"))
    return est.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("e") - F.col("x")) <= bound * F.col("x")).alias("ok"))


@query("d06_dirty_facts", """
WITH f AS (SELECT event_type, CASE WHEN event_id % 7 IN (0, 1) THEN 0.0 ELSE round(value, 2) END AS v FROM events)
SELECT event_type, count(*) AS cnt, round(sum(v), 2) AS s, min(v) AS mn FROM f GROUP BY 1""")
def d06(spark, sf):
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 7 == 1, F.lit("abc")).otherwise(F.round("value", 2).cast("string"))
    when = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.lit("xx")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
    content = e.select(F.to_json(F.struct("event_type", value.alias("value"), when.alias("ts"), F.lit("x").alias("other"))).alias("content"))
    b = cube.base(fact_streams.from_json(content, EVENTS), EVENTS, raw=True)
    return cube.rollup(b, ["event_type"], EVENTS).select("event_type", "cnt", F.round("value_sum", 2).alias("s"), F.col("value_min").alias("mn"))


@query("d09_rollup_from_parent", "SELECT l_linestatus, count(*) AS cnt, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1")
def d09(spark, sf):
    b = cube.base(table(spark, sf, "lineitem"), FLAGS)
    return cube.rollup(b, ["l_linestatus"], FLAGS).select("l_linestatus", "cnt", F.round("l_quantity_sum", 2).alias("s"))


SEGMENTED = CubeSpec.parse("sales.segmented", "seg:long|l_returnflag:string|l_linestatus:string", "l_quantity:double,l_extendedprice:double")


@query("d10_merge_segments", "SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_quantity), 2) AS s, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem GROUP BY 1, 2")
def d10(spark, sf):
    segments = cube.base(table(spark, sf, "lineitem").withColumn("seg", F.pmod("l_orderkey", F.lit(16))), SEGMENTED)
    merged = cube.rollup(segments, ["l_returnflag", "l_linestatus"], FLAGS)
    return merged.select("l_returnflag", "l_linestatus", "cnt", F.round("l_quantity_sum", 2).alias("s"), F.col("l_extendedprice_min").alias("mn"), F.col("l_extendedprice_max").alias("mx"))


CUBE_SQL = """SELECT CASE grouping_id(l_returnflag, l_linestatus) WHEN 0 THEN 'l_linestatus:l_returnflag' WHEN 1 THEN 'l_returnflag' WHEN 2 THEN 'l_linestatus' ELSE '' END AS cuboid,
l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""


@query("d11_cube_grouping_sets", CUBE_SQL)
def d11(spark, sf):
    got = cube.grouping_sets(cube.base(table(spark, sf, "lineitem"), FLAGS), FLAGS, FLAGS.lattice())
    return got.select("cuboid", "l_returnflag", "l_linestatus", "cnt", F.round("l_quantity_sum", 2).alias("s"))


@query("d11_cube_staged", CUBE_SQL)
def d11b(spark, sf):
    out = None
    for dims, df in cube.staged(table(spark, sf, "lineitem"), FLAGS).items():
        cells = [F.col(d) if d in dims else F.lit(None).cast("string").alias(d) for d in ("l_returnflag", "l_linestatus")]
        one = df.select(F.lit(cuboid_name(dims)).alias("cuboid"), *cells, "cnt", F.round("l_quantity_sum", 2).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out


def places(spark, sf):
    t, s, n, r = (table(spark, sf, x) for x in ("lineitem", "supplier", "nation", "region"))
    return t.join(s, t.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "l_quantity")


PLACES_FROM = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("d13_hierarchy_rollup", f"SELECT CASE grouping_id(r_name, n_name) WHEN 0 THEN 'n_name:r_name' WHEN 1 THEN 'r_name' ELSE '' END AS cuboid, r_name, n_name, count(*) AS cnt, round(sum(l_quantity), 2) AS s {PLACES_FROM} GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())")
def d13(spark, sf):
    got = cube.grouping_sets(cube.base(places(spark, sf), PLACES), PLACES, PLACES.lattice())
    return got.select("cuboid", "r_name", "n_name", "cnt", F.round("l_quantity_sum", 2).alias("s"))


def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("o_year", F.date_format("o_orderdate", "yyyy"))


@query("d14_joint_cuboids", """
WITH o AS (SELECT *, strftime(o_orderdate, '%Y') AS o_year FROM orders)
SELECT CASE grouping_id(o_orderstatus, o_orderpriority, o_year) WHEN 0 THEN 'o_orderpriority:o_orderstatus:o_year' WHEN 1 THEN 'o_orderpriority:o_orderstatus' WHEN 6 THEN 'o_year' ELSE '' END AS cuboid,
o_orderstatus, o_orderpriority, o_year, count(*) AS cnt FROM o GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority, o_year), (o_orderstatus, o_orderpriority), (o_year), ())""")
def d14(spark, sf):
    got = cube.grouping_sets(cube.base(orders(spark, sf), JOINT), JOINT, JOINT.lattice())
    return got.select("cuboid", "o_orderstatus", "o_orderpriority", "o_year", "cnt")


@query("d15_mandatory_cuboids", """
SELECT CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 0 THEN 'o_orderpriority:o_orderstatus' ELSE 'o_orderstatus' END AS cuboid,
o_orderstatus, o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))""")
def d15(spark, sf):
    got = cube.grouping_sets(cube.base(orders(spark, sf), MANDATORY), MANDATORY, MANDATORY.lattice())
    return got.select("cuboid", "o_orderstatus", "o_orderpriority", "cnt", F.round("o_totalprice_sum", 2).alias("s"))


def with_removals(spark, sf, removed) -> DataFrame:
    t = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_linenumber")
    return t.withColumn("OLAP_OPERATION", F.lit("ADD")).unionByName(t.filter(removed).withColumn("OLAP_OPERATION", F.lit("REMOVE")))


@query("d17_retraction", """
WITH f AS (SELECT l_returnflag, l_quantity, 1 AS s FROM lineitem UNION ALL SELECT l_returnflag, l_quantity, -1 FROM lineitem WHERE l_linenumber % 7 = 0)
SELECT l_returnflag, CAST(sum(s) AS BIGINT) AS cnt, round(sum(l_quantity * s), 2) AS total, min(l_quantity) AS mn, max(l_quantity) AS mx FROM f GROUP BY 1 HAVING sum(s) <> 0 OR round(sum(l_quantity * s), 6) <> 0""")
def d17(spark, sf):
    b = cube.rollup(cube.base(with_removals(spark, sf, F.col("l_linenumber") % 7 == 0), FLAGS), ["l_returnflag"], FLAGS).filter(states.valid(FLAGS))
    return b.select("l_returnflag", "cnt", F.round("l_quantity_sum", 2).alias("total"), F.col("l_quantity_min").alias("mn"), F.col("l_quantity_max").alias("mx"))


@query("d17_full_cancel", "SELECT l_returnflag, count(*) AS cnt FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def d17b(spark, sf):
    b = cube.rollup(cube.base(with_removals(spark, sf, F.col("l_returnflag") == "R"), FLAGS), ["l_returnflag"], FLAGS)
    return b.filter(states.valid(FLAGS)).select("l_returnflag", "cnt")


@query("d25_event_bounds", "SELECT event_id % 4 AS segment, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS eldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS youngest FROM events GROUP BY 1")
def d25(spark, sf):
    got = cube.event_bounds(table(spark, sf, "events").withColumn("segment", F.col("event_id") % 4), "ts", "segment")
    return got.select("segment", F.date_format("eldest", "yyyy-MM-dd HH:mm:ss").alias("eldest"), F.date_format("youngest", "yyyy-MM-dd HH:mm:ss").alias("youngest"))


WORDS = "(SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents)"


@query("d21_error_rate", "SELECT round(1.04 / sqrt(16384), 9) AS rate")
def d21(spark, sf):
    return spark.range(1).select(F.round(F.lit(states.error_rate()), 9).alias("rate"))


@query("d24_sketch_order", "SELECT event_type, row_number() OVER (ORDER BY count(DISTINCT user_id) DESC, event_type) AS place FROM events GROUP BY 1")
def d24(spark, sf):
    e = table(spark, sf, "events")
    return cube.distinct_order(cube.base(e, TYPES), e, ["event_type"], "user_id").select("event_type", F.col("place").cast("long").alias("place"))


@query("d29_bag_scale", f"SELECT word, CAST(count(*) * 0.5 AS DOUBLE) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1")
def d29(spark, sf):
    return search.bag_times(search.bag(table(spark, sf, "documents"), "doc_id", "text"), 0.5)


@query("d30_document_frequency", f"SELECT word, count(DISTINCT doc_id) AS df FROM {WORDS} WHERE word <> '' GROUP BY 1")
def d30(spark, sf):
    return search.frequencies(search.postings(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


@query("d30_adjusted_index", f"""
WITH t AS (SELECT doc_id, word, count(*) AS tf FROM {WORDS} WHERE word <> '' AND doc_id % 3 <> 0 GROUP BY 1, 2)
SELECT word, doc_id, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS length FROM t""")
def d30b(spark, sf):
    p = search.postings(table(spark, sf, "documents"), "doc_id", "text")
    gone = p.filter("doc_id % 3 = 0").select("word", "doc_id", (-F.col("tf")).alias("tf"))
    return search.adjusted(p, gone, "doc_id").select("word", "doc_id", "tf", "length")


@query("d31_length_refresh", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS length, count(DISTINCT word) AS words FROM {WORDS} WHERE word <> '' GROUP BY 1")
def d31(spark, sf):
    stale = search.postings(table(spark, sf, "documents"), "doc_id", "text").withColumn("length", F.lit(-1))
    return search.refreshed(stale, "doc_id").groupBy("doc_id").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("words"))


def by_source(spark, sf) -> DataFrame:
    """side (two halves of documents), lang, source and how many documents."""
    return table(spark, sf, "documents").groupBy((F.col("doc_id") % 2).alias("side"), "lang", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def side_maps(rows: DataFrame, key: str, value: str, empty: str) -> DataFrame:
    """m0 and m1: the maps key -> value of the two sides."""
    side = rows.groupBy("side").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    return side.agg(*[F.coalesce(F.first(F.when(F.col("side") == k, F.col("m")), ignorenulls=True), F.expr(f"map_from_entries(cast(array() as array<struct<k:string,v:{empty}>>))")).alias(f"m{k}") for k in (0, 1)])


@query("d33_map_merge", "SELECT coalesce(source, '') AS source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1")
def d33(spark, sf):
    both = side_maps(by_source(spark, sf).groupBy("side", "source").agg(F.sum("n").alias("n")), "source", "n", "double")
    return both.select(F.explode(scalar.map_sum(F.col("m0"), F.col("m1"))).alias("source", "n"))


@query("d33_map_merge_nested", "SELECT lang, coalesce(source, '') AS source, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2")
def d33b(spark, sf):
    inner = by_source(spark, sf).filter("lang is not null").groupBy("side", "lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    both = side_maps(inner, "lang", "m", "map<string,double>")
    return both.select(F.explode(scalar.map_sum2(F.col("m0"), F.col("m1"))).alias("lang", "m")).select("lang", F.explode("m").alias("source", "n"))


@query("d34_parents", """
WITH n AS (SELECT count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linestatus) AS s FROM lineitem)
SELECT * FROM (VALUES ('l_linestatus:l_returnflag', NULL), ('l_linestatus', 'l_linestatus:l_returnflag'), ('l_returnflag', 'l_linestatus:l_returnflag')) AS t(cuboid, parent)
UNION ALL SELECT '', CASE WHEN s <= f THEN 'l_linestatus' ELSE 'l_returnflag' END FROM n""")
def d34(spark, sf):
    e = engine(spark)
    e.create(FLAGS)
    e.ingest(FLAGS, table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"))
    counts = {tuple(r["cuboid"].split(":")) if r["cuboid"] else (): r["n_rows"] for r in e.cuboids(FLAGS).collect()}
    return spark.createDataFrame([(cuboid_name(c), cuboid_name(p) if p is not None else None) for c, p in parents(FLAGS.lattice(), counts).items()], "cuboid string, parent string")




# ---- engine: segments, routing, maintenance


def engine(spark: SparkSession) -> CubeEngine:
    return CubeEngine(spark, fresh(spark, "cubes"))


def filled(spark, sf, spec: CubeSpec, name: str, key: str, parts: int, columns: list[str]) -> CubeEngine:
    e = engine(spark)
    e.create(spec)
    t = table(spark, sf, name)
    for k in range(parts):
        e.ingest(spec, t.filter(F.pmod(F.col(key), F.lit(parts)) == k).select(*columns))
    return e


ORDER_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
ORDERS = CubeSpec.parse("sales.orders", "o_orderstatus:string|o_orderpriority:string", "o_totalprice:double")


@query("a11_merge_segments", "SELECT o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders GROUP BY 1")
def a11(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 3, ORDER_COLUMNS)
    return e.query(ORDERS, Query(("o_orderpriority",))).select("o_orderpriority", "cnt", F.round("o_totalprice_sum", 2).alias("s"), F.col("o_totalprice_min").alias("mn"), F.col("o_totalprice_max").alias("mx"))


@query("a09_cuboid_scan_range", "SELECT o_orderpriority, count(*) AS cnt, row_number() OVER (ORDER BY o_orderpriority) AS place FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4' AND o_orderkey % 2 = 0 GROUP BY 1")
def a09(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 2, ORDER_COLUMNS)
    got = e.scan(ORDERS, ("o_orderpriority",), [1], (F.col("o_orderpriority") >= "2") & (F.col("o_orderpriority") < "4"), check=True)
    return as_delivered(got).select("o_orderpriority", "cnt", "place")


@query("a13_cursor", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def a13(spark, sf):
    c = keys.Cursor(table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"))
    rows = [c.next(), *c.take(24)]
    c.close()
    return spark.createDataFrame(rows, "o_orderkey long, o_totalprice double")


@query("a38_segment_ids", "SELECT DISTINCT o_orderkey % 3 + 1 AS segment_id FROM orders")
def a38(spark, sf):
    return filled(spark, sf, ORDERS, "orders", "o_orderkey", 3, ORDER_COLUMNS).segment_ids(ORDERS, ("o_orderstatus",))


@query("j01_operations", "SELECT o_orderpriority, count(*) AS cnt, CAST(1 AS BIGINT) AS segments FROM orders GROUP BY 1")
def j01(spark, sf):
    e, t = engine(spark), table(spark, sf, "orders")
    e.create(MANDATORY)
    for k in (0, 1):
        e.operate("build", MANDATORY, facts=t.filter(F.pmod("o_orderkey", F.lit(2)) == k).select(*ORDER_COLUMNS))
    e.operate("mend", MANDATORY, dims=("o_orderpriority",))
    e.operate("flush", MANDATORY)
    live = e.operate("info", MANDATORY).filter("phase = 'PRODUCTIVE'").count()
    return e.query(MANDATORY, Query(("o_orderpriority",))).select("o_orderpriority", "cnt", F.lit(live).cast("long").alias("segments"))


@query("b21_loosened_query", f"SELECT n_name, count(*) AS cnt {PLACES_FROM} GROUP BY 1")
def b21(spark, sf):
    e = engine(spark)
    e.create(PLACES)
    e.ingest(PLACES, places(spark, sf))
    return e.query(PLACES, Query(("n_name",))).select("n_name", "cnt")


@query("h04_granularity_query", "SELECT strftime(ts, '%Y') AS \"OLAP_YEAR\", strftime(ts, '%m') AS \"OLAP_MONTH\", count(*) AS cnt, round(sum(value), 2) AS s FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1, 2")
def h04(spark, sf):
    e = engine(spark)
    e.create(EVENTS)
    e.ingest(EVENTS, table(spark, sf, "events").select("event_type", "ts", "value"))
    q = Query(("OLAP_YEAR", "OLAP_MONTH"), (("ts", ">=", "2024-01-05"), ("ts", "<", "2024-01-20")))
    return e.query(EVENTS, q).select("OLAP_YEAR", "OLAP_MONTH", "cnt", F.round("value_sum", 2).alias("s"))


@query("b06_time_prefix", "SELECT event_type, count(*) AS cnt FROM events WHERE ts >= '2024-01-07' AND ts < '2024-01-08' GROUP BY 1")
def b06(spark, sf):
    b = cube.base(table(spark, sf, "events"), EVENTS).filter(timedim.under("2024-01-07", 3))
    return cube.rollup(b, ["event_type"], EVENTS).select("event_type", "cnt")


@query("b04_range_filter", "SELECT event_type, count(*) AS cnt FROM events WHERE strftime(ts, '%d') >= '10' AND strftime(ts, '%d') < '12' GROUP BY 1")
def b04(spark, sf):
    b = cube.base(table(spark, sf, "events"), EVENTS)
    return cube.rollup(keys.key_range(b, "OLAP_DAY", "10", "12"), ["event_type"], EVENTS).select("event_type", "cnt")


@query("b19_published_view", 'SELECT o_orderstatus, o_orderpriority, count(*) AS "OLAP_COUNT", round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least FROM orders GROUP BY 1, 2')
def b19(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 2, ORDER_COLUMNS)
    e.view(ORDERS, "orders_cube")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, OLAP_COUNT, round(`o_totalprice.sum`, 2) AS total, `o_totalprice.min` AS least FROM orders_cube")


@query("b22_sql_limit", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 20")
def b22(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_rows")
    return sqlapi.execute(spark, "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT * FROM lineitem_rows ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice)", max_rows=20)


@query("b16_parameters", "SELECT l_returnflag, count(*) AS cnt FROM lineitem WHERE l_quantity > 25 AND l_linestatus = 'O' GROUP BY 1")
def b16(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_rows")
    return sqlapi.execute(spark, "SELECT l_returnflag, count(*) AS cnt FROM lineitem_rows WHERE l_quantity > ? AND l_linestatus = ? GROUP BY 1", [25, "O"])


@query("b17_like_catalog", "SELECT * FROM (VALUES ('cat_nation', 'n_name'), ('cat_nation', 'n_nationkey')) AS t(\"table\", \"column\")")
def b17(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("cat_nation")
    table(spark, sf, "region").createOrReplaceTempView("cat_region")
    rows = [("", t, c) for t in ("cat_nation", "cat_region") for c in spark.table(t).columns]
    catalog = spark.createDataFrame(rows, "schema string, table string, column string")
    return sqlapi.search(catalog, table="cat_n%", column="n\\_na%").select("table", "column")


@query("i08_compaction", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2")
def i08(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 5, ORDER_COLUMNS)
    e.compact(ORDERS)
    return e.query(ORDERS, Query(("o_orderstatus", "o_orderpriority"))).select("o_orderstatus", "o_orderpriority", "cnt", F.round("o_totalprice_sum", 2).alias("s"))


@query("i09_mend", "SELECT o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1")
def i09(spark, sf):
    e = filled(spark, sf, MANDATORY, "orders", "o_orderkey", 2, ORDER_COLUMNS)
    e.mend(MANDATORY, ("o_orderpriority",))
    return e.query(MANDATORY, Query(("o_orderpriority",))).select("o_orderpriority", "cnt")


@query("i06_ttl", "SELECT event_type, count(*) AS cnt FROM events WHERE ts >= '2024-01-16' GROUP BY 1")
def i06(spark, sf):
    spec = CubeSpec.parse("web.short", "event_type:string|ts:timestamp", "value:double", time="ts", ttl_ms=14 * 86_400_000)
    e = engine(spark)
    e.create(spec)
    t = table(spark, sf, "events").select("event_type", "ts", "value")
    for keep in (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")):
        e.ingest(spec, t.filter(keep))
    e.expire(spec, "2024-01-30 00:00:00")
    return e.query(spec, Query(("event_type",))).select("event_type", "cnt")


ROWS_SQL = "WITH s AS (SELECT o_orderkey % 2 + 1 AS segment, count(DISTINCT (o_orderpriority, o_orderstatus)) AS a, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderstatus) AS t, 1 AS d FROM orders GROUP BY 1)"


@query("d27_statistics", ROWS_SQL + " SELECT 'cuboid' AS kind, 'PRODUCTIVE' AS phase, CAST(4 AS BIGINT) AS n, CAST(sum(a + p + t + d) AS BIGINT) AS n_rows FROM s UNION ALL SELECT 'segment', 'PRODUCTIVE', count(*), CAST(sum(a + p + t + d) AS BIGINT) FROM s")
def d27(spark, sf):
    return filled(spark, sf, ORDERS, "orders", "o_orderkey", 2, ORDER_COLUMNS).statistics(ORDERS)


@query("d28_audit", "SELECT DISTINCT o_orderkey % 2 + 1 AS segment_id, CAST(3 AS INTEGER) AS cuboid_id FROM orders WHERE o_orderkey % 2 = 1")
def d28(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 2, ORDER_COLUMNS)
    # A cuboid's files are lost.
    files.delete(spark, f"{e.root}/{ORDERS.name}/cuboid=3/segment=2")
    return e.audit(ORDERS)


@query("a30_cuboid_catalog", """
SELECT * FROM (VALUES ('o_orderpriority:o_orderstatus', (SELECT sum(n) FROM (SELECT count(DISTINCT (o_orderpriority, o_orderstatus)) AS n FROM orders GROUP BY o_orderkey % 2))),
('o_orderpriority', (SELECT sum(n) FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderkey % 2))),
('o_orderstatus', (SELECT sum(n) FROM (SELECT count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_orderkey % 2))), ('', 2)) AS t(cuboid, n_rows)""".replace("AS t(cuboid, n_rows)", "AS t(cuboid, n)"))
def a30(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 2, ORDER_COLUMNS)
    return e.cuboids(ORDERS).select("cuboid", F.col("n_rows").alias("n"))


ORACLE_SQL["a30_cuboid_catalog"] = "SELECT cuboid, CAST(n AS BIGINT) AS n FROM (" + ORACLE_SQL["a30_cuboid_catalog"] + ")"


@query("a35_system_facts", ROWS_SQL + """
SELECT 'sales' AS schema, CAST(segment AS VARCHAR) AS segment, cuboid, CAST(n AS DOUBLE) AS n FROM (SELECT segment, 'o_orderpriority:o_orderstatus' AS cuboid, a AS n FROM s UNION ALL SELECT segment, 'o_orderpriority', p FROM s UNION ALL SELECT segment, 'o_orderstatus', t FROM s UNION ALL SELECT segment, '', d FROM s)""")
def a35(spark, sf):
    e = filled(spark, sf, ORDERS, "orders", "o_orderkey", 2, ORDER_COLUMNS)
    f = e.system_facts(ORDERS, "2024-01-01 00:00:00")
    signed = F.when(F.col("OLAP_OPERATION") == "REMOVE", -F.col("count")).otherwise(F.col("count"))
    return f.groupBy("schema", "segment", "cuboid").agg(F.sum(signed).alias("n"))


@query("i03_stream_ingest", "SELECT event_type, count(*) AS cnt, round(sum(value), 2) AS s FROM events GROUP BY 1")
def i03(spark, sf):
    from .streaming.ingest import file_stream, into_cube

    e, folder = engine(spark), fresh(spark, "stream")
    e.create(TYPES)
    t = table(spark, sf, "events").select("event_type", "value", "user_id", "event_id")
    t.repartitionByRange(4, "event_id").drop("event_id").write.parquet(f"{folder}/in")
    into_cube(e, TYPES, file_stream(spark, f"{folder}/in", t.drop("event_id").schema, files_per_batch=2), f"{folder}/checkpoint").awaitTermination()
    return e.query(TYPES, Query(("event_type",))).select("event_type", "cnt", F.round("value_sum", 2).alias("s"))


@query("i04_retraction_stream", """
WITH f AS (SELECT event_type, value, 1 AS s FROM events UNION ALL SELECT event_type, value, -1 FROM events WHERE event_id % 3 = 0)
SELECT event_type, CAST(sum(s) AS BIGINT) AS cnt, round(sum(round(value, 2) * s), 2) AS total FROM f GROUP BY 1""")
def i04(spark, sf):
    from .streaming.ingest import file_stream, into_cube

    e, folder = engine(spark), fresh(spark, "stream")
    e.create(TYPES)
    t = table(spark, sf, "events").withColumn("value", F.round("value", 2))
    fact = lambda op: F.to_json(F.struct("event_type", "value", "user_id", F.lit(op).alias("OLAP_OPERATION"))).alias("content")
    t.select(fact("ADD")).repartition(2).write.parquet(f"{folder}/in")
    t.filter("event_id % 3 = 0").select(fact("REMOVE")).repartition(2).write.mode("append").parquet(f"{folder}/in")
    into_cube(e, TYPES, file_stream(spark, f"{folder}/in", StructType().add("content", "string"), files_per_batch=1), f"{folder}/checkpoint", json_facts=True).awaitTermination()
    return e.query(TYPES, Query(("event_type",))).select("event_type", "cnt", F.round("value_sum", 2).alias("total"))


@query("i12_windowed_counts", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def i12(spark, sf):
    from .streaming.ingest import windowed

    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return windowed(e, "at", ["event_type"], "value", "1 day", "1 hour").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "cnt")




# ---- facts and keys


def appended(spark, sf) -> str:
    root = fresh(spark, "facts")
    e = table(spark, sf, "events")
    fact_streams.append(e.select(F.to_json(F.struct("event_id", "event_type")).alias("content"), F.col("ts").cast("timestamp").alias("ts")), root, "clicks", F.col("ts"))
    return root


@query("a04_fact_range", "SELECT count(*) AS cnt FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-10 12:00:00'")
def a04(spark, sf):
    return fact_streams.scan(spark, appended(spark, sf), "clicks", "2024-01-03", "2024-01-10 12:00:00").agg(F.count(F.lit(1)).alias("cnt"))


@query("a01_bad_facts", """
SELECT CASE WHEN event_id % 9 = 0 THEN 'aside' ELSE event_type END AS what, count(*) AS cnt FROM events GROUP BY 1""")
def a01(spark, sf):
    content = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), F.col("event_type"))).otherwise(F.to_json(F.struct("event_type", "value", "user_id"))).alias("content")
    facts, e = table(spark, sf, "events").select(content), engine(spark)
    e.create(TYPES)
    e.ingest(TYPES, facts, json_facts=True, bad="skip")
    good = e.query(TYPES, Query(("event_type",))).select(F.col("event_type").alias("what"), "cnt")
    return good.unionByName(fact_streams.set_aside(facts).agg(F.lit("aside").alias("what"), F.count(F.lit(1)).alias("cnt")).filter("cnt > 0"))


def as_delivered(df: DataFrame) -> DataFrame:
    """df with each row's place in the order in which it is delivered."""
    return keys.order_ids(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "place").withColumn("place", F.col("place").cast("long"))


@query("a06_merged_streams", """
WITH f AS (SELECT event_id, event_type, ts, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS content FROM events)
SELECT event_id, event_type, row_number() OVER (ORDER BY ts, content) AS place FROM f""")
def a06(spark, sf):
    root = appended(spark, sf)
    parts = [fact_streams.scan(spark, root, "clicks", None, "2024-01-15"), fact_streams.scan(spark, root, "clicks", "2024-01-15", None)]
    got = as_delivered(keys.merged_order(parts, ["ingest", "content"])).select(F.from_json("content", "event_id long, event_type string").alias("c"), "place")
    return got.select("c.event_id", "c.event_type", "place")


@query("a08_fact_compaction", "SELECT count(*) AS cnt, 1 AS files FROM events")
def a08(spark, sf):
    root = appended(spark, sf)
    fact_streams.compact(spark, root, "clicks", 1)
    n = len([f for f in files.listing(spark, f"{root}/clicks") if f.endswith(".parquet")])
    return fact_streams.scan(spark, root, "clicks").agg(F.count(F.lit(1)).alias("cnt"), F.lit(n).alias("files"))


@query("a07_fact_delete", "SELECT event_type, count(*) AS cnt FROM events WHERE event_type <> 'click' GROUP BY 1")
def a07(spark, sf):
    root, e = fresh(spark, "facts"), table(spark, sf, "events")
    rows = e.select(F.to_json(F.struct("event_type")).alias("content"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    fact_streams.append(rows.filter("event_type = 'click'"), root, "clicks", F.col("ts"))
    fact_streams.append(rows.filter("event_type <> 'click'"), root, "rest", F.col("ts"))
    fact_streams.delete(spark, root, "clicks")
    left = fact_streams.scan(spark, root, "clicks").unionByName(fact_streams.scan(spark, root, "rest"))
    return left.select(F.get_json_object("content", "$.event_type").alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))


@query("a17_seek_next", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 5001 ORDER BY o_orderkey LIMIT 1")
def a17(spark, sf):
    return keys.seek(table(spark, sf, "orders"), "o_orderkey", 5001).select("o_orderkey")


@query("a17_seek_before", "SELECT o_orderkey FROM orders WHERE o_orderkey < 5001 ORDER BY o_orderkey DESC LIMIT 1")
def a17b(spark, sf):
    return keys.seek_before(table(spark, sf, "orders"), "o_orderkey", 5001).select("o_orderkey")


@query("a18_multi_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 999, 123456789)")
def a18(spark, sf):
    return keys.multi_get(table(spark, sf, "orders"), "o_orderkey", [1, 7, 999, 123456789]).select("o_orderkey", "o_totalprice")


@query("a19_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def a19(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return keys.upsert(c, c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@query("a20_delete", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def a20(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return keys.delete(c, c.filter("c_custkey % 3 = 0"), "c_custkey")


@query("a19_upsert_versions", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 3.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def a19b(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2)))).withColumn("c_acctbal", F.col("v").cast("double"))
    return keys.upsert(c, new, "c_custkey", F.col("v"))


@query("a21_row_count", "SELECT count(*) AS n FROM lineitem")
def a21(spark, sf):
    return keys.row_count(table(spark, sf, "lineitem"))


@query("a26_key_values", "SELECT r_name AS key, CAST(r_regionkey * 10 AS BIGINT) AS value FROM region WHERE r_regionkey <> 1")
def a26(spark, sf):
    kv = files.KeyValues(spark, fresh(spark, "values"))
    for r in table(spark, sf, "region").collect():  # five rows
        kv.set(r["r_name"], r["r_regionkey"])
        kv.set(r["r_name"], kv.get(r["r_name"], 0) * 10)
        if r["r_regionkey"] == 1:
            kv.delete(r["r_name"])
    return spark.createDataFrame(kv.items(), "key string, value long")


@query("b07_prefix", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def b07(spark, sf):
    return keys.with_prefix(table(spark, sf, "customer"), "c_name", "Customer#00000001").select("c_custkey")


@query("f08_listing", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 10")
def f08(spark, sf):
    return keys.listing(table(spark, sf, "orders"), "o_orderkey", 100, 10).select("o_orderkey", "o_totalprice")


@query("a23_lists_and_dicts", "SELECT n_nationkey, n_regionkey = 1 AS held, CAST(n_nationkey * 2 AS VARCHAR) AS item FROM nation")
def a23b(spark, sf):
    n = table(spark, sf, "nation")
    content = F.to_json(F.struct(F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("x")).alias("tags"), F.struct((F.col("n_nationkey") * 2).alias("twice")).alias("more")))
    parts = documents_source.entity(content)
    return n.select("n_nationkey", documents_source.list_holds(parts["lists"], "tags", "r1").alias("held"), documents_source.dict_item(parts["dicts"], "more", "twice").alias("item"))


@query("a23_json_roundtrip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a23(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    parts = documents_source.entity(F.col("props"))
    again = e.select("event_id", documents_source.as_json(parts["attrs"], parts["lists"], parts["dicts"]).alias("props"))
    return again.select("event_id", documents_source.attribute(documents_source.entity(F.col("props"))["attrs"], "k", "bigint").alias("k"))


@query("a25_order_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id FROM orders")
def a25(spark, sf):
    return keys.order_ids(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("id").cast("long").alias("id"))




# ---- search


@query("b10_index_equal", "SELECT doc_id FROM documents WHERE lang = 'de'")
def b10(spark, sf):
    return search.index(table(spark, sf, "documents"), "doc_id", "lang").filter("value = 'de'").select(F.col("row").alias("doc_id"))


@query("b11_index_range", "SELECT doc_id FROM documents WHERE n_chars >= 500 AND n_chars < 2000")
def b11(spark, sf):
    return keys.key_range(search.index(table(spark, sf, "documents"), "doc_id", "n_chars"), "value", 500, 2000).select(F.col("row").alias("doc_id"))


@query("b13_conjunctive_search", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '\\s+'), ['the', 'of', 'and']) AND n_chars >= 1000 AND n_chars < 5000")
def b13(spark, sf):
    d = table(spark, sf, "documents")
    p = search.postings(d, "doc_id", "text")
    return search.conjunctive(p, ["the", "of", "and"], "doc_id", [search.Scope("n_chars", 1000, 5000)], d)


@query("b13_search_text", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '\\s+'), ['de', 'la'])")
def b13b(spark, sf):
    return search.search(table(spark, sf, "documents"), "doc_id", "text", "de la")


@query("b14_post_filter", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND n_chars >= 3000")
def b14(spark, sf):
    good = search.index(table(spark, sf, "labels"), "doc_id", "quality").filter("value = 1")
    return search.with_posting(table(spark, sf, "documents").filter(F.col("n_chars") >= 3000), good, "doc_id").select("doc_id")


def two_columns(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return search.index(d, "doc_id", "lang").unionByName(search.index(d.withColumn("source", F.col("source").cast("string")), "doc_id", "source"))


@query("a41_index_drop", "SELECT 'source' AS \"column\", source AS value, count(*) AS n FROM documents WHERE source <> '' GROUP BY 2")
def a41(spark, sf):
    return search.dropped(two_columns(spark, sf), "lang").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query("a40_remove_postings", "SELECT \"column\", count(*) AS n FROM (SELECT 'lang' AS \"column\" FROM documents WHERE lang <> '' AND doc_id % 4 <> 0 UNION ALL SELECT 'source' FROM documents WHERE source <> '') GROUP BY 1")
def a40b(spark, sf):
    gone = table(spark, sf, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("row"))
    return search.removed(two_columns(spark, sf), gone, "lang").groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("a40_replace_postings", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS value FROM documents")
def a40(spark, sf):
    d = table(spark, sf, "documents")
    fresh_ = search.index(d.filter("doc_id % 5 = 0").withColumn("lang", F.lit("xx")), "doc_id", "lang")
    return search.replaced(search.index(d, "doc_id", "lang"), fresh_).select(F.col("row").alias("doc_id"), "value")


@query("f05_tfidf_topk", """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY 1),
q AS (SELECT * FROM t WHERE word IN ('the', 'of', 'and')), d AS (SELECT word, count(*) AS df FROM q GROUP BY 1)
SELECT doc_id, round(sum((0.01 + ln((SELECT count(*) FROM documents) / df)) * tf / len), 9) AS score FROM q JOIN d USING (word) JOIN l USING (doc_id) GROUP BY 1 HAVING count(*) = 3 ORDER BY sum((0.01 + ln((SELECT count(*) FROM documents) / df)) * tf / len) DESC, doc_id LIMIT 10""")
def f05(spark, sf):
    d = table(spark, sf, "documents")
    got = search.tfidf(search.postings(d, "doc_id", "text"), ["the", "of", "and"], d.count(), "doc_id", 10)
    return got.select("doc_id", F.round("score", 9).alias("score"))


@query("f06_cosine_topk", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(v, v)), 6) AS sim
FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), v) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(v, v)) DESC, vec_id LIMIT 10""")
def f06(spark, sf):
    e = table(spark, sf, "embeddings")
    got = vectors.nearest(e, "vec_id", "embedding", e.filter("vec_id = 0").first()["embedding"], 10)
    return got.select("vec_id", F.round("sim", 6).alias("sim"))


TAGS_SQL = """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
t AS (SELECT doc_id, word, CAST(count(*) AS DOUBLE) AS weight FROM w WHERE word <> '' GROUP BY 1, 2)"""


def tags(spark, sf) -> DataFrame:
    return search.postings(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "word", F.col("tf").cast("double").alias("weight"))


@query("f06_tag_similarity", TAGS_SQL + """, q AS (SELECT * FROM (VALUES ('the', 2.0), ('of', 1.0)) AS q(word, x))
SELECT doc_id, round(sum(weight * coalesce(x, 0)) / (sqrt(sum(weight * weight)) * sqrt(5.0)), 9) AS sim FROM t LEFT JOIN q USING (word) GROUP BY 1 HAVING sum(weight * coalesce(x, 0)) <> 0 ORDER BY sum(weight * coalesce(x, 0)) / (sqrt(sum(weight * weight)) * sqrt(5.0)) DESC, doc_id LIMIT 10""")
def f06b(spark, sf):
    return vectors.nearest_tags(tags(spark, sf), "doc_id", {"the": 2.0, "of": 1.0}, 10).select("doc_id", F.round("sim", 9).alias("sim"))


@query("f07_top_tags", TAGS_SQL + " SELECT doc_id, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS n FROM t) WHERE n <= 5")
def f07(spark, sf):
    return vectors.top_tags(tags(spark, sf), "doc_id", 5)


@query("h26_unit_tags", TAGS_SQL + " SELECT doc_id, word, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 9) AS weight FROM t")
def h26(spark, sf):
    return vectors.unit_length(tags(spark, sf), "doc_id").select("doc_id", "word", F.round("weight", 9).alias("weight"))


NOW = 1_704_067_200_000


@query("h27_decay", f"SELECT event_id, round(value * pow(0.99, ({NOW} - 1451577600000) / 86400000.0) * 1e12, 3) AS now_value, round(value / pow(0.99, ({NOW} - 1451577600000) / 86400000.0) / 1e12, 6) AS origin_value FROM events")
def h27(spark, sf):
    e, now = table(spark, sf, "events"), F.lit(NOW)
    return e.select("event_id", F.round(scalar.decayed(F.col("value"), now) * 1e12, 3).alias("now_value"), F.round(scalar.undecayed(F.col("value"), now) / 1e12, 6).alias("origin_value"))


@query("h28_tag_learning", TAGS_SQL + f""", o AS (SELECT doc_id, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS n FROM t) WHERE n <= 5),
m AS (SELECT doc_id, word, weight FROM o UNION ALL SELECT doc_id, 'the', 0.1 * 0.5 / pow(0.99, ({NOW} - 1451577600000) / 86400000.0) FROM (SELECT DISTINCT doc_id FROM o)),
s AS (SELECT doc_id, word, sum(weight) AS weight FROM m GROUP BY 1, 2)
SELECT doc_id, word, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS n FROM s) WHERE n <= 4""")
def h28(spark, sf):
    old = vectors.top_tags(tags(spark, sf), "doc_id", 5)
    lesson = old.select("doc_id").distinct().select("doc_id", F.lit("the").alias("word"), F.lit(0.1).alias("weight"))
    return vectors.learned(old, lesson, "doc_id", 0.5, NOW, k=4).select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query("g02_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def g02(spark, sf):
    english = search.index(table(spark, sf, "documents"), "doc_id", "lang").filter("value = 'en'")
    clean = search.index(table(spark, sf, "labels"), "doc_id", "toxic").filter("value = 0")
    return search.intersected([english, clean]).select(F.col("row").alias("doc_id"))


def halves(spark, sf) -> list[DataFrame]:
    """The word bags of the documents with even and with odd ids."""
    d = table(spark, sf, "documents")
    return [search.bag(d.filter(F.col("doc_id") % 2 == k), "doc_id", "text") for k in (0, 1)]


@query("g03_bag_difference", f"SELECT word, CAST(sum(CASE doc_id % 2 WHEN 0 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1 HAVING sum(CASE doc_id % 2 WHEN 0 THEN 1 ELSE -1 END) <> 0")
def g03(spark, sf):
    return search.bag_difference(*halves(spark, sf))


@query("g04_bag_sum", f"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1")
def g04(spark, sf):
    return search.bag_sum(*halves(spark, sf))




# ---- scalar functions


@query("h01_time_levels", "SELECT event_id, " + ", ".join(f"strftime(ts, '{f}') AS \"{n}\"" for n, f in zip(LEVELS, ("%Y", "%m", "%d", "%H", "%M", "%S", "%g"), strict=True)) + " FROM events")
def h01(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in timedim.levels(F.col("ts")).items()])


@query("h02_text_levels", "SELECT event_id, strftime(ts, '%Y') AS y, strftime(ts, '%H') AS h, '000' AS ms FROM events")
def h02(spark, sf):
    got = timedim.text_levels(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", got[LEVELS[0]].alias("y"), got[LEVELS[3]].alias("h"), got[LEVELS[6]].alias("ms"))


@query("h03_time_rebuild", "SELECT strftime(ts, '%Y-%m-%d') || ' 00:00:00.000' AS day, count(*) AS cnt FROM events GROUP BY 1")
def h03(spark, sf):
    b = cube.rollup(cube.base(table(spark, sf, "events"), EVENTS), LEVELS[:3], EVENTS)
    return b.select(timedim.rebuilt({n: F.col(n) for n in LEVELS[:3]}).alias("day"), "cnt")


@query("h07_dates", "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS day, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS before, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders")
def h07(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(scalar.day_start(d), "yyyy-MM-dd HH:mm:ss").alias("day"), F.date_format(scalar.previous_day(d), "yyyy-MM-dd").alias("before"), scalar.month_number(d).alias("month"), scalar.compact_day(d).alias("compact"))


@query("h07_day_ends", "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') || ' 23:59:59.999' AS day_end, strftime(o_orderdate, '%Y%m%d%H') AS hour, strftime(o_orderdate, '%Y-%m-%d') AS again FROM orders")
def h07b(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(scalar.day_end(d), "yyyy-MM-dd HH:mm:ss.SSS").alias("day_end"), scalar.compact_hour(d).alias("hour"), scalar.from_compact(scalar.compact_day(d)).cast("string").alias("again"))


@query("h08_clock", """
SELECT event_id, strftime(ts, '%Y-%m-%d %I:%M:%S') AS clock, strftime(date_trunc('day', ts) - INTERVAL 3 DAY, '%Y-%m-%d %H:%M') AS past, event_id * 1000000 AS nano, event_id AS again,
CASE WHEN event_id % 100 > 0 THEN round(60.0 * (100 - event_id % 100) / (event_id % 100), 6) END AS left_s FROM events""")
def h08(spark, sf):
    ts, k = F.col("ts"), F.col("event_id")
    return table(spark, sf, "events").select("event_id", scalar.clock12(ts).alias("clock"), F.date_format(scalar.past_date(ts, 3), "yyyy-MM-dd HH:mm").alias("past"), scalar.nanos(k).alias("nano"), scalar.millis(scalar.nanos(k)).alias("again"), F.round(scalar.left_time(k % 100, F.lit(100), F.lit(60.0)), 6).alias("left_s"))


@query("h10_minute_floor", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute FROM events")
def h10(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(scalar.minute_floor(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("minute"))


@query("h11_codecs", "SELECT n_nationkey, to_base64(encode(n_name)) AS b64, hex(encode(n_name)) AS hexed, n_name AS again FROM nation")
def h11(spark, sf):
    raw = F.col("n_name").cast("binary")
    return table(spark, sf, "nation").select("n_nationkey", scalar.base64(raw).alias("b64"), scalar.hexed(raw).alias("hexed"), scalar.unbase32(scalar.base32(raw)).cast("string").alias("again"))


@query("h13_normal_space", "SELECT doc_id, md5(regexp_replace(trim(text), '[ \\t]+', ' ', 'g')) AS h FROM documents")
def h13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(scalar.normal_space(F.col("text"))).alias("h"))


@query("h14_checks", "SELECT n_nationkey, regexp_full_match(CAST(n_nationkey AS VARCHAR), '[0-9]*') AS number, regexp_full_match(lower(n_name) || '@x.org', '[\\w.\\-]+@([\\w\\-]+\\.)+[\\w\\-]+') AS email FROM nation")
def h14(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", scalar.is_number(F.col("n_nationkey").cast("string")).alias("number"), scalar.is_email(F.concat(F.lower("n_name"), F.lit("@x.org"))).alias("email"))


@query("h15_loose_int", "SELECT c_custkey, CAST(c_custkey * 1000 AS BIGINT) AS n FROM customer")
def h15(spark, sf):
    k = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey"), F.lit("K"))).otherwise(F.format_number(F.col("c_custkey") * 1000, 0))
    return table(spark, sf, "customer").select("c_custkey", scalar.loose_int(k).alias("n"))


@query("h16_script", """
WITH t AS (SELECT CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN chr(20013) || ' ' || chr(25991) ELSE text || chr(20013) END AS t, lang FROM documents)
SELECT lang, CASE WHEN t = '' THEN 'mixed' WHEN strpos(t, chr(20013)) = 0 THEN 'english' WHEN t = chr(20013) || ' ' || chr(25991) OR t = chr(20013) THEN 'chinese' ELSE 'mixed' END AS script, count(*) AS n FROM t GROUP BY 1, 2""")
def h16(spark, sf):
    k, text = F.col("doc_id") % 4, F.col("text")
    t = F.when(k == 0, "").when(k == 1, text).when(k == 2, "\u4e2d \u6587").otherwise(F.concat(text, F.lit("\u4e2d")))
    return table(spark, sf, "documents").groupBy("lang", scalar.script_of(t).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("h17_words", "SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS INTEGER) AS n FROM documents")
def h17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(scalar.words(F.col("text"))).alias("n"))


@query("h18_search_tag", """
SELECT p_partkey, 'destination:' || lower(p_brand) || '|language:en' || array_to_string(list_transform(list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''))), lambda w: '|word:' || w), '') AS tag FROM part""")
def h18(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.search_tag(F.col("p_brand"), F.col("p_name")).alias("tag"))


@query("h19_url_host", "SELECT regexp_extract(lower(url), '://([^/?#]*)', 1) AS host, count(*) AS cnt FROM pages GROUP BY 1")
def h19(spark, sf):
    return table(spark, sf, "pages").groupBy(scalar.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("cnt"))


@query("h20_nth_index", "SELECT page_id, CAST(instr(url, '/') - 1 AS INTEGER) AS first, CAST(instr(url, '/') AS INTEGER) AS second FROM pages")
def h20(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", scalar.nth_index(u, "/", 1).alias("first"), scalar.nth_index(u, "/", 2).alias("second"))


@query("h22_bit_reversal", "SELECT c_custkey, c_custkey AS again FROM customer")
def h22(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalar.order_of_discrete(scalar.discrete_id(F.col("c_custkey"))).alias("again"))


@query("h24_vectors", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS d, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS n FROM embeddings")
def h24(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalar.dot(v, v), 6).alias("d"), F.round(scalar.norm(v), 6).alias("n"))


@query("h24_toward", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x + (1 - x) * 0.25, 9))[1:3] AS v FROM embeddings")
def h24b(spark, sf):
    v = F.col("embedding").cast("array<double>")
    moved = scalar.toward(v, F.array_repeat(F.lit(1.0), F.size(v)), 0.25)
    return table(spark, sf, "embeddings").select("vec_id", F.slice(F.transform(moved, lambda x: F.round(x, 9)), 1, 3).alias("v"))


@query("h25_sparse_cosine", "SELECT event_id, CASE WHEN value = 0 THEN 0.0 ELSE round(value / (sqrt(value * value + 1) * sqrt(5)), 9) END AS sim FROM events")
def h25(spark, sf):
    a, b = F.create_map(F.lit("x"), F.col("value"), F.lit("y"), F.lit(1.0)), F.create_map(F.lit("x"), F.lit(1.0), F.lit("z"), F.lit(2.0))
    return table(spark, sf, "events").select("event_id", F.round(scalar.sparse_cosine(a, b), 9).alias("sim"))


@query("h29_latent", "SELECT c_custkey, 8 AS terms, true AS in_range, 1.5 AS grown FROM customer")
def h29(spark, sf):
    v = vectors.latent(F.col("c_custkey"), 8)
    grown = vectors.with_term(v, F.lit(3), F.lit(1.5))
    return table(spark, sf, "customer").select("c_custkey", F.size(v).alias("terms"), F.forall(v, lambda x: (x >= 0) & (x < 1)).alias("in_range"), F.round(F.aggregate(F.zip_with(grown, v, lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x), 9).alias("grown"))


@query("h30_rank_order", "SELECT c_custkey, row_number() OVER (ORDER BY strlen(c_mktsegment), c_mktsegment, c_custkey) AS place FROM customer")
def h30(spark, sf):
    n = table(spark, sf, "customer").withColumn("k", scalar.rank_key(F.col("c_mktsegment")))
    return keys.order_ids(n, ["k", "c_custkey"], "place").select("c_custkey", F.col("place").cast("long").alias("place"))


@query("h31_values", """
WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)
SELECT event_id, v IS NULL OR v = '' AS empty, coalesce(TRY_CAST(v AS BIGINT), 0) AS n, v IS NOT DISTINCT FROM CAST(event_id AS VARCHAR) AS same FROM v""")
def h31(spark, sf):
    k = F.col("event_id")
    v = F.when(k % 3 == 1, "").when(k % 3 == 2, k.cast("string"))
    return table(spark, sf, "events").select("event_id", scalar.is_empty(v, "string").alias("empty"), scalar.as_kind(v, "long").alias("n"), scalar.same_value(v, k.cast("string")).alias("same"))


@query("h32_increment", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value + 2.5 END AS more, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value - 1 END AS less FROM events")
def h32(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", scalar.incremented(v, 2.5).alias("more"), scalar.incremented(v, -1.0).alias("less"))


#: Text that each SQL type reads, as what it is shown, in the order of sql.TYPES.
CAST_SAMPLES = {
    "CHAR": ("null", "null"), "VARCHAR": ("a", "a"), "NUMERIC": ("1.5", "1.5000000000"), "DECIMAL": ("2.25", "2.2500000000"), "BIT": ("true", "true"), "BOOLEAN": ("false", "false"), "TINYINT": ("7", "7"), "SMALLINT": ("700", "700"),
    "INTEGER": ("70000", "70000"), "BIGINT": ("7000000000", "7000000000"), "REAL": ("0.5", "0.5"), "FLOAT": ("0.25", "0.25"), "DOUBLE": ("0.125", "0.125"), "BINARY": ("ab", "ab"), "VARBINARY": ("cd", "cd"),
    "DATE": ("2024-01-02", "2024-01-02"), "TIME": ("10:11:12", "10:11:12"), "TIMESTAMP": ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
}


@query("h35_all_types", "SELECT t.type, t.shown, count(*) AS n, count(*) FILTER (t.type NOT IN ('CHAR', 'VARCHAR')) AS nulls FROM region, (VALUES " + ", ".join(f"('{k}', '{v[1]}')" for k, v in CAST_SAMPLES.items()) + ") AS t(type, shown) GROUP BY 1, 2")
def h35b(spark, sf):
    out = None
    for kind, (text, _) in CAST_SAMPLES.items():
        one = table(spark, sf, "region").select(F.lit(kind).alias("type"), sqlapi.cast_to(F.lit(text), kind).cast("string").alias("shown"), sqlapi.cast_to(F.lit("null"), kind).isNull().alias("none"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("type", "shown").agg(F.count(F.lit(1)).alias("n"), F.count_if("none").alias("nulls"))


@query("a32_metadata", "SELECT table_name AS \"table\", column_name AS \"column\", ordinal_position AS position FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
def a32(spark, sf):
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(name)
    got = sqlapi.connect(spark, "cube://here/sales").metadata()
    return got.filter(F.col("table").isin("nation", "region")).select("table", "column", "position")


@query("j03_cursor", "SELECT l_returnflag, count(*) AS cnt FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def j03(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_rows")
    c = sqlapi.connect(spark, "cube://here/sales").cursor().execute("SELECT l_returnflag, count(*) AS cnt FROM lineitem_rows WHERE l_quantity > ? GROUP BY 1", [10])
    return spark.createDataFrame(c.fetchall(), "l_returnflag string, cnt long")


@query("j06_result_metadata", "SELECT column_name AS name, data_type AS type, ordinal_position AS position FROM information_schema.columns WHERE table_name = 'orders' AND column_name IN ('o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate')")
def j06(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_rows")
    c = sqlapi.connect(spark, "cube://here/sales?max_rows=5").cursor().execute("SELECT * FROM orders_rows")
    rows = [(d.name, d.type, d.position) for d in c.description if d.name in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")]
    return spark.createDataFrame(rows, "name string, type string, position int")


@query("f02_entity_first", "SELECT * FROM (VALUES ('l_linestatus', 1), ('OLAP_YEAR', 2), ('OLAP_MONTH', 3), ('l_returnflag', 4), ('a_flag', 5)) AS t(dim, place)")
def f02(spark, sf):
    # A rule of planning: it reads no rows.
    dims = LINEITEM.order(["a_flag", "l_returnflag", "OLAP_MONTH", "OLAP_YEAR", "l_linestatus"], first="l_linestatus")
    return spark.createDataFrame([(d, k + 1) for k, d in enumerate(dims)], "dim string, place int")


@query("h06_time_in_groups", "SELECT * FROM (VALUES " + ", ".join(f"('{x}', {k})" for k, x in enumerate(("event_type", *LEVELS), 1)) + ") AS t(dim, place)")
def h06(spark, sf):
    dims = timeplan.replace_time(EVENTS.dimensions, EVENTS.time)
    return spark.createDataFrame([(d, k + 1) for k, d in enumerate(dims)], "dim string, place int")


@query("h37_levels", "SELECT * FROM (VALUES (1, 0), (499999, 0), (2499999, 0), (2500001, 1), (12500001, 2), (62500001, 3)) AS t(n, level)".replace("SELECT *", "SELECT CAST(n AS BIGINT) AS n, level"))
def h37(spark, sf):
    n = spark.createDataFrame([(x,) for x in (1, 499_999, 2_499_999, 2_500_001, 12_500_001, 62_500_001)], "n long")
    return n.select("n", scalar.segment_level(F.col("n")).alias("level"))
