import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lattika.engine import CubeEngine, EmptyBatch, Query
from lattika.operators import cube, keys, states
from lattika.plans.spec import CubeSpec
from lattika.scratch import fresh
from lattika.sources import facts as fact_streams

SPEC = CubeSpec.parse("s.t", "k:string|c:string", "m:double,u.distinct:long")


def facts(spark, rows):
    return spark.createDataFrame(rows, "k string, c string, m double, u long, OLAP_OPERATION string")


def test_retraction_vectors(spark):
    rows = [("a", "x", 5.0, 1, "ADD"), ("a", "x", 3.0, 2, None), ("a", "x", 5.0, 3, "REMOVE"), ("b", "x", 5.0, 1, "ADD"), ("b", "x", 5.0, 1, "REMOVE"), ("c", "x", 5.0, 1, "ADD"), ("c", "x", 3.0, 1, "REMOVE")]
    got = cube.base(facts(spark, rows), SPEC).filter(states.valid(SPEC)).select("k", *states.finished(SPEC)).collect()
    by = {r["k"]: r for r in got}
    assert set(by) == {"a", "c"}
    assert (by["a"]["cnt"], by["a"]["m_sum"], by["a"]["m_min"], by["a"]["m_max"], by["a"]["u_distinct"]) == (1, 3.0, 3.0, 5.0, 3)
    assert (by["c"]["cnt"], by["c"]["m_sum"]) == (0, 2.0)


def test_dirty_values_and_nulls(spark):
    df = spark.createDataFrame([("a", None, "7", None), (None, None, "bad", "z"), (None, None, None, None)], "k string, c string, m string, u string")
    got = {r["k"]: r for r in cube.base(df, SPEC).select("k", "cnt", "m_sum", "m_min", F.hll_sketch_estimate("u_hll").alias("u")).collect()}
    assert got["a"]["m_sum"] == 7.0 and got["a"]["u"] == 1
    assert got[None]["cnt"] == 2 and got[None]["m_min"] == 0.0 and got[None]["u"] == 2


@pytest.fixture(scope="module")
def engine(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    for k in range(5):
        e.ingest(SPEC, facts(spark, [(f"k{i % 3}", f"c{i % 2}", float(i), i, "ADD") for i in range(k * 20, k * 20 + 20)]), batch=f"b{k}")
    return e


def answer(e):
    return sorted(map(tuple, e.query(SPEC, Query(("k",))).collect()))


def test_engine_life(spark, engine):
    before = answer(engine)
    assert sum(r[1] for r in before) == 100
    engine.ingest(SPEC, facts(spark, [("k0", "c0", 1.0, 1, "ADD")]), batch="b0")  # a replay changes nothing
    assert answer(engine) == before
    assert engine.route(SPEC, ("k",)).dims == ("k",)
    assert engine.compact(SPEC) is not None
    assert [(r[0], r[1], round(r[4], 6)) for r in answer(engine)] == [(r[0], r[1], round(r[4], 6)) for r in before]
    assert engine.segments(SPEC).filter("phase = 'PRODUCTIVE'").count() == 1
    assert engine.purge(SPEC) == 5
    assert [r[1] for r in answer(engine)] == [r[1] for r in before]
    assert engine.audit(SPEC).count() == 0
    one = engine.query(SPEC, Query(("k", "c"), (("c", "=", "c1"),), ("-cnt", "k"), 2)).collect()
    assert len(one) == 2 and all(r["c"] == "c1" for r in one)
    plan = engine._read(SPEC, engine.route(SPEC, ("k", "c")), [6]).filter("segment = 6")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_disabled_cubes_refuse(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    with pytest.raises(ValueError, match="disable"):
        e.destroy(SPEC)
    e.enable(SPEC, False)
    with pytest.raises(ValueError, match="disabled"):
        e.ingest(SPEC, facts(spark, []))
    e.destroy(SPEC)
    with pytest.raises(KeyError):
        e.cuboids(SPEC)


def test_empty_segment_and_query_without_segments(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    assert e.query(SPEC, Query(("k",))).count() == 0
    with pytest.raises(EmptyBatch):
        e.ingest(SPEC, facts(spark, []))
    with pytest.raises(EmptyBatch):
        e.ingest(SPEC, facts(spark, [("k", "c", 1.0, 1, "ADD"), ("k", "c", 1.0, 1, "REMOVE")]))
    assert e.ingest(SPEC, facts(spark, []), empty="skip") is None
    assert e.query(SPEC, Query(("k",))).count() == 0 and e.segments(SPEC).count() == 0


def test_two_writers_both_count(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    one, two = CubeEngine(spark, e.root), CubeEngine(spark, e.root)
    stale = one._load(SPEC.name)
    assert two.ingest(SPEC, facts(spark, [("a", "c", 1.0, 1, "ADD")])) == 1
    # The first writer's view is old: its manifest isn't taken, its change is applied to the new one.
    assert not one._save(SPEC.name, *stale)
    assert one.ingest(SPEC, facts(spark, [("b", "c", 2.0, 1, "ADD")])) == 2
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: CubeEngine(spark, e.root).ingest(SPEC, facts(spark, [(f"t{k}", "c", 1.0, 1, "ADD")]), batch=f"b{k % 2}"), range(3)))
    got = {r["k"]: r["cnt"] for r in e.query(SPEC, Query(("k",))).collect()}
    assert {"a", "b"} <= set(got) and len(got) == 4 and set(got.values()) == {1}
    assert sorted(r["segment_id"] for r in e.segments(SPEC).collect())[:2] == [1, 2] and e.audit(SPEC).count() == 0


def test_bad_facts(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    rows = spark.createDataFrame([('{"k": "a", "v": 1}',), ("not json",), ("[1]",), (None,)], "content string")
    with pytest.raises(Exception, match="not a JSON fact"):
        e.ingest(SPEC, rows, json_facts=True)
    assert e.segments(SPEC).count() == 0
    e.ingest(SPEC, rows, json_facts=True, bad="skip")
    assert [(r["k"], r["cnt"]) for r in e.query(SPEC, Query(("k",))).collect()] == [("a", 1)]
    e.ingest(SPEC, rows, json_facts=True, bad="null")
    assert {r["k"]: r["cnt"] for r in e.query(SPEC, Query(("k",))).collect()} == {"a": 2, None: 3}
    assert fact_streams.set_aside(rows).count() == 3


def test_check_of_segments(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    e.ingest(SPEC, facts(spark, [("a", "c", 1.0, 1, "ADD")]))
    assert e.scan(SPEC, ("k",), [1], check=True).count() == 1
    with pytest.raises(ValueError, match="aren't live"):
        e.scan(SPEC, ("k",), [1, 2], check=True)
    assert e.operate("info", SPEC).count() == 1 and not e.running("none")
    with pytest.raises(KeyError):
        e.operate("dance", SPEC)


def test_order_ids_are_exact_on_millions_of_rows(spark):
    df = spark.range(3_000_000).select((F.xxhash64("id") % 1_000_000).alias("v"), F.repeat(F.col("id").cast("string"), 3).alias("payload"), "id").repartition(13)
    got = keys.order_ids(df, ["v", "id"], "n")
    n, distinct, lo, hi = got.agg(F.count(F.lit(1)), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert (n, distinct, lo, hi) == (3_000_000, 3_000_000, 1, 3_000_000)
    # In the order asked for: the values of every thousandth id rise.
    some = [r["v"] for r in got.filter("n % 1000 = 0").orderBy("n").collect()]
    assert some == sorted(some)


def test_staged_equals_grouping_sets(spark, sf):
    from lattika.queries import QUERIES

    a, b = (sorted(map(str, QUERIES[n](spark, sf).collect())) for n in ("d11_cube_staged", "d11_cube_grouping_sets"))
    assert a == b


def test_what_was_added_and_removed_cancels_in_any_order(spark):
    big = [1e16, 1.0, 0.1, 3e30, -7.7e-9, 123456.78, 1e11]
    rows = [("a", "x", v, 1, op) for op in ("ADD", "REMOVE") for v in big] + [("b", "x", v, 1, "ADD") for v in big] + [("b", "x", v, 1, "REMOVE") for v in big[:4]]
    rows += [("c", "x", 1e16, 1, "ADD"), ("c", "x", 2.0, 1, "ADD"), ("c", "x", 1e16, 1, "REMOVE"), ("c", "x", 1.0, 1, "REMOVE")]
    for parts in (1, 5):
        base = cube.base(facts(spark, rows).repartition(parts), SPEC)
        got = {r["k"]: r for r in cube.rollup(base, ["k"], SPEC).filter(states.valid(SPEC)).collect()}
        assert set(got) == {"b", "c"}
        assert (got["b"]["cnt"], got["b"]["m_sum"]) == (3, math.fsum(big[4:]))
        assert (got["c"]["cnt"], got["c"]["m_sum"]) == (0, 1.0)
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    # The facts of one segment are removed by another one, in another order.
    e.ingest(SPEC, facts(spark, [("a", "x", v, 1, "ADD") for v in big]))
    e.ingest(SPEC, facts(spark, [("a", "x", v, 1, "REMOVE") for v in reversed(big)]))
    assert e.query(SPEC, Query(("k",))).count() == 0 and e.query(SPEC, Query(())).count() == 0
    e.compact(SPEC, [1, 2])
    assert e.query(SPEC, Query(("k",))).count() == 0 and e.view(SPEC).count() == 0


def test_sums_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    groups = {"a": [0.1] * 10, "b": [2.0**127, 2.0**-60, -(2.0**127)], "c": [inf, 1.0], "d": [inf, -inf], "e": [nan, 1.0], "f": [1e300, 2.5e300], "g": [-0.1, -2.0**40 - 0.5, 2.0**80], "h": [5e-324, 1e-300], "i": [None, 2.0], "j": [2.0**27, 2.0**99, -(2.0**71)]}
    rows = [(k, "x", v, 1, "ADD") for k, vs in groups.items() for v in vs]
    got = {r["k"]: r["m_sum"] for r in cube.rollup(cube.base(facts(spark, rows).repartition(3), SPEC), ["k"], SPEC).collect()}
    assert got.pop("c") == inf and math.isnan(got.pop("d")) and math.isnan(got.pop("e"))
    assert got == {k: pytest.approx(math.fsum(v or 0.0 for v in groups[k]), rel=2e-16, abs=0) for k in got}


def test_segments_without_digits_still_count(spark):
    e = CubeEngine(spark, fresh(spark, "test"))
    e.create(SPEC)
    for op in ("ADD", "ADD", "REMOVE"):
        e.ingest(SPEC, facts(spark, [("a", "x", 0.1, 1, op), ("b", "x", 7.0, 1, op)]))
    for cuboid, _ in enumerate(SPEC.lattice(), 1):
        path = f"{e.root}/{SPEC.name}/cuboid={cuboid}/segment=1"
        old = [r.asDict() for r in spark.read.parquet(path).drop(*states.sum_columns("m")).collect()]
        spark.createDataFrame(old, spark.read.parquet(path).drop(*states.sum_columns("m")).schema).write.mode("overwrite").parquet(path)
    assert [(r["k"], r["cnt"], r["m_sum"]) for r in e.query(SPEC, Query(("k",), order=("k",))).collect()] == [("a", 1, 0.1), ("b", 1, 7.0)]


def test_sketch_order_is_exact_where_estimates_are_near(spark, tmp_path):
    import duckdb

    from lattika.queries import ORACLE_SQL, QUERIES

    counts = {"a": 20000, "b": 20003, "c": 20001, "d": 20002, "e": 20000, "f": 900, "g": 901, None: 20000, "h": 70, "i": 2, "k": 1}
    rows = spark.createDataFrame([(t, n) for t, n in counts.items()], "event_type string, n long")
    rows = rows.select("event_type", F.explode(F.sequence(F.lit(1), "n")).alias("user_id")).withColumn("user_id", F.col("user_id") * 7919 + F.pmod(F.hash("event_type"), F.lit(5)))
    # Users that are missing: beside two others, and alone.
    rows = rows.union(spark.createDataFrame([("i", None), ("l", None), ("k", None), ("k", 1), ("h", None)], rows.schema))
    rows.withColumn("value", F.lit(1.0)).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = {r["event_type"]: r["place"] for r in QUERIES["d24_sketch_order"](spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got == dict(c.sql(ORACLE_SQL["d24_sketch_order"]).fetchall())


def test_distinct_order_of_several_dimensions(spark):
    sizes = {("a", "x"): 3000, ("a", None): 3001, (None, "x"): 3000, (None, None): 3000, ("b", "y"): 40000, ("c", "y"): 12}
    rows = [(k, c, 1.0, u, "ADD") for (k, c), n in sizes.items() for u in range(n)]
    cells = cube.base(facts(spark, rows), SPEC)
    # Cells that stand alone need no facts: their sketches decide.
    near = facts(spark, [r for r in rows if r[0] not in ("b", "c")])
    got = [(r["k"], r["c"]) for r in cube.distinct_order(cells, near, ["k", "c"], "u").orderBy("place").collect()]
    assert got == [("b", "y"), ("a", None), ("a", "x"), (None, "x"), (None, None), ("c", "y")]
    assert cube.distinct_order(cells.limit(0), near, ["k", "c"], "u").count() == 0
