from pyspark.sql import functions as F

import corpus_pipeline
from lattika.llm import lshforest, toxicity
from lattika.llm.common import Scratch, read_table
from lattika.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    scratch, sizes = Scratch(spark, "t"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = scratch.cut(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        sizes.append(docs.count())
        if name == "toxicity":
            predicted = toxicity.judged(before, read_table(spark, sf, "labels")).filter("predicted = 0").count()
            assert sizes[-1] == predicted
        if name == "near_dedup":
            assert sizes[-1] == lshforest.classes(before, percent=corpus_pipeline.NEAR_PERCENT).filter("kept").count()
        if name == "mixing":
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(r["doc_id"] for r in before.select("doc_id").collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    held = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert held.count() == sizes[-1] and held.filter("n <> t").count() == 0


def test_run_and_registry(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_chat_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = c.sql(ORACLE_SQL["op10_chat_snapshots"])
    df = QUERIES["op10_chat_snapshots"](spark, sf)
    assert sorted(map(str, (tuple(r) for r in df.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_packing_follows_the_slots_whatever_the_files(spark, tmp_path):
    from lattika.llm import mixing

    rows = [(k, f"text number {k} " * 400, f"src{k % 9}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = {r["doc_id"]: r["position"] for r in mixing.schedule(docs).collect()}
    # Files of uneven sizes in any order, as a later read may deal them.
    docs.repartition(3, "source").sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{tmp_path}/d")
    pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/d"), "").select("doc_id", (F.col("sequence_id") / (1 << 33)).cast("long").alias("part")).collect()
    spans = {}
    for r in pieces:
        spans.setdefault(r["part"], []).append(place[r["doc_id"]])
    ordered = [spans[k] for k in sorted(spans)]
    assert len(ordered) > 1 and all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
