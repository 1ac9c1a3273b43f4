from pyspark.sql import functions as F

from lattika.engine import CubeEngine, Query
from lattika.plans.spec import CubeSpec
from lattika.scratch import fresh
from lattika.sources import facts, files
from lattika.streaming.ingest import file_stream, into_cube, sessions

SPEC = CubeSpec.parse("web.types", "event_type:string", "value:double")


def test_restart_counts_once(spark, sf):
    root = fresh(spark, "stream")
    engine = CubeEngine(spark, f"{root}/cubes")
    engine.create(SPEC)
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    events.limit(100).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        into_cube(engine, SPEC, file_stream(spark, f"{root}/in", events.schema, files_per_batch=1), f"{root}/checkpoint").awaitTermination()
        return sum(r["cnt"] for r in engine.query(SPEC, Query(("event_type",))).collect())

    assert run() == 100
    assert run() == 100
    events.limit(50).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert run() == 150
    # The same batch again, as after a crash between the manifest and the checkpoint.
    engine.ingest(SPEC, events.limit(50), batch="stream-1")
    assert sum(r["cnt"] for r in engine.query(SPEC, Query(("event_type",))).collect()) == 150


def test_fact_streams(spark):
    root = fresh(spark, "facts")
    df = spark.createDataFrame([('{"event_type": "a", "value": "2"}', 10), ("not json", 20), ('{"event_type": "b"}', 30)], "content string, at int")
    facts.append(df, root, "f", F.timestamp_seconds("at"))
    got = facts.scan(spark, root, "f", "1970-01-01 00:00:10", "1970-01-01 00:00:30")
    assert got.count() == 2
    parsed = {r["event_type"]: r["value"] for r in facts.from_json(got, SPEC).collect()}
    assert parsed == {"a": "2", None: None}
    facts.compact(spark, root, "f", 1)
    assert facts.scan(spark, root, "f").count() == 3
    assert facts.delete(spark, root, "f") and facts.scan(spark, root, "f").count() == 0


def test_replace_text_is_whole(spark):
    path = f"{fresh(spark, 'files')}/a.json"
    for text in ("one", "zwei ü", ""):
        files.replace_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert files.listing(spark, path.rsplit("/", 1)[0])[-1] == "a.json"


def test_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 01:00:00")], "u long, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["cnt"] for r in sessions(df, "t", "u", "10 minutes", "1 hour").collect()) == [1, 2]
