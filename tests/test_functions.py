import base64
import math

from pyspark.sql import functions as F

from lattika.functions import scalar, timedim
from lattika.operators import keys, search, vectors
from lattika.plans.spec import LEVELS
from lattika.sources import documents
from lattika.sql import cast_to, like_regex


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_time_texts(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.179",), ("2024-01-05 10:00:00",), ("2024-01-05",), ("",), (None,), ("xx",)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in timedim.text_levels(F.col("t")).items()]).collect()]
    assert got[0] == ("2024", "01", "01", "00", "00", "07", "179")
    assert got[1][:4] == ("2024", "01", "05", "10") and got[2] == ("2024", "01", "05", "00", "00", "00", "000")
    assert got[3] == got[4] == ("0000", "00", "00", "00", "00", "00", "000")
    assert got[5] == (None,) * 7
    back = timedim.rebuilt({LEVELS[0]: F.lit("2024"), LEVELS[1]: F.lit("01"), LEVELS[2]: F.lit("01")})
    assert one(spark, back) == "2024-01-01 00:00:00.000"


def test_small_functions(spark):
    assert [one(spark, scalar.loose_int(F.lit(x).cast("string"))) for x in ("1,234", "1.5k", None, "x")] == [1234, 1500, 0, None]
    assert [one(spark, scalar.script_of(F.lit(x))) for x in ("abc", "中 文", "a中", "")] == ["english", "chinese", "mixed", "mixed"]
    assert [one(spark, scalar.nth_index(F.lit("a.b.c"), ".", n)) for n in (1, 2, 3)] == [1, 3, -1]
    assert [one(spark, scalar.discrete_id(F.lit(n))) for n in (1, 2, 3)] == [4611686018427387904, 2305843009213693952, 6917529027641081856]
    assert one(spark, scalar.order_of_discrete(F.lit(6917529027641081856))) == 3
    for raw in (b"", b"f", b"fo", b"foo", b"foob", b"\x00\xff\x10\x80", b"hello world"):
        assert one(spark, scalar.base32(F.lit(bytearray(raw)))) == base64.b32encode(raw).decode()
    assert one(spark, scalar.data_url_type(F.lit("data:image/png;base64,QUJD"))) == ".png"
    assert bytes(one(spark, scalar.data_url_bytes(F.lit("data:image/png;base64,QUJD")))) == b"ABC"
    assert one(spark, scalar.search_tag(F.lit("Rome"), F.lit("b A"))) == "destination:rome|language:en|word:a|word:b"
    df = spark.createDataFrame([(x,) for x in ("b", "aa", "a", "ab", "c")], "s string")
    assert [r["s"] for r in df.orderBy(scalar.rank_key(F.col("s"))).collect()] == ["a", "b", "c", "aa", "ab"]


def test_vectors(spark):
    a, b = F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(2.0)), F.create_map(F.lit("x"), F.lit(3.0), F.lit("z"), F.lit(4.0))
    assert math.isclose(one(spark, scalar.sparse_cosine(a, b)), 0.2683281573, abs_tol=1e-9)
    assert one(spark, scalar.map_sum(a, b)) == {"x": 4.0, "y": 2.0, "z": 4.0}
    assert math.isclose(one(spark, scalar.decayed(F.lit(2.0), F.lit(scalar.DECAY_ORIGIN_MS + 10 * 86_400_000))), 1.80876415, abs_tol=1e-8)
    assert math.isclose(one(spark, scalar.undecayed(F.lit(2.0), F.lit(scalar.DECAY_ORIGIN_MS + 10 * 86_400_000))), 2.2114547106, abs_tol=1e-8)
    assert one(spark, scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    tags = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 5.0)], "id long, word string, weight double")
    assert sorted(r["word"] for r in vectors.top_tags(tags, "id", 2).collect()) == ["a", "c"]


def test_tfidf_vector(spark):
    posts = spark.createDataFrame([("p", 1, 3, 10), ("p", 2, 1, 10), ("q", 1, 2, 10), ("q", 2, 1, 10), ("q", 3, 1, 10), ("q", 4, 1, 10)], "word string, id long, tf long, length long")
    got = search.tfidf(posts, ["p", "q"], 4, "id", 5).collect()
    assert got[0]["id"] == 1 and math.isclose(got[0]["score"], 0.2129441542, abs_tol=1e-9)
    assert search.conjunctive(posts, [], "id").count() == 0 and search.conjunctive(posts, ["p", "none"], "id").count() == 0


def test_documents_and_casts(spark):
    text = '{"a": 1, "b": [1, [2], "x"], "c": {"k": "v", "n": {}}, "d": null}'
    e = documents.entity(F.lit(text))
    assert one(spark, e["attrs"]) == {"a": "1"}
    assert one(spark, e["lists"]) == {"b": ["1", "x"]}
    assert one(spark, e["dicts"]) == {"c": {"k": "v"}}
    assert one(spark, documents.attribute(e["attrs"], "zz", "int", 5)) == 5
    assert one(spark, cast_to(F.lit("null"), "BIGINT")) is None and one(spark, cast_to(F.lit("null"), "VARCHAR")) == "null"
    import re

    assert re.match(like_regex("a_%\\%"), "a_xyz%") and not re.match(like_regex("a_"), "ab")


def test_order_ids_are_consecutive(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = keys.order_ids(df, ["k"], "n").orderBy("k").select("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
