import random
from collections import defaultdict

import numpy as np
import pytest

from lattika.llm import embeddings, lshforest
from lattika.llm.common import Scratch
from lattika.llm.components import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_sets(rows):
    import re

    out = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def smallest(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    hot = [rng.choice(words) for _ in range(120)]
    for _ in range(200):
        copy = list(hot)
        copy[rng.randrange(len(copy))] = rng.choice(words)
        if rng.random() < 0.3:
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((k, " ".join(copy)))
        k += 1
    rows += [(k, None), (k + 1, " \t\n"), (k + 2, "Two words"), (k + 3, "two\x0bWORDS"), (k + 4, "é É x y z"), (k + 5, rows[0][1].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2, 512])
def test_classes_equal_brute_force(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, digest string, sig int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in lshforest.classes(docs, block=block).collect()}
    sets = brute_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(ids, links)
    assert {k: v[0] for k, v in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: v[1] for k, v in got.items()} == want
    assert all(v[2] == (k == v[1]) for k, v in got.items())
    kept = lshforest.deduplicated(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k in want if want[k] == k)
    assert kept.columns == docs.columns


def test_odd_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (3, text), (4, None)], "doc_id long, text string")
    got = sorted(map(str, lshforest.classes(docs).collect()))
    assert len(got) == 5 and sum("component_id=1" in x for x in got) == 3 and sum("doc_id=None" in x and "kept=True" in x for x in got) == 1
    assert lshforest.classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alone", [0, 100_000])
def test_components_of_hard_graphs(spark, alone):
    rng = random.Random(5)
    path = list(range(400))
    rng.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(1000, x) for x in range(1001, 1300)] + [(2000 + i, 2000 + (i * 7 + 1) % 50) for i in range(50)] + [(3, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t"), alone=alone).collect()}
    nodes = {x for e in links for x in e}
    assert got == smallest(nodes, links)
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize(("tile", "room"), [(16, 1), (16, 1 << 14), (1024, 1 << 22)])
def test_vectors_equal_brute_force(spark, tile, room):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        v = rng.normal(size=24) if k % 3 else rows[rng.integers(0, k)][1] if k else rng.normal(size=24)
        v = np.asarray(v) + (rng.normal(size=24) * 0.12 if k % 2 else 0)
        rows.append((k, np.float32(v).tolist(), int(k % 2 == 0 or k % 5 == 0)))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, rows[4][1], None), (304, [None] + [1.0] * 23, 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [], 1), (308, [float("inf")] * 24, 1), (309, [5 * x for x in rows[4][1]], rows[4][2])]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, key string, n int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.classes(df, tile=tile, room=room).collect()}
    links, n = [], defaultdict(int)
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[i + 1 :]:
            if p == q and len(x) == len(y):
                u, v = np.float64(np.float32(x)), np.float64(np.float32(y))
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    want = smallest([r[0] for r in rows], links)
    assert {k: v[1] for k, v in got.items()} == want
    assert {k: v[0] for k, v in got.items()} == {r[0]: n[r[0]] for r in rows}
    assert len(links) > 30
    assert embeddings.classes(df.limit(0)).count() == 0


def test_threshold_80_finds_what_85_leaves(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for k in range(150):
        # 204 words have 200 shingles; four lone changes cost 20 of each side: 180 / 220 = 0.818.
        base = [f"d{k}w{i}" for i in range(204)]
        copy = list(base)
        for at in (20, 60, 100, 150):
            copy[at + rng.randrange(20)] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert lshforest.deduplicated(docs).count() == 300
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == list(range(0, 300, 2))
    assert lshforest.shape(85) == (16, 4, 40) and lshforest.shape(80) == (17, 3, 35)


def test_vectors_without_id_join_but_name_nothing(spark):
    rows = [(5, "a", [1.0, 0.0]), (None, "a", [1.0, 0.01]), (None, "b", [1.0, 0.0]), (None, "b", [1.0, 0.02]), (9, "c", [1.0, 0.0]), (None, "c", [1.0, 0.35]), (7, "c", [1.0, 0.75])]
    got = sorted(map(tuple, embeddings.classes(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()), key=str)
    named = {r[0]: r[1:] for r in got if r[0] is not None}
    assert named == {5: (1, 5, True), 9: (1, 7, False), 7: (1, 7, True)}  # 9 and 7 are joined by the vector without an id
    assert [r for r in got if r[0] is None] == [(None, 1, None, True)] * 3 + [(None, 2, None, True)]


def test_large_families_that_fall_apart(spark):
    # Versions of one text: neighbours in a chain link, others are candidates only; some chains are cut.
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(300)]
    for k in range(60):
        if k % 20 == 0:
            base = base[:240] + [f"v{k}-{i}" for i in range(60)]
        base = list(base)
        base[rng.randrange(240)] = f"x{k}"
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = brute_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(sorted(sets), links)
    for block in (3, 8, 512):
        assert {r["doc_id"]: r["component_id"] for r in lshforest.classes(docs, block=block).collect()} == want
    assert 1 < len(set(want.values())) < 60


def test_one_very_long_text(spark):
    long = " ".join(f"w{k % 50_021}" for k in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of six words here")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in lshforest.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_sql_of_duplicates(spark, sf):
    import duckdb

    from lattika.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op3_lsh_forest", "op6_pca_tiles"):
        rel = c.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, QUERIES[name](spark, sf).select(*rel.columns).collect())) == sorted(rel.fetchall())
