import random
from collections import Counter

import pytest

from lattika.llm import chat, mixing, urls


def test_snapshots(spark):
    rng = random.Random(3)
    rows, whole = [], {}
    base = [[("user" if i % 2 == 0 else "assistant", f"t{c}-{i}") for i in range(6)] for c in range(8)]
    for c in range(60):
        turns = base[rng.randrange(8)][: rng.randint(1, 6)] if c % 4 else [("user", f"own {c}")]
        whole[c] = turns
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    whole[70] = [(None, "a"), ("user", None), ("assistant", "<|im_end|> q")]
    rows += [(70, 0, None, "a", "x"), (70, 1, "user", None, "x"), (70, 1, "user", None, "y"), (70, 2, "assistant", "<|im_end|> q", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: r for r in chat.collapse(df).collect()}
    want = {}
    for c, turns in whole.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in whole.values()):
            continue
        want.setdefault(tuple(turns), []).append(c)
    assert {k: r["n_copies"] for k, r in got.items()} == {min(v): len(v) for v in want.values()}
    assert got[70]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<| im_end|> q<|im_end|>\n"
    assert got[70]["n_turns"] == 3 and got[70]["assistant_chars"] == 13
    assert chat.collapse(df.limit(0)).count() == 0


def test_periods_keep_each_stream_within_a_block():
    for weights in ({"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, mixing.WEIGHTS):
        q, slots = sum(weights.values()), mixing.period(weights)
        assert sorted(x for v in slots.values() for x in v) == list(range(q))
        for s, a in weights.items():
            assert all(k * q // a <= t < -(-(k + 1) * q // a) for k, t in enumerate(slots[s]))


def reference_order(weights, blocks):
    """EDF block by block, starting anew when a stream has run out."""
    left, order = dict(blocks), []
    done = Counter()
    while any(left.values()):
        live = {s: w for s, w in weights.items() if left.get(s)}
        q, own, t = sum(live.values()), Counter(), 0
        while True:
            ready = [(-(-(own[s] + 1) * q // w), s) for s, w in live.items() if own[s] * q // w <= t]
            _, s = min(ready)
            if not left[s]:
                break
            order.append((s, done[s]))
            own[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
    return order


def test_mixture_equals_stepwise_edf(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["src0"] * 5 + ["src1", "src2", "src9", None]), f"t{k}") for k in range(700)] + [(5, "src0", "t5")] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, slot int")
    weights = {"src0": 3, "src1": 2, "*": 4}
    got = mixing.schedule(df, weights, block=4).orderBy("position").collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    blocks = {s: -(-n // 4) for s, n in Counter(s if s in weights else "*" for _, s, _ in rows).items()}
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["stream"], r["block"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert [next(iter(slots[k])) for k in sorted(slots)] == reference_order(weights, blocks)
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    out = mixing.mixed(df, weights, block=4)
    assert out.columns == df.columns and out.count() == len(rows)
    assert mixing.schedule(df.limit(0), weights).count() == 0


URLS = [
    ("https://A.Example.ORG/es/1?x=1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2#t", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/a?b://c", "x.com", "/de/a", "com/de/", "block"),
    ("http://x.com/de", "x.com", "/de", None, None),
    ("http://x.org", "x.org", "", None, None),
    ("http://x.org?a/b", "x.org", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("://h.net/p", "h.net", "/p", None, None),
    ("a://b://c.org/x", "b:", "//c.org/x", None, None),
    ("http://ÄÖ.org/é", "ÄÖ.org", "/é", "org/", "allow"),
]


def test_rules_and_verdicts(spark):
    rows = [(k, u[0], "x") for k, u in enumerate(URLS)] + [(100 + k, f"http://{'spam' if k % 2 else 'fine'}.{'com/de/' if k % 2 else 'com/fr/'}{'9' * (k % 2 * 8)}{k}", "x") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] in ("allow", "block") and (verdict is None or got[k]["verdict"] == verdict)
    assert urls.judge(df.limit(0)).count() == 0


def test_trees_learn(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"http://site{k % 7}.net/{'a' * (k % 3)}/{'1234567890' if k % 2 else 'abc'}{k}", k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    host, path = urls.parts(F.col("url"))
    f = urls.features(df.withColumn("host", host).withColumn("path", path), "url", "host", "path")
    from lattika.llm.common import Scratch

    model = urls.train(f.filter("page_id % 5 <> 0"), "label", Scratch(spark, "t"))
    held = model.with_suffix(f.filter("page_id % 5 = 0")).select("label", (model.margin() > 0).cast("int").alias("p"))
    assert held.filter("label = p").count() == held.count()


@pytest.mark.parametrize("n", [0, 3])
def test_one_class_is_constant(spark, n):
    df = spark.createDataFrame([(k, "http://a.org/x") for k in range(n)] + [(9, "http://b.net/")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(df).filter("page_id = 9").collect()} <= {"allow", "block"}


def test_each_source_has_its_own_windows(spark):
    rows = [(k, f"src{k % 13}" if k % 3 else "src7") for k in range(3000)] + [(k, None) for k in range(3000, 3100)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = mixing.own_weights({s or "*" for _, s in rows})
    got = mixing.schedule(df, block=4).orderBy("position").collect()
    assert len(got) == len(rows) and all(r["stream"] == (r["source"] or "*") and r["release"] <= r["slot"] < r["deadline"] for r in got)
    q = sum(weights.values())
    assert all(weights[f"src{k}"] * 100 == q * mixing.WEIGHTS[f"src{k}"] for k in range(4)) and len({weights[s] for s in weights if s not in mixing.WEIGHTS or s == "*"}) == 1
    order = {}
    for r in got:
        assert order.setdefault(r["slot"], (r["stream"], r["phase"]))[0] == r["stream"]
    assert sorted(order) == list(range(len(order)))
    own = Counter()
    for t in sorted(t for t, (_, phase) in order.items() if phase == 0):
        own[order[t][0]] += 1
        assert all(abs(own[s] - weights[s] * (t + 1) / q) < 1 for s in weights)
    blocks = {s: -(-n // 4) for s, n in Counter(s or "*" for _, s in rows).items()}
    assert [order[t][0] for t in sorted(order)] == [s for s, _ in reference_order(weights, blocks)]


def test_many_sources_stay_bounded_by_blocks():
    blocks = {f"s{k}": 1 + k % 2 for k in range(400)}
    assert len(mixing.plan_rows(mixing.own_weights(blocks), blocks)) == sum(blocks.values())
    assert mixing.own_weights([]) == {}


def plain_tree(rows, names, edges, depth):
    """The best splits by trying each feature and bin on the rows themselves: (feature, bin, left, right) or a leaf's value."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best = None
    for c in names if depth else []:
        for b in range(len(edges[c])):
            left, right = [r for r in rows if r[c] <= b], [r for r in rows if r[c] > b]
            lg, lh, rg, rh = sum(r["g"] for r in left), sum(r["h"] for r in left), sum(r["g"] for r in right), sum(r["h"] for r in right)
            if min(lh, rh) >= 0.5:
                gain = lg**2 / (lh + urls.L2) + rg**2 / (rh + urls.L2) - g**2 / (h + urls.L2)
                if gain > (best[0] + 1e-9 if best else 1e-6):
                    best = (gain, c, b, left, right)
    if best is None:
        return round(-urls.RATE * g / (h + urls.L2), 9)
    return (best[1], best[2], plain_tree(best[3], names, edges, depth - 1), plain_tree(best[4], names, edges, depth - 1))


def rounded(tree):
    return (*tree[:2], rounded(tree[2]), rounded(tree[3])) if isinstance(tree, tuple) else round(tree, 9)


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names, edges = ["f_a", "f_b", "f_c"], {"f_a": [1, 2, 3], "f_b": [1], "f_c": [1, 2, 3, 4, 5]}
    rows = []
    for _ in range(120):
        r = {c: rng.randint(0, len(edges[c])) for c in names}
        q = rng.uniform(0.1, 0.9)
        y = int(r["f_a"] > 1) ^ int(r["f_c"] > 2 and r["f_b"] == 0) if rng.random() < 0.9 else rng.randint(0, 1)
        rows.append(r | {"g": q - y, "h": q * (1 - q)})
    grown = urls.grow(spark.createDataFrame(rows, "f_a int, f_b int, f_c int, g double, h double"), names, edges, 3)
    assert rounded(grown) == plain_tree(rows, names, edges, 3)


def test_rules_against_sql(spark, sf):
    import duckdb

    from lattika.llm.common import read_table

    fits = lambda rule: "((host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}'))".format(*rule.split("/", 1))
    by_length = sorted((r for r, _ in urls.RULES), key=len, reverse=True)
    case = " ".join(f"when {fits(r)} then '{r}'" for r in by_length)
    c = duckdb.connect()
    want = c.sql(f"""
        with u as (select page_id, coalesce(url, '') as u from '{sf}/pages.parquet'),
        s as (select page_id, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else '' end as r from u),
        h as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from s)
        select page_id, host, path, case {case} end as rule from h""").fetchall()
    got = urls.judge(read_table(spark, sf, "pages")).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rows_without_conversation_stand_alone(spark):
    import duckdb

    rows = [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "user", "lost"), (None, None, None, None), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in chat.collapse(df).collect()), key=str)
    assert [(r[0], r[1], r[2]) for r in got] == [(3, 2, 1), (4, 1, 2), (None, 1, 1)]
    conversations = df.toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(chat.ORACLE_SQL).fetchall(), key=str)
