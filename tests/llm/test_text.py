import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.llm import toxicity, wrappers


def corpus(n=900):
    rng = random.Random(11)
    common = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}" for _ in range(150)]
    bad = ["idiotic", "scumbag", "trashy", "zwarg"]
    docs, labels = [], []
    for k in range(n):
        toxic = int(k % 8 == 0)
        w = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                b = rng.choice(bad)
                w.insert(rng.randrange(len(w)), b + rng.choice(["", "en", "er", "ung"]) if b == "zwarg" else b)
        docs.append((k, " ".join(w), "src", "en"))
        labels.append((k, 1, toxic))
    return docs, labels


def test_toxicity_holds_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (5000, None, "s", "en"), (5001, "", "s", "en"), (None, "fine", "s", "en"), (5002, "scumbag " + "bala " * 30_000, "s", "en")], "doc_id long, text string, score string, lang string")
    y = spark.createDataFrame([*labels, (None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(d, y).collect()}
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if got[k]["held_out"]]
    assert 100 < len(held) < 300
    import zlib

    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in truth)
    assert np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.97
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[5002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(k, 1, 1 - t if got[k]["held_out"] else t) for k, _, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.judged(d, other).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    kept = toxicity.accepted(d, y)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.judged(d, none).first()["predicted"] in (0, 1)
    assert toxicity.judged(d.limit(0), none).count() == 0


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(int)
    fire = np.array([0.6, 0.5, 0.4, 0.5]), np.array([0.01, 0.02, 0.02, 0.3])
    votes = np.stack([rng.random(4000) < np.where(y == 1, a, b) for a, b in zip(*fire, strict=True)], axis=1).astype(float)
    # A copy of the first voter, and the voter for clean that fires where the four are silent.
    votes = np.concatenate([votes, votes[:, :1], votes.sum(1, keepdims=True) == 0], axis=1)
    post, _, correlation = toxicity.label_model(votes, 0.3, (np.array([*fire[1], 0.01, 0.66]), np.array([*fire[0], 0.6, 0.06])), (2800.0, 1200.0))
    assert ((post > 0.5) == y).mean() > 0.9
    assert correlation[0, 4] > 0.9 and abs(correlation[0, 1]) < 0.3


PAGE = """<html><head><title>T</title></head><body><header class="site-header">Site</header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>%s<aside>Side</aside><form><label>Mail</label><input></form><footer>&copy; F</footer><script>var a = "<p>x</p>";</script></body></html>"""
CASES = [
    (PAGE % "<article><h1>A &amp; B</h1><p><b>On<i>e</i> t&#119;o<br><p>three&nbsp; four <div class='share'>Share</div></article>", "A & B One two three four"),
    (PAGE % "<main><p>x</p><section class=comments><article class=comment><p>reader</p></article></section></main>", "x"),
    (PAGE % "<div><p>First text here.</p><p>Second.</p></div>", "First text here. Second."),
    (PAGE % "<div class='ad'>open<article><p>kept</p></article>", "kept"),
    ("", ""),
    (None, ""),
    ("just &lt;text", "just <text"),
    ("<p>a<!-- <p>no</p> --><p>b<style>p{}</style>", "a b"),
    ("<article><p>cut off", "cut off"),
    ("<article><ul><li>one<li>two<table><tr><td>c<td>d</table></article>", "one two c d"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert wrappers.main_text(page) == text


def test_wrappers(spark):
    rows = [(k, "http://h.org/x", f"<body><div>All rights</div><div><p>text {k}</p>{'<p>more</p>' * (k % 3)}</div>{'<hr><div>extra %d</div>' % k if k % 2 else ''}</body>", "x") for k in range(12)]
    rows += [(100, None, None, "x"), (101, "http://one.org/", PAGE % "<article><p>q</p></article>", "x"), (101, "http://one.org/", PAGE % "<article><p>q</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    shape = {r["host"]: r for r in wrappers.wrappers(wrappers.observed(df)).collect()}
    assert shape["h.org"]["pages"] == 12 and "?" in shape["h.org"]["wrapper"] or "+" in shape["h.org"]["wrapper"]
    assert shape["h.org"]["literals"]
    got = sorted(map(tuple, wrappers.extracted(df).select("page_id", "text", "n_chars").collect()))
    assert len(got) == 15
    assert got[1][1] == "text 1 more extra 1" and got[0][1] == "text 0" and all(len(t) == n for _, t, n in got)
    assert got[12][1] == "" and got[13][1] == got[14][1] == "q"
    assert wrappers.extracted(df.limit(0)).count() == 0


def test_hard_pages_end():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert wrappers.main_text(deep) == "x"
    assert wrappers.main_text(deep, wrappers.compiled(wrappers.dumped(wrappers.observe(deep)[0]), [])) == "x"
    mixed = "".join(f"<h{k % 6 + 1}>a</h{k % 6 + 1}>" + "<p>b</p>" * (k % 3) + "<blockquote>c</blockquote>" * (k % 5 == 0) + "<hr>" for k in range(3000))
    one, two = wrappers.observe(mixed)[0], wrappers.observe(mixed[40:])[0]
    wrappers.align(one, two)
    spans = "<article><p>" + "<b>x</b> " * 20_000 + "</p></article>"
    assert len(wrappers.main_text(spans)) == 39_999
    assert wrappers.main_text("<article><p title=\"x>hello</p></article>") == "hello"


def test_repeated_groups():
    items = wrappers.observe("<article>" + "<h2>t</h2><p>x</p><p>y</p>" * 9 + "</article>")[0]
    assert wrappers.expression(items) == "<article><()><h2>#+<p>#+</p>+</()>+"


def test_alignment_makes_groups():
    a, b = wrappers.observe("<div><p>x</p><p>y</p><h2>t</h2></div>")[0], wrappers.observe("<div><p>x</p><span>s</span><h3>u</h3></div>")[0]
    assert wrappers.expression(a) == "<div><p>#</p>+<h2>#"
    assert wrappers.expression(wrappers.align(a, b)) == "<div><p>#</p>+<h2>#</h2>?#?<h3>#</h3>?"


def plain_lcs(one, two):
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence_against_the_plain_table():
    rng = random.Random(2)
    for n in range(300):
        one, two = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(2))
        got = wrappers.common(list(one), list(two), bits=1 << 29 if n % 2 else 40)
        assert all(one[i] == two[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
        assert len(got) == plain_lcs(one, two)


def test_the_wrapper_decides(spark):
    # Neutral elements only: which texts are the article's follows from the host's other pages.
    rows = [(k, "http://h.org/x", f"<body><div><a href=1>one {k}</a> <a href=2>two</a></div><section><p>text {k}</p>{f'<p>more {k}</p>' * (k % 3)}</section><div>Imprint of h</div></body>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    shapes = wrappers.wrappers(wrappers.observed(df))
    text = lambda w: {r["page_id"]: r["text"] for r in wrappers.applied(df, w).collect()}
    assert text(shapes)[2] == "text 2 more 2 more 2"
    assert text(shapes.withColumn("literals", F.array().cast("array<string>")))[2] == "text 2 more 2 more 2 Imprint of h"
    # A slot whose text is mostly links in the wrapper gives none, whatever the page's own block is like.
    own = shapes.first().asDict()
    items = wrappers.loaded(own["wrapper"])
    section = items[0].kids[1]
    assert wrappers.expression([section]) == "<section><p>#</p>+"
    section.kids[0].kids[0].stats = (100, 100)
    changed = spark.createDataFrame([own | {"wrapper": wrappers.dumped(items)}], shapes.schema)
    assert text(changed)[2] == ""


def made_page(rng, k):
    """A page and the text that belongs to its article, put together block by block."""
    words = lambda n: " ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randrange(999)) for _ in range(n))
    body, text = [], []
    for _ in range(rng.randint(1, 6)):
        kind, w = rng.choice(["p", "h2", "li", "br", "amp", "share", "inline"]), words(rng.randint(1, 8))
        if kind == "li":
            body.append(f"<ul><li>{w}<li>x{k}</ul>")
            text += [w, f"x{k}"]
        elif kind == "br":
            body.append(f"<p>{w}<br>\n {k}</p>")
            text += [w, str(k)]
        elif kind == "amp":
            body.append(f"<p>{w} &amp;&nbsp;&#65;</p>")
            text.append(f"{w} & A")
        elif kind == "share":
            body.append(f"<div class='share-box'>{w}</div>")
        elif kind == "inline":
            body.append(f"<p><b>{w}</b>, <i>{k}</i>")
            text.append(f"{w}, {k}")
        else:
            body.append(f"<{kind}>{w}</{kind}>")
            text.append(w)
    off = [f"<nav><a href=/>{words(2)}</a></nav>", "<div id=cookie-notice>We use cookies</div>", f"<aside>{words(5)}</aside>", f"<form><label>{words(1)}</label></form>", "<script>var x = '<p>no</p>';</script>"]
    rng.shuffle(off)
    cut = rng.randint(0, len(off))
    return f"<html><head><title>{words(3)}</title></head><body>{''.join(off[:cut])}<article>{''.join(body)}</article>{''.join(off[cut:])}<section class=comments><p>{words(4)}</p></section><footer>&copy; {words(2)}</footer></body></html>", " ".join(text)


def test_extraction_against_pages_put_together(spark):
    rng = random.Random(8)
    made = [made_page(rng, k) for k in range(120)]
    df = spark.createDataFrame([(k, f"http://h{k % 4 if k % 3 else 0}.org/{k}", page) for k, (page, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


def test_two_pages_tell_a_literal(spark):
    rows = [(k, "http://two.org/", f"<body><div>Welcome</div><p>own {k}</p></body>") for k in range(2)] + [(9, "http://one.org/", "<body><div>Welcome</div><p>own</p></body>")]
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "own 0", 1: "own 1", 9: "Welcome own"}


SCRIPTS = {
    "greek": ("ηλίθιος", "καλός αέρας σπίτι νερό δέντρο"),
    "cyrillic": ("дурачок", "хорошо привет деревня собака молоко"),
    "devanagari": ("मूर्खता", "नमस्ते दुनिया पानी किताब बगीचा"),
    "arabic": ("أحمقون", "مرحبا كتاب مدينة حديقة طريق"),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_words_of_all_scripts_become_voters(spark, script):
    bad, fine = SCRIPTS[script]
    rng, fine = random.Random(5), fine.split()
    docs, truth = [], {}
    for k in range(400):
        words = [rng.choice(fine) for _ in range(20)]
        truth[k] = int(k % 6 == 0)
        if truth[k]:
            words.insert(rng.randrange(20), f"“{bad}”")
        docs.append((k, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    assert all(r["predicted"] == truth[r["doc_id"]] for r in toxicity.judged(d, y).collect())


def test_words_are_hashed_by_code_points():
    def first(text):
        return {int(h) for hashes, _ in toxicity.Words([text]).features() for h in hashes}

    assert not first("привет") & first("собака") and first("ПРИВЕТ") == first("привет")
    assert first("“idiot”") == first("idiot") == first("…idiot—")
    assert first("idiot") == first("❤️idiot")  # a variation selector isn't a word's first letter
    two = toxicity.Words(["笨蛋"]).features().__next__()[0][0]
    assert two in toxicity.Words(["你是个笨蛋吗"]).features().__next__()[0]
    spelled = toxicity.Words(["नमस्ते Ärger"])
    assert ("नमस्ते", False) in spelled.spelled(first("नमस्ते")).values() and ("ärger", False) in spelled.spelled(first("ÄRGER")).values()


def test_all_telling_words_become_voters(spark):
    # Frequent words of toxic and clean texts outrank the telling ones, of which each stands in few texts.
    rng, rows = random.Random(9), []
    common = ["".join(rng.choice("abcdefghijklmnop") for _ in range(10)) for _ in range(4000)]
    bad = [f"{a}{b}{c}qz" for a in "qwrt" for b in "zxvy" for c in "kjhgfdspmlnb"]
    for k in range(8000):
        words = rng.sample(common, 40)
        if k % 4 == 0:
            words.append(bad[k // 4 % len(bad)])
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.fit(d, d.select("doc_id", "toxic"))
    assert (np.round(found.score(bad)) == 1).all() and len(found.features) > 160


def test_template_survives_odd_pages(spark):
    rows = [(k, "http://h.org/x", f"<body>{'<div>Breaking</div>' if k % 4 == 0 else ''}<div>All rights</div><div><p>text {k}</p></div></body>") for k in range(40)]
    rows += [(100, "http://h.org/n", None), (101, "http://h.org/b", " "), (102, "http://h.org/e", "<body><h1>404</h1></body>")]
    rows += [(200 + k, "http://copies.org/x", "<body><div>One page</div></body>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}
    assert all(got[k] == ("Breaking " if k % 4 == 0 else "") + f"text {k}" for k in range(40))
    assert got[100] == got[101] == "" and got[102] == "404" and got[205] == "One page"


def test_votes_overrule_single_wrong_labels():
    rng = np.random.default_rng(3)
    y = np.arange(1000) < 300
    votes = np.stack([(rng.random(1000) < 0.7) & y, (rng.random(1000) < 0.6) & y, (rng.random(1000) < 0.5) & y], axis=1).astype(float)
    votes = np.concatenate([votes, votes.sum(1, keepdims=True) == 0], axis=1)
    label = y.copy()
    wrong = np.flatnonzero(votes[:, :2].all(1))[:5]
    label[wrong] = False
    fires = tuple((votes[label == c].sum(0) + 0.5) / ((label == c).sum() + 1) for c in (False, True))
    post, accuracy, _ = toxicity.label_model(votes, 0.3, fires, (700.0, 300.0))
    assert (post[wrong] > 0.9).all() and (accuracy[:3] > 0.9).all() and accuracy[3] < 0.5


def test_words_against_a_plain_matcher():
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcAB éß .,'-19\n") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["", "x" * 5000 + " abc"]
    words = toxicity.Words(texts)
    plain = [[w.lower() if len(w.lower()) == len(w) else w for w in re.findall(r"[^\W\d_]+", t)] for t in texts]
    kinds = [lambda w: w, *[lambda w, k=k: w[:k] if len(w) >= k else None for k in toxicity.PREFIXES]]
    for (hashes, doc), of in zip(words.features(), kinds, strict=True):
        want = [[x for w in ws if (x := of(w)) is not None] for ws in plain]
        name = {}
        for h, d in zip(hashes.tolist(), doc.tolist(), strict=True):
            assert name.setdefault(h, w := want[d].pop(0)) == w
        assert not any(want) and len(set(name.values())) == len(name)


def test_repeated_rows_and_labels_keep_the_sample_bounded(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame([(k % 40, t) for k, t, _, _ in docs] + [(None, "x")], "doc_id long, text string")
    y = spark.createDataFrame([(k % 40, z) for k, _, z in labels], "doc_id long, toxic int")
    rows, share = toxicity.sampled(d, y)
    assert rows.count() == rows.select("doc_id").distinct().count() == 40 and 0 < share < 1
    assert toxicity.judged(d, y).count() == 401
