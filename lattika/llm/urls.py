"""URL filters, native: rules first, then gradient-boosted trees on lexical features.

Everything that touches rows is a DataFrame expression. Training runs on histograms: each tree level is
one aggregation over (node, feature, bin), of which the driver sees at most nodes x features x bins rows.
The trees become one CASE expression inside whole-stage code generation.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hashes

#: (rule, verdict): a rule is host/path; it fits the host and its subdomains if the path starts as it does.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
SAMPLE, BINS, TREES, DEPTH, RATE, L2 = 20_000, 12, 6, 3, 0.5, 1.0
"""Training bound in rows, bins a feature, trees, their depth, shrinkage, leaf penalty."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """host and path; both empty where the url is null or has no `://`."""
    u = F.coalesce(url, F.lit(""))
    # The pattern takes the first `://`: what stands before it can't hold another.
    first = r"(?s)^((?!://).)*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, first, 2), UPPER, LOWER), F.regexp_extract(u, first, 3)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule, verdict in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def count_of(text: Column, what: str) -> Column:
    """How often a character of the class `what` occurs."""
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars, n = F.filter(F.split(text, ""), lambda c: c != ""), F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def features(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """df with the lexical features f_* and the suffix of the host (its last two labels)."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    length = F.greatest(F.length(u), F.lit(1))
    named = {
        "f_length": F.length(u), "f_host_length": F.length(h), "f_path_length": F.length(p),
        "f_depth": count_of(p, "/"), "f_labels": count_of(h, "\\."), "f_hyphens": count_of(h, "-"),
        "f_digit_ratio": count_of(u, "[0-9]") / length, "f_host_digits": count_of(h, "[0-9]"),
        "f_entropy": entropy(u), "f_host_entropy": entropy(h),
        "f_params": F.when(query == "", 0).otherwise(count_of(query, "&") + 1), "f_fragment": u.contains("#").cast("int"),
    }
    return df.withColumns({k: v.cast("double") for k, v in named.items()} | {"suffix": F.substring_index(h, ".", -2)})


class Boosted:
    """Trees over named numeric columns: lists of (feature, threshold, left, right) and leaf values. x <= threshold goes left.

    suffixes: (suffix, f_suffix), each suffix's smoothed share of label 1; rest: that of suffixes not seen.
    """

    def __init__(self, base: float, trees: list, suffixes: DataFrame | None, rest: float):
        self.base, self.trees, self.suffixes, self.rest = base, trees, suffixes, rest

    def with_suffix(self, rows: DataFrame) -> DataFrame:
        """rows with f_suffix by their suffix."""
        if self.suffixes is None:
            return rows.withColumn("f_suffix", F.lit(float(self.rest)))
        # One line per suffix of the training sample: no more than SAMPLE rows, about.
        return rows.join(F.broadcast(self.suffixes), "suffix", "left").fillna(float(self.rest), ["f_suffix"])

    def margin(self) -> Column:
        return reduce(lambda a, t: a + tree_column(t), self.trees, F.lit(float(self.base)))


def tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(F.col(feature) <= F.lit(float(threshold)), tree_column(left)).otherwise(tree_column(right))


def node_column(tree, at: int = 1) -> Column:
    """The number of the leaf that a row reaches; a tree's root is 1, the children of k are 2k and 2k + 1."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    feature, threshold, left, right = tree
    return F.when(F.col(feature) <= F.lit(float(threshold)), node_column(left, 2 * at)).otherwise(node_column(right, 2 * at + 1))


def train(labelled: DataFrame, label: str, scratch: Scratch, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Trees for P(label = 1) from rows with the f_* columns, suffix and url.

    Fitted on at most about `sample` labelled rows, drawn by the url's hash. Without rows, or with one
    class only, the model is that constant.
    """
    names = [c for c in labelled.columns if c.startswith("f_")]
    n = labelled.count()
    part = labelled if n <= sample else labelled.filter(F.xxhash64("url") <= F.lit(least_hashes(sample / n)))
    rows = part.groupBy(*names, "suffix").agg(F.sum(label).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = scratch.cut(rows, "url-sample")
    pos, total = rows.agg(F.coalesce(F.sum("pos"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    rate = (pos + 0.5) / (total + 1)
    base = math.log(rate / (1 - rate))
    if not 0 < pos < total:
        return Boosted(base, [], None, rate)
    shares = rows.groupBy("suffix").agg(((F.sum("pos") + 2 * rate) / (F.sum("n") + 2)).alias("f_suffix"))
    model = Boosted(base, [], scratch.cut(shares, "url-suffixes"), rate)
    names = [*names, "f_suffix"]
    rows = model.with_suffix(rows)
    cuts = rows.agg(*[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 1000).alias(c) for c in names]).first()
    edges = {c: sorted(set(cuts[c] or [])) for c in names}
    binned = [reduce(lambda a, e, c=c: a + (F.col(c) > F.lit(float(e))).cast("int"), edges[c], F.lit(0)).alias(c) for c in names]
    rows = scratch.cut(rows.select(*binned, "pos", "n").groupBy(*names).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")), "url-bins")
    # While trees grow, a threshold is a bin's number; the finished model compares values with that bin's upper edge.
    grown: list = []
    for _ in range(trees):
        margin = reduce(lambda a, t: a + tree_column(t), grown, F.lit(base))
        now = rows.withColumn("q", 1 / (1 + F.exp(-margin))).withColumn("g", F.col("n") * F.col("q") - F.col("pos")).withColumn("h", F.col("n") * F.col("q") * (1 - F.col("q")))
        grown.append(grow(now, names, edges, depth))
    model.trees = [valued(t, edges) for t in grown]
    return model


def valued(tree, edges: dict[str, list[float]]):
    if not isinstance(tree, tuple):
        return tree
    feature, b, left, right = tree
    return feature, edges[feature][int(b)], valued(left, edges), valued(right, edges)


def leaf(g: float, h: float) -> float:
    return -RATE * g / (h + L2)


def grow(rows: DataFrame, names: list[str], edges: dict[str, list[float]], depth: int):
    """One tree by gradient and curvature histograms of the binned features, one aggregation a level."""
    splits: dict[int, tuple[str, float]] = {}
    leaves: dict[int, float] = {1: 0.0}

    def shape(at: int):
        return (*splits[at], shape(2 * at), shape(2 * at + 1)) if at in splits else leaves[at]

    open_nodes = {1}
    for _ in range(depth):
        if not open_nodes:
            break
        bins = F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("b")) for k, c in enumerate(names)])
        seen = rows.withColumn("node", node_column(shape(1))).filter(F.col("node").isin(sorted(open_nodes)))
        cells = seen.select("node", "g", "h", F.explode(bins).alias("x")).groupBy("node", F.col("x.f").alias("f"), F.col("x.b").alias("b")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        table = {(r["node"], r["f"], r["b"]): (r["g"], r["h"]) for r in cells}
        new: set[int] = set()
        for node in sorted(open_nodes):
            total_g, total_h = (math.fsum(v[i] for k, v in sorted(table.items()) if k[:2] == (node, 0)) for i in (0, 1))
            leaves[node] = leaf(total_g, total_h)
            best = None
            for f, c in enumerate(names):
                left_g = left_h = 0.0
                for b in range(len(edges[c])):
                    g, h = table.get((node, f, b), (0.0, 0.0))
                    left_g, left_h = left_g + g, left_h + h
                    right_g, right_h = total_g - left_g, total_h - left_h
                    if min(left_h, right_h) < 0.5:
                        continue
                    gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - total_g**2 / (total_h + L2)
                    if gain > (best[0] + 1e-9 if best else 1e-6):
                        best = (gain, c, b, leaf(left_g, left_h), leaf(right_g, right_h))
            if best:
                splits[node] = (best[1], best[2])
                leaves |= {2 * node: best[3], 2 * node + 1: best[4]}
                new |= {2 * node, 2 * node + 1}
        open_nodes = new
    return shape(1)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (P(block) by the trees) of every row.

    The labelled urls are those that a rule decides. Null urls have an empty host and path and get the
    trees' verdict, as do very long ones, whole; of rules of one length none fits twice; repeated rows are judged
    alike; an empty table gives an empty result; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    host, path = parts(F.col("url"))
    df = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    df = df.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    df = features(df, "url", "host", "path")
    labelled = df.filter(F.col("hit.rule").isNotNull()).withColumn("label", (F.col("hit.verdict") == "block").cast("int"))
    model = train(labelled, "label", scratch)
    scored = model.with_suffix(df).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 9).alias("score"))
