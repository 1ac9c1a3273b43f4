"""Toxicity by weak supervision.

Voters are mined from labelled rows: words and word beginnings that toxic texts hold far more often than
clean ones, and a few patterns. A generative model of their votes (fires or abstains, given the class)
estimates how often each fires in either class, and which voters say the same again: voters that are
correlated within a class share their weight. A voter that is silent abstains; that none of the lexicon
fires is a voter of its own, for clean. Labels choose voters and set where the model's rates start; they are
no input of a posterior: the votes alone label every sampled row, so a wrong label is overruled. On these
posteriors a linear classifier is trained, which scores all texts. Doc_id, source, language and labels never
enter a score.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Scratch, in_parts
from .lshforest import mix
from .tokens import CODE, LIMIT, powers

TOXIC_ROWS, CLEAN_ROWS = 4_000, 16_000
"""Bounds of the training sample, in labelled toxic and clean rows."""
LIFT, SUPPORT, EVIDENCE = 12.0, 3, 12.0
"""How much likelier a toxic text must hold a feature that becomes a voter, in how many texts at least, and the
log-likelihood ratio that tells it from chance among several hundred thousand features. Nothing else bounds the voters."""
PREFIXES = (3, 4, 5, 6, 7, 8)
PATTERNS = ("exclamation", "capitals", "repeated", "masked")

_KIND = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 9, dtype=np.uint64) | np.uint64(1)
#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han): a word may start at any of their letters.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))
SIGN, WORD, MARK, GLUED = 0, 1, 2, 3


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point by Unicode category: its class (SIGN, letter of a WORD, MARK on a letter, letter or mark GLUED to others without spaces), lower case, whether it is upper case, and its code in hashes."""
    every = range(sys.maxunicode + 1)
    kind = np.fromiter(map(str.isalpha, map(chr, every)), np.uint8, len(every))
    for c in np.flatnonzero(kind == SIGN).tolist():
        if unicodedata.category(chr(c))[0] == "M":
            kind[c] = MARK
    for a, b in UNSPACED:
        kind[a : b + 1][kind[a : b + 1] != SIGN] = GLUED
    lower, upper = np.arange(len(every), dtype=np.uint32), np.zeros(len(every), bool)
    for c in np.flatnonzero(kind == WORD).tolist():
        x = chr(c)
        upper[c] = x.isupper()
        if len(x := x.lower()) == 1:
            lower[c] = ord(x)
    code = mix(np.arange(len(every), dtype=np.uint64))
    code[:LIMIT] = CODE[:LIMIT]
    return kind, lower, upper, code


class Words:
    """The words (runs of letters and their marks, lower-cased) of a few texts, as hashes of each word and of its beginnings.

    In scripts without spaces each letter starts a word of two characters, and beginnings reach to the run's end.
    """

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        joined = "\n".join(texts) + "\n"
        self.points = points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.cumsum(sizes) - sizes
        self.sizes = sizes
        kinds, lower, self.upper, code = characters()
        self.lower, kind = lower[points], kinds[points]
        self.letter = kind != SIGN
        glued = kind == GLUED
        turn = np.flatnonzero(np.diff(self.letter & ~glued, prepend=False))
        start, end = turn[::2], turn[1::2]
        marks = np.flatnonzero(kind[start] == MARK)
        if len(marks):  # a word starts with a letter
            first = np.append(np.flatnonzero(kind == WORD), len(points))
            start = start.copy()
            start[marks] = first[np.searchsorted(first, start[marks])]
            start, end = start[start < end], end[start < end]
        reach = end
        if glued.any():
            turn = np.flatnonzero(np.diff(glued, prepend=False))
            alone = np.flatnonzero(glued)
            until = turn[1::2][np.searchsorted(turn[1::2], alone, "right")]
            start, end, reach = np.concatenate([start, alone]), np.concatenate([end, np.minimum(alone + 2, until)]), np.concatenate([end, until])
        # Where each word starts, where it ends and how far its beginnings reach.
        self.start, self.end, self.reach = start, end, reach
        up, down = powers(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(code[self.lower] * up[: len(points)], out=self.sums[1:])
        self.down = down
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.n = len(texts)

    def features(self):
        """(hashes, texts' numbers) for whole words, then for beginnings of each length."""
        size = self.reach - self.start
        yield (self.sums[self.end] - self.sums[self.start]) * self.down[self.start] * _KIND[0], self.doc
        for k in PREFIXES:
            long = size >= k
            a = self.start[long]
            yield (self.sums[a + k] - self.sums[a]) * self.down[a] * _KIND[k], self.doc[long]

    def spelled(self, wanted: set[int]) -> dict[int, tuple[str, bool]]:
        """The text of some features, and whether it is a beginning."""
        out: dict[int, tuple[str, bool]] = {}
        size = self.reach - self.start
        for k in (0, *PREFIXES):
            ok = size >= k
            a = self.start[ok]
            b = self.end[ok] if k == 0 else a + k
            h = (self.sums[b] - self.sums[a]) * self.down[a] * _KIND[k]
            hit = np.flatnonzero(np.isin(h, np.fromiter(wanted, np.uint64, len(wanted))))
            for i in hit.tolist():
                out.setdefault(int(h[i]), ("".join(map(chr, self.lower[a[i] : b[i]].tolist())), k > 0))
        return out

    def fired(self, table: np.ndarray) -> np.ndarray:
        """How often each feature of a sorted table occurs in each text."""
        out = np.zeros(self.n * len(table), np.float64)
        if len(table):
            for hashes, doc in self.features():
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                hit = np.flatnonzero(table[at] == hashes)
                out += np.bincount(doc[hit] * len(table) + at[hit], minlength=len(out))
        return out.reshape(self.n, len(table))

    def patterns(self) -> np.ndarray:
        """The pattern voters' votes: shouting signs, capitals, one letter over and over, masked letters."""
        p = self.points
        share = lambda mask: np.add.reduceat(mask.astype(np.float64), self.first) / np.maximum(1, self.sizes - 1)
        repeated = np.zeros(len(p), bool)
        repeated[3:] = (p[3:] == p[2:-1]) & (p[3:] == p[1:-2]) & (p[3:] == p[:-3]) & self.letter[3:]
        masked = np.zeros(len(p), bool)
        masked[1:-1] = ((p[1:-1] == ord("*")) | (p[1:-1] == ord("@")) | (p[1:-1] == ord("$"))) & self.letter[:-2] & self.letter[2:]
        return np.stack([share(p == ord("!")) > 0.02, share(self.upper[p]) > 0.5, share(repeated) > 0, share(masked) > 0], axis=1).astype(np.float64)


def pieces(columns: list, rows: int = 128, chars: int = 1 << 18):
    """Rows of a batch in pieces of bounded size; the first column holds texts."""
    a, n = 0, len(columns[0])
    while a < n:
        b, size = a, 0
        while b < n and b - a < rows and (b == a or size < chars):
            size += len(columns[0][b] or "")
            b += 1
        yield [c[a:b] for c in columns]
        a = b


# ---- mining


def counted(texts: DataFrame) -> DataFrame:
    """(feature, n): in how many texts each word or beginning occurs."""

    def run(batches):
        seen: list[np.ndarray] = []
        for batch in in_parts(batches):
            for (part,) in pieces([batch.column(0).to_pylist()]):
                f, d = (np.concatenate(c) for c in zip(*Words(part).features(), strict=True))
                # Within a text each feature counts once.
                order = np.lexsort((d, f))
                f, d = f[order].view(np.int64), d[order]
                seen.append(f[np.append(True, (f[1:] != f[:-1]) | (d[1:] != d[:-1]))] if len(f) else f)
            if sum(map(len, seen)) > 2_000_000:
                yield flat(seen)
                seen = []
        if seen:
            yield flat(seen)

    def flat(seen):
        f, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.record_batch([pa.array(f), pa.array(n.astype(np.int64))], names=["feature", "n"])

    return texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def telling(toxic_rows: DataFrame, clean_rows: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(feature, toxic, clean): the features that toxic texts hold often enough, far likelier than clean ones and not by chance."""
    often = counted(toxic_rows).filter(F.col("n") >= SUPPORT).withColumnRenamed("n", "toxic")
    both = often.join(counted(clean_rows).withColumnRenamed("n", "clean"), "feature", "left").fillna(0, ["clean"])
    toxic, clean, share = F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean)
    lift = (toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))
    evidence = toxic * F.log(toxic / ((toxic + clean) * share)) + clean * F.log(F.greatest(clean, F.lit(1)) / ((toxic + clean) * (1 - share)))
    return both.filter((lift >= LIFT) & (evidence >= EVIDENCE))


@dataclass
class Model:
    """The voters' features (sorted hashes) and the classifier; spelling is for people."""

    features: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    spelling: dict[int, tuple[str, bool]] = field(default_factory=dict)
    accuracy: np.ndarray | None = None
    correlation: np.ndarray | None = None

    def inputs(self, words: Words) -> np.ndarray:
        hits = words.fired(self.features)
        return np.concatenate([hits > 0, words.patterns(), np.log1p((hits > 0).sum(1, keepdims=True))], axis=1).astype(np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.inputs(Words(texts)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chosen(features: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, spelling: dict[int, tuple[str, bool]]) -> list[int]:
    """Places of the features that become voters: large lift; of beginnings of one another, the longest that keeps the support."""
    lift = ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))
    own = {spelling[int(f)]: k for k, f in enumerate(features) if int(f) in spelling}
    share, n = n_toxic / (n_toxic + n_clean), toxic + clean
    evidence = toxic * np.log(np.maximum(toxic, 1) / (n * share)) + clean * np.log(np.maximum(clean, 1) / (n * (1 - share)))
    good = {s: k for s, k in own.items() if lift[k] >= LIFT and toxic[k] >= SUPPORT and evidence[k] >= EVIDENCE}
    longest: dict[str, int] = {}
    for (text, _), k in good.items():
        for n in range(1, len(text) + 1):
            longest[text[:n]] = max(longest.get(text[:n], 0), int(toxic[k])) if n < len(text) else longest.get(text[:n], 0)
    keep = []
    for (text, start), k in good.items():
        if start and (longest.get(text, 0) >= 0.97 * toxic[k] or toxic[own.get((text, False), k)] >= 0.97 * toxic[k] and (text, False) in good):
            continue
        shorter = any((text[:n], True) in good and lift[good[text[:n], True]] >= lift[k] * 0.2 and toxic[good[text[:n], True]] > 1.03 * toxic[k] for n in PREFIXES if n < len(text) or (n == len(text) and not start))
        if not shorter:
            keep.append(k)
    return sorted(keep, key=lambda k: (-toxic[k] * np.log(lift[k]), int(features[k])))


def independent(row: np.ndarray, voter: np.ndarray, n: int, known: np.ndarray, least: float = 5.0) -> np.ndarray:
    """Places of the voters that tell something of rows no better voter fires on, best first in turn; sorted.

    Words that merely stand beside a telling one, as in copies of a few texts, add nothing and go; those that
    fire as often as a twentieth of the best, and on no clean row, stay in any case. row and voter say which of n
    voters fires on which of the known rows, each once.
    """
    left, out = np.ones(len(known), bool), []
    share = known.mean()
    often, seldom = (np.bincount(voter[known[row] == c], minlength=n).astype(np.float64) for c in (1, 0))
    pure = (often >= 0.05 * often.max(initial=0)) & (often >= 10) & (seldom == 0)
    order = np.argsort(voter, kind="stable")
    ends = np.searchsorted(voter[order], np.arange(n + 1))
    toxic, clean = often.copy(), seldom.copy()
    by_row = np.argsort(row, kind="stable")
    of_row = np.searchsorted(row[by_row], np.arange(len(known) + 1))
    while len(out) < n:
        both = np.maximum(toxic + clean, 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = np.where(toxic / both > share, toxic * np.log(np.maximum(toxic, 1e-9) / (both * share)) + clean * np.log(np.maximum(clean, 1e-9) / (both * (1 - share))), 0)
        evidence[out] = 0
        best = int(np.argmax(evidence))
        if evidence[best] < least:
            break
        out.append(best)
        for i in row[order[ends[best] : ends[best + 1]]].tolist():
            if left[i]:
                left[i] = False
                np.subtract.at(toxic if known[i] == 1 else clean, voter[by_row[of_row[i] : of_row[i + 1]]], 1)
    return np.array(sorted({*out, *np.flatnonzero(pure).tolist()}), np.int64)


# ---- the label model


def label_model(votes: np.ndarray, prior: float, fires: tuple[np.ndarray, np.ndarray], strength: tuple[float, float], rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of class 1, the voters' accuracies, and their correlations within a class, by EM over the votes.

    votes: rows of 0 and 1. prior: the share of class 1, which stays: silence says nothing here, so votes alone
    don't tell it. fires: how often each voter fires in class 0 and 1 among the labelled rows, which counts as
    `strength` rows of each class: without such an anchor a weak voter that often fires alone makes itself right.
    A voter's accuracy is the chance that a row on which it fires is of class 1, were both classes as common;
    the log-odds of that is its weight, divided by the correlations with the voters that say the same.
    """
    low, high = first = [np.clip(f, 1e-5, 1 - 1e-5) for f in fires]
    prior = float(np.clip(prior, 1e-3, 0.999))
    share, correlation = np.ones(votes.shape[1]), np.eye(votes.shape[1])
    for turn in range(rounds):
        accuracy = high / (high + low)
        z = np.log(prior / (1 - prior)) + votes @ (share * np.log(accuracy / (1 - accuracy)))
        post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        low, high = (np.clip((p @ votes + n * f) / (p.sum() + n), 1e-5, 1 - 1e-5) for p, n, f in zip((1 - post, post), strength, first, strict=True))
        if turn in (2, 6):
            off = np.concatenate([np.sqrt(post)[:, None] * (votes - high), np.sqrt(1 - post)[:, None] * (votes - low)])
            spread = np.sqrt(np.maximum((off**2).sum(0), 1e-9))
            correlation = (off.T @ off) / np.outer(spread, spread)
            strong = np.where(correlation > 0.5, correlation, 0.0)
            np.fill_diagonal(strong, 1.0)
            share = 1 / strong.sum(1)
    return post, accuracy, correlation


def classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of at most TOXIC_ROWS toxic and CLEAN_ROWS clean documents, and the share of toxic labels.

    The documents with the least hashes are taken, so that the bound is exact at any size; one that has
    several rows gives one of its texts, one with several labels counts as the largest.
    """
    y = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    least = [y.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    # At most TOXIC_ROWS + CLEAN_ROWS ids, so they may go to every task.
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(least[0].unionByName(least[1])), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), n.get(1, 0) / max(1, sum(n.values()))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), on a sample within the bounds above.

    labels must hold only rows that may be learnt from. Without toxic or clean rows every text scores the
    share of toxic ones.
    """
    rows, prior = sampled(docs, labels)
    rows = Scratch(docs.sparkSession, "toxicity").cut(rows, "sample")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    width = len(PATTERNS) + 1
    if not n_toxic or not n_clean:
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(width), float(np.log(rate / (1 - rate))))
    toxic_rows, clean_rows = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    mined = np.array(sorted((r["feature"] & (1 << 64) - 1, r["toxic"], r["clean"]) for r in telling(toxic_rows, clean_rows, n_toxic, n_clean).collect()), np.uint64).reshape(-1, 3)
    features, toxic, clean = np.ascontiguousarray(mined[:, 0]), mined[:, 1].astype(np.int64), mined[:, 2].astype(np.int64)
    spelling = spelled(toxic_rows, features)
    keep = np.array(sorted(chosen(features, toxic, clean, n_toxic, n_clean, spelling), key=lambda k: int(features[k])), np.int64)
    alone = independent(*fires_of(rows, features[keep]))
    model = Model(features[keep][alone], spelling={int(f): spelling[int(f)] for f in features[keep]})
    x, known = inputs_of(rows.select("text", "toxic"), model)
    votes = votes_of(x, len(alone))
    fires = tuple(((votes[known == c].sum(0) + 0.5) / ((known == c).sum() + 1)) for c in (0, 1))
    post, model.accuracy, model.correlation = label_model(votes, prior, fires, (float(n_clean), float(n_toxic)))
    model.weights, model.bias = classifier(x, post)
    return model


def votes_of(x: np.ndarray, n: int) -> np.ndarray:
    """The votes that the classifier's inputs of n lexicon voters stand for: lexicon, patterns, and that the lexicon is silent."""
    return np.concatenate([x[:, :-1], x[:, :n].sum(1, keepdims=True) == 0], axis=1).astype(np.float64)


def spelled(texts: DataFrame, features: np.ndarray) -> dict[int, tuple[str, bool]]:
    """The texts of some features: at most len(features) lines a task come back."""

    def run(batches):
        left, out = set(features.tolist()), {}
        for batch in in_parts(batches):
            for (part,) in pieces([batch.column(0).to_pylist()]):
                if left:
                    out |= (got := Words(part).spelled(left))
                    left -= set(got)
        yield pa.record_batch([pa.array(np.array(list(out), np.uint64).view(np.int64)), pa.array([v[0] for v in out.values()], pa.string()), pa.array([v[1] for v in out.values()], pa.bool_())], names=["f", "s", "p"])

    lines = texts.select("text").mapInArrow(run, "f long, s string, p boolean").dropDuplicates(["f"]).collect()
    return {r["f"] & (1 << 64) - 1: (r["s"], r["p"]) for r in lines}


def fires_of(rows: DataFrame, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Which features fire on which labelled rows, as rows' numbers and features' places; how many features; the rows' classes."""

    def run(batches):
        for batch in in_parts(batches):
            for texts, known in pieces([batch.column(0).to_pylist(), batch.column(1).to_pylist()]):
                own = [[] for _ in texts]
                if len(features):
                    for hashes, doc in Words(texts).features():
                        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
                        for i in np.flatnonzero(features[at] == hashes).tolist():
                            own[doc[i]].append(at[i])
                yield pa.record_batch([pa.array([np.unique(np.array(o, np.int32)).tobytes() for o in own], pa.binary()), pa.array(known, pa.int32())], names=["v", "y"])

    got = [(np.frombuffer(r["v"], np.int32), r["y"]) for r in rows.select("text", "toxic").mapInArrow(run, "v binary, y int").collect()]
    voter = np.concatenate([np.zeros(0, np.int32), *(g[0] for g in got)])
    return np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), voter, len(features), np.array([g[1] for g in got])


def inputs_of(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The classifier's inputs and the known classes of the sample."""

    def run(batches):
        for batch in in_parts(batches):
            for texts, known in pieces([batch.column(0).to_pylist(), batch.column(1).to_pylist()]):
                x = model.inputs(Words(texts)).astype(np.float32)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(known, pa.int32())], names=["x", "y"])

    got = [(r["x"], r["y"]) for r in rows.mapInArrow(run, "x binary, y int").collect()]
    return np.frombuffer(b"".join(g[0] for g in got), np.float32).reshape(len(got), -1).astype(np.float64), np.array([g[1] for g in got])


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def usable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those whose crc32(doc_id as text) isn't divisible by 5."""
    return labels.select("doc_id", "toxic").filter(f"doc_id is not null and not ({HELD_OUT})")


def scored(docs: DataFrame, model: Model, columns: list[str], least: int = 0, most: int = 1) -> DataFrame:
    """The columns asked for as _0, _1, ..., with _score and _predicted, of every row predicted from `least` to `most`.

    A null text counts as empty. The text goes to the workers once, and whole batches are never turned to
    Python objects: parts of bounded size are scored and filtered by mask.
    """
    kinds = [docs.schema[c] for c in columns]
    out = StructType([*[StructField(f"_{i}", k.dataType) for i, k in enumerate(kinds)], StructField("_score", DoubleType()), StructField("_predicted", IntegerType())])
    at = columns.index("text") if "text" in columns else len(columns)
    n = len(columns)

    def run(batches):
        for batch in in_parts(batches):
            score = np.concatenate([model.score(part) for (part,) in pieces([batch.column(at).to_pylist()])])
            score = np.round(score, 9)
            predicted = (score >= 0.5).astype(np.int32)
            got = pa.record_batch([*batch.columns[:n], pa.array(score), pa.array(predicted)], names=out.names)
            yield got if (least, most) == (0, 1) else got.filter(pa.array((predicted >= least) & (predicted <= most)))

    sent = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns)] + ([] if at < n else [F.col("text").alias("_text")])
    return docs.select(*sent).mapInArrow(run, out)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a row without doc_id is not held out.

    A null or empty text is scored as one on which no voter fires; a long one is scored whole; repeated rows
    score alike; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs, usable(labels))
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    got = scored(docs, model, ["doc_id"]).select(F.col("_0").alias("doc_id"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
    return got.select("doc_id", held.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with its own columns, without the rows that the classifier calls toxic; rows are judged as in judged()."""
    model = fit(docs, usable(labels))
    names = docs.columns
    return scored(docs, model, names, most=0).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
