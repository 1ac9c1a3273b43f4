"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every whole text becomes its set of distinct 5-word shingles (64-bit hashes), a digest of the set and a
   signature of 64 minima. Equal sets fall together; one document represents them.
2. A tree of the forest is the list of representatives sorted by the signature read from another place.
   Neighbours with a common prefix of at least a few values are candidates; where a region is dense, the
   nearest neighbours share longer prefixes, so the depth adapts to it. Sorting is by range, with the id
   last, so no region is too large for a task.
3. In regions with more members than the neighbour window reaches, or that cross a partition's end, members
   that the candidates haven't yet joined are compared by signature in blocks, so that none is left out.
4. Documents joined by candidates form families, cut into blocks. Blocks meet their neighbours in a ring first,
   so each text is copied twice however large its family; the exact ratio of full sets decides every pair
   that isn't joined yet. Only families that this leaves in several components, and that have blocks which
   haven't met, meet in all other pairs of blocks, where pairs of different components are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_parts, shuffle_partitions
from .components import Union, components

WORDS, PERCENT = 5, 85
"""Words a shingle; documents link when 100 * intersection >= PERCENT * union."""
VALUES, NEAR, BLOCK, HELD = 64, 2, 512, 1 << 21
"""Values a signature, neighbours looked at on either side, members a block, and shingles a block (16 MB), but for single larger sets."""
DEEP, NO_REGION, NO_AGREEMENT = 4, 1e-5, 2.5e-6
"""The longest of the least prefixes, and the chances at most that a pair at the threshold shares no region
and that it has fewer equal values than a candidate needs."""


def shape(percent: int) -> tuple[int, int, int]:
    """(sorted orders, least common prefix, equal values that a candidate needs) for a threshold: 16, 4, 40 at 85; 17, 3, 35 at 80.

    The prefix is the longest whose orders, as many as the chance of a miss asks for, find room in the signature.
    """
    p = min(percent, 99) / 100
    trees, depth = VALUES, 1
    for d in range(DEEP, 0, -1):
        need = math.ceil(math.log(NO_REGION) / math.log(1 - p**d))
        if need * d <= VALUES:
            trees, depth = need, d
            break
    agree, fewer = 0, 0.0
    while (fewer := fewer + math.comb(VALUES, agree) * p**agree * (1 - p) ** (VALUES - agree)) <= NO_AGREEMENT:
        agree += 1
    return trees, depth, agree


TREES, DEPTH, AGREE = shape(PERCENT)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.Generator(np.random.PCG64(85))
_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_STEP = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words between the six ASCII white space characters.

    A text with fewer words is one shingle; one without words has an empty set.
    """
    from .tokens import powers

    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    blank = _SPACE[data]
    turn = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = turn[::2], turn[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    word = mix((sums[end] - sums[start]) * down[start])
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    rolled = np.zeros(0, np.uint64)
    if len(word) >= words:
        rolled = word[: len(word) - words + 1] * _STEP[0]
        for k in range(1, words):
            rolled = rolled + word[k : len(word) - words + 1 + k] * _STEP[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima of the set, 32 bits each."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[a : a + 1024, None] * _FACTOR).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (null where it is empty) and signature of each row."""
    names = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for batch in in_parts(batches):
            sets = shingle_sets(batch.column(1).to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sigs = [signature(s).astype(">u4").tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=names)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


# ---- the forest


def entries(reps: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """A row per representative and tree: id and sort key, which is the tree's number and the signature from the tree's place on."""
    width = 4 * 2 * depth
    turned = F.concat("sig", F.substring("sig", 1, width))
    keys = F.array(*[F.concat(F.lit(bytes([t])), F.substring(turned, 1 + 4 * depth * t, width)) for t in range(trees)])
    return reps.select("id", F.explode(keys).alias("key"))


def neighbours(batches: Iterator[pa.RecordBatch], depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """From sorted entries: pairs (a, b, no region) of near neighbours, and members (a, no b, region) of regions not looked at whole."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.binary())])
    prefix = 1 + 4 * depth
    recent: list[int] = []
    held: list[int] = []  # the region's members as far as they may still be needed
    region, size, first, open_region = b"", 0, True, False
    out: list[tuple] = []
    for batch in batches:
        for key, i in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            if key[:prefix] != region:
                if first and size:  # the partition's first region may go on in the one before
                    out += [(x, None, region) for x in held]
                first = first and not size
                region, size, recent, held, open_region = key[:prefix], 0, [], [], False
            size += 1
            out += [(x, i, None) for x in recent if x != i]
            recent = [*recent[-NEAR + 1 :], i] if NEAR > 1 else [i]
            if size > NEAR + 1 and not first and not open_region:
                open_region = True
                out += [(x, None, region) for x in held]
            if open_region:
                out.append((i, None, region))
            held.append(i) if not open_region else held.clear()
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), names, strict=True)], schema=names)
                out = []
    out += [(x, None, region) for x in held]  # the last region may go on in the next partition
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), names, strict=True)], schema=names)


def agreeing(pairs: DataFrame, reps: DataFrame, agree: int = AGREE) -> DataFrame:
    """The pairs whose signatures have at least `agree` equal values."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(-1, VALUES) for k in (2, 3))
            same = (x == y).sum(1) >= agree
            keep = pa.array(same)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=names)

    one, two = reps.select(F.col("id").alias("a"), F.col("sig").alias("x")), reps.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def blocks_of(df: DataFrame, group: str, size: str, ident: str, block: int = BLOCK) -> DataFrame:
    """Rows copied to each pair of blocks (p <= q) of their group that they take part in; p and q say which, own which block is theirs."""
    n = F.ceil(F.col(size) / block).cast("int")
    d = df.withColumn("_n", n).withColumn("own", F.pmod(F.xxhash64(ident), F.col("_n")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.withColumn("p", F.least("own", "_o")).withColumn("q", F.greatest("own", "_o")).drop("_n", "_o")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[list[tuple]]:
    """Runs of rows with equal key columns, from sorted batches."""
    run: list[tuple] = []
    now: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = tuple(row[i] for i in keys)
            if k != now:
                if run:
                    yield run
                run, now = [], k
            run.append(row)
    if run:
        yield run


def allowed(sig: np.ndarray, x: int, others: np.ndarray, agree: int = AGREE) -> np.ndarray:
    """Which of the others agree with x in enough values."""
    return others[(sig[others] == sig[x]).sum(1) >= agree]


def left_over(members: DataFrame, found: DataFrame, reps: DataFrame, scratch: Scratch, agree: int = AGREE) -> DataFrame:
    """Candidate pairs within regions whose members `found` (node, component) doesn't join: a spanning part of them."""
    m = members.select(F.col("a").alias("id"), "region").distinct().join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    m = scratch.cut(m.select("region", "id", F.coalesce("component", "id").alias("c")), "members")
    split = m.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("region", "n")
    split = scratch.cut(split, "split")
    # Regions with more than a quarter of a partition's fair share of the rows: at most 4 a partition, so they may be broadcast.
    share = m.count() / (4 * shuffle_partitions(m.sparkSession))
    large = F.broadcast(split.filter(F.col("n") > share))
    small = m.join(large.select("region"), "region", "left_anti").join(split.filter(F.col("n") <= share), "region")
    rows = blocks_of(m.join(large, "region").unionByName(small).join(reps.select("id", "sig"), "id"), "region", "n", "id")
    rows = rows.select("region", "p", "q", "own", "id", "c", "sig").repartition(shuffle_partitions(m.sparkSession), "region", "p", "q").sortWithinPartitions("region", "p", "q", "id")

    def run(batches):
        for group in grouped(batches, [0, 1, 2]):
            ids = [g[4] for g in group]
            own = np.array([g[3] for g in group])
            component = np.array([g[5] for g in group])
            sig = np.frombuffer(b"".join(g[6] for g in group), ">u4").reshape(-1, VALUES)
            union, out = Union(), []
            for x in range(len(ids)):
                ok = component[x + 1 :] != component[x]
                if group[0][1] != group[0][2]:
                    ok &= own[x + 1 :] != own[x]
                for y in allowed(sig, x, x + 1 + np.flatnonzero(ok), agree).tolist():
                    if union.join(int(component[x]), int(component[y])):
                        out.append((ids[x], ids[y]))
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


# ---- exact links


def linked(sets: list[np.ndarray], ids: list[int], may: np.ndarray, union: Union, percent: int) -> list[tuple[int, int]]:
    """Links between the sets, as many as join what all links join. may[x, y]: whether a pair is to be compared here.

    The sizes' ratio bounds the similarity; every other pair that isn't joined yet is counted out.
    """
    out: list[tuple[int, int]] = []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max()) + 1, bool)
    for x in range(len(sets)):
        others = x + 1 + np.flatnonzero(may[x, x + 1 :])
        small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[100 * small >= percent * large].tolist()
        root = union.find(ids[x])
        others = [y for y in others if union.find(ids[y]) != root]
        if not others:
            continue
        mine = flat[first[x] : first[x] + sizes[x]]
        mark[mine] = True
        for y in others:
            if union.find(ids[y]) == union.find(ids[x]):
                continue
            both = int(np.count_nonzero(mark[flat[first[y] : first[y] + sizes[y]]]))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both) and union.join(ids[x], ids[y]):
                out.append((ids[x], ids[y]))
        mark[mine] = False
    return out


def meeting(rows: DataFrame, near: bool, percent: int) -> DataFrame:
    """Links (a, b) from rows (family, p, q, own, id, c, text) of pairs of blocks; near: pairs within block p count too. c: a component known already."""
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "family", "p", "q").sortWithinPartitions("family", "p", "q", "id")

    def done(key, own, ids, known, sets):
        own, union = np.array(own), Union()
        for i, c in zip(ids, known, strict=True):
            if c is not None:
                union.join(i, c)
        may = own[:, None] != own[None, :]
        if near:
            may |= (own == key[1])[:, None] & (own == key[1])[None, :]
        out = linked(sets, ids, may, union, percent)
        return pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        now, own, ids, known, sets = None, [], [], [], []
        for batch in in_parts(batches):
            family, p, q, o, i, c, texts = (x.to_pylist() for x in batch.columns)
            for key, o_, i_, c_, shingles in zip(zip(family, p, q, strict=True), o, i, c, shingle_sets(texts), strict=True):
                if key != now:
                    if now is not None:
                        yield done(now, own, ids, known, sets)
                    now, own, ids, known, sets = key, [], [], [], []
                own.append(o_)
                ids.append(i_)
                known.append(c_)
                sets.append(shingles)
        if now is not None:
            yield done(now, own, ids, known, sets)

    return rows.mapInArrow(run, "a long, b long")


def in_blocks(families: DataFrame, sizes: DataFrame, block: int, held: int) -> DataFrame:
    """The families' members (family, id) with the number of their family's blocks and their own."""
    f = families.join(sizes.select(F.col("id").alias("node"), "n_shingles"), "node").select(F.col("component").alias("family"), F.col("node").alias("id"), "n_shingles")
    n = f.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / held)).cast("int").alias("blocks"))
    return f.join(n, "family").select("family", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))


def confirmed(docs: DataFrame, families: DataFrame, sizes: DataFrame, scratch: Scratch, percent: int = PERCENT, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Links (a, b) that join the documents of each family as all its links would, from full sets.

    docs: id and text of representatives; families: node and component; sizes: id and n_shingles.
    """
    placed = scratch.cut(in_blocks(families, sizes, block, held), "blocks")
    rows = docs.join(placed, "id")
    ring = rows.withColumn("p", F.explode(F.when(F.col("blocks") > 1, F.array("own", F.pmod(F.col("own") - 1, F.col("blocks")))).otherwise(F.array("own"))))
    ring = ring.withColumn("q", F.pmod(F.col("p") + 1, F.col("blocks"))).select("family", "p", "q", "own", "id", F.lit(None).cast("long").alias("c"), "text")
    links = scratch.cut(meeting(ring, True, percent), "ring")
    # With up to three blocks every pair of them has met.
    large = placed.filter("blocks > 3").select("family", "id")
    found = components(links, scratch)
    c = large.join(found.withColumnRenamed("node", "id"), "id", "left").select("family", "id", F.coalesce("component", "id").alias("c"))
    open_ = scratch.cut(c.groupBy("family").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("family"), "open")
    if open_.isEmpty():
        return links
    far = rows.join(open_, "family").join(c.select("id", "c"), "id").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    gap = F.pmod(F.col("own") - F.col("_o"), F.col("blocks"))
    far = far.filter((gap > 1) & (gap < F.col("blocks") - 1)).select("family", F.least("own", "_o").alias("p"), F.greatest("own", "_o").alias("q"), "own", "id", "c", "text")
    return links.unionByName(meeting(far, False, percent))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, scratch: Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    component_id is the smallest doc_id that links lead to. Empty sets (null or blank texts) link with
    nothing; a row without doc_id has no component and is kept; rows that repeat a doc_id are one node and
    all are kept or not together; very long texts count whole; an empty table gives an
    empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "forest")
    trees, depth, agree = shape(percent)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.cut(signed(d), "signed")
    reps = scratch.cut(rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig"), F.max("n_shingles").alias("n_shingles")), "reps")
    sorted_ = entries(reps, trees, depth).repartitionByRange(shuffle_partitions(docs.sparkSession), "key", "id").sortWithinPartitions("key", "id")
    near = scratch.cut(sorted_.mapInArrow(lambda batches: neighbours(batches, depth), "a long, b long, region binary"), "near")
    pairs = near.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = scratch.cut(agreeing(pairs, reps, agree), "agreeing")
    found = scratch.cut(components(first, scratch), "found")
    rest = scratch.cut(left_over(near.filter("b is null"), found, reps, scratch, agree), "rest")
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(rest)
    families = scratch.cut(components(edges, scratch), "families")
    # The texts of the families' representatives, each once however often its row is repeated.
    wanted = reps.select("id").join(families.select(F.col("node").alias("id")), "id", "left_semi")
    texts = d.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text").distinct()
    links = scratch.cut(confirmed(texts, families, reps.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), scratch, percent, block), "links")
    joined = components(links, scratch)
    byset = reps.select("digest", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("c"))
    out = rows.join(byset, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """docs without the rows whose document isn't its component's smallest, with links from `percent` on."""
    gone = classes(docs, percent=percent, scratch=scratch).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.m, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(c.m, n.doc_id)) AS kept FROM n LEFT JOIN c USING (doc_id)
"""
