"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors with equal labels are compared. Equal vectors fall together first, with their number. The rest is
rotated to principal axes, sorted by the leading coordinate and cut into tiles; tiles whose leading
coordinates lie too far apart for the threshold never meet. Tiles travel in groups of a few megabytes, so that
each is copied once per group that it meets, not per tile. In a pair of tiles, dot products grow by a few
leading dimensions at a time; what is left is bounded by the product of the suffix norms, and pairs that
can't reach the threshold any more are dropped. Those that remain are decided on the given vectors in
double precision. Link counts and a spanning part of the links leave a tile pair, never all links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_parts, least_hashes, shuffle_partitions, task_number
from .components import Union, components

COSINE, TILE, STEP, SAMPLE = 0.93, 1024, 16, 8192
"""Threshold, vectors a tile, dimensions a step, and vectors that the axes are fitted on at most (about)."""
SLACK = 1e-9
GROUP_BYTES = 1 << 22
"""Bytes of vectors in a group of tiles: two groups are in a task's memory at once."""


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, key and vec (64-bit floats) of each row; key and vec are null where the vector can't link."""
    names = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int64()), ("key", pa.binary()), ("vec", pa.binary())])

    def run(batches):
        for batch in in_parts(batches, 1024):
            keys, vecs, dims = [], [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.array([], np.float64)
                if label is not None and values.is_valid:
                    x = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                with np.errstate(over="ignore"):
                    good = len(x) > 0 and bool(np.isfinite(x).all()) and 0 < float(x @ x) < np.inf
                keys.append(hashlib.blake2b(label.encode() + b"\0" + x.tobytes(), digest_size=16).digest() if good else None)
                vecs.append(x.tobytes() if good else None)
                dims.append(len(x))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int64()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], schema=names)

    return rows.mapInArrow(run, "vec_id long, label string, dim long, key binary, vec binary")


def axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """An orthogonal basis for each of the commonest dimensions, leading axes first, from about `sample` vectors.

    Any orthogonal basis gives right results; a dimension without one here keeps its own axes.
    """
    n = vectors.count()
    part = vectors if n <= sample else vectors.filter(F.xxhash64("key") <= F.lit(least_hashes(sample / n)))
    out: dict[int, list[np.ndarray]] = {}
    for r in part.select("dim", "vec").limit(2 * sample).toLocalIterator():
        if len(out) < 16 or r["dim"] in out:
            out.setdefault(r["dim"], []).append(np.frombuffer(r["vec"], np.float64))
    basis = {}
    for dim, rows in out.items():
        x = np.stack(rows)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        _, vectors_of = np.linalg.eigh(x.T @ x)
        basis[dim] = np.ascontiguousarray(vectors_of[:, ::-1])
    return basis


TILE_NAMES = pa.schema([("tile", pa.int64()), ("label", pa.string()), ("dim", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("vecs", pa.binary())])
TILE_SCHEMA = "tile long, label string, dim long, lo double, hi double, ids binary, counts binary, keys binary, vecs binary"


def tiles(classes: DataFrame, basis: dict[int, np.ndarray], size: int = TILE) -> DataFrame:
    """Tiles of at most `size` classes (id, n, label, dim, key, vec) that are neighbours by leading coordinate."""
    lead_names = pa.schema([(n, k) for n, k in (("label", pa.string()), ("dim", pa.int64()), ("lead", pa.float64()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("vec", pa.binary()))])

    def lead(batches):
        for batch in batches:
            first = []
            for dim, vec in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x = np.frombuffer(vec, np.float64)
                axis = basis[dim][:, 0] if dim in basis else np.eye(1, dim)[0]
                first.append(float(x @ axis / np.linalg.norm(x)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(first, pa.float64()), *batch.columns[2:]], schema=lead_names)

    def cut(batches):
        part, number, rows = task_number() << 24, 0, []

        def tile():
            nonlocal number
            number += 1
            label, dim = rows[0][:2]
            cells = [part + number, label, dim, rows[0][2], rows[-1][2], np.array([r[3] for r in rows]).tobytes(), np.array([r[4] for r in rows]).tobytes(), b"".join(r[5] for r in rows), b"".join(r[6] for r in rows)]
            rows.clear()
            return pa.record_batch([pa.array([c], f.type) for c, f in zip(cells, TILE_NAMES, strict=True)], schema=TILE_NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (len(rows) >= size or row[:2] != rows[0][:2]):
                    yield tile()
                rows.append(row)
        if rows:
            yield tile()

    led = classes.select("label", "dim", "id", "n", "key", "vec").mapInArrow(lead, "label string, dim long, lead double, id long, n long, key binary, vec binary")
    led = led.repartitionByRange(shuffle_partitions(classes.sparkSession), "label", "dim", "lead", "key").sortWithinPartitions("label", "dim", "lead", "key")
    return led.mapInArrow(cut, TILE_SCHEMA)


def in_groups(all_tiles: DataFrame, size: int = TILE, room: int = GROUP_BYTES) -> DataFrame:
    """The tiles with the group that each travels in: neighbours of one partition, as many as fit the room."""
    each = F.greatest(F.lit(1), F.floor(F.lit(room) / (F.lit(8 * size) * F.col("dim"))))
    part = F.shiftright("tile", 24)
    return all_tiles.withColumn("group", F.shiftleft(part, 24) + F.floor((F.col("tile") - F.shiftleft(part, 24)) / each))


def meetings(grouped: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs of groups (label, dim, a <= b) whose leading coordinates allow the cosine: unit vectors at that cosine lie within sqrt(2 - 2 cosine)."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    width = max(reach, 1e-3)
    m = grouped.groupBy("label", "dim", "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = m.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    near = m.withColumn("cell", F.explode(F.sequence(F.floor((F.col("lo") - reach) / width), F.floor((F.col("hi") + reach) / width))))
    one, two = own.select("label", "dim", "cell", F.col("group").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), near.select("label", "dim", "cell", F.col("group").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    met = one.join(two, ["label", "dim", "cell"]).filter((F.col("la") <= F.col("hb") + reach) & (F.col("lb") <= F.col("ha") + reach))
    return met.select("label", "dim", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def reaching(x: np.ndarray, y: np.ndarray, turn: np.ndarray | None, cosine: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of x and y whose cosine is at least the threshold."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    p, q = x / nx[:, None], y / ny[:, None]
    if turn is not None:
        p, q = p @ turn, q @ turn
    dim = p.shape[1]
    rest_p = np.sqrt(np.maximum(0, np.cumsum(p[:, ::-1] ** 2, axis=1)[:, ::-1]))
    rest_q = np.sqrt(np.maximum(0, np.cumsum(q[:, ::-1] ** 2, axis=1)[:, ::-1]))
    dot, i, j = None, None, None
    for at in range(0, dim, step):
        to = min(at + step, dim)
        bound_p, bound_q = (rest_p[:, to], rest_q[:, to]) if to < dim else (np.zeros(len(p)), np.zeros(len(q)))
        if i is None:
            more = p[:, at:to] @ q[:, at:to].T
            dot = more if dot is None else dot + more
            alive = dot + bound_p[:, None] * bound_q >= cosine - SLACK
            if to == dim or np.count_nonzero(alive) * 8 < alive.size:
                i, j = np.nonzero(alive)
                dot = dot[i, j]
        else:
            dot = dot + np.einsum("kd,kd->k", p[i, at:to], q[j, at:to])
            keep = dot + bound_p[i] * bound_q[j] >= cosine - SLACK
            i, j, dot = i[keep], j[keep], dot[keep]
    good = np.empty(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        s = slice(a, a + (1 << 16))
        good[s] = np.einsum("kd,kd->k", x[i[s]], y[j[s]]) / (nx[i[s]] * ny[j[s]]) >= cosine
    return i[good], j[good]


def compared(grouped: DataFrame, pairs: DataFrame, basis: dict[int, np.ndarray], cosine: float = COSINE) -> DataFrame:
    """Per pair of tiles: (key, n) for the rows linked to each class, and (a, b) links that join what all links join."""
    names = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def met(one, two, dim: int) -> pa.RecordBatch:
        a, _, _, ids_a, n_a, keys_a, vec_a = one
        b, _, _, ids_b, n_b, keys_b, vec_b = two
        x, y = (np.frombuffer(v, np.float64).reshape(-1, dim) for v in (vec_a, vec_b))
        ids, counts = (np.frombuffer(u + (v if a != b else b""), np.int64) for u, v in ((ids_a, ids_b), (n_a, n_b)))
        keys = keys_a + (keys_b if a != b else b"")
        i, j = reaching(x, y, basis.get(dim), cosine)
        if a == b:
            up = i < j
            i, j = i[up], j[up]
        else:
            j = j + len(x)
        linked = np.zeros(len(ids), np.int64)
        np.add.at(linked, i, counts[j])
        np.add.at(linked, j, counts[i])
        union, out = Union(), []
        for u, v in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
            if union.join(u, v):
                out.append((u, v))
        some = np.flatnonzero(linked).tolist()
        columns = [[keys[16 * k : 16 * k + 16] for k in some] + [None] * len(out), linked[some].tolist() + [0] * len(out), [None] * len(some) + [o[0] for o in out], [None] * len(some) + [o[1] for o in out]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, names, strict=True)], schema=names)

    def run(batches):
        now, first = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                label, dim, a, b, group, *tile = (c[k].as_py() for c in batch.columns)
                if (label, dim, a, b) != now:
                    now, first = (label, dim, a, b), []
                # Tiles of the first group come first and stay; those of the second pass by them one at a time.
                if group == a:
                    first.append(tile)
                for other in first if a != b and group == b or a == b else []:
                    if other[1] <= tile[2] + reach and tile[1] <= other[2] + reach:
                        yield met(other, tile, dim)

    copies = pairs.select("label", "dim", F.col("a").alias("group"), "a", "b").unionByName(pairs.filter("a <> b").select("label", "dim", F.col("b").alias("group"), "a", "b"))
    rows = grouped.join(copies, ["label", "dim", "group"]).select("label", "dim", "a", "b", "group", "tile", "lo", "hi", "ids", "counts", "keys", "vecs")
    rows = rows.repartition(shuffle_partitions(grouped.sparkSession), "label", "dim", "a", "b").sortWithinPartitions("label", "dim", "a", "b", "group", "tile")
    return rows.mapInArrow(run, "key binary, n long, a long, b long")


def classes(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", scratch: Scratch | None = None, tile: int = TILE, room: int = GROUP_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows without label, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing, as do vectors of different length. Repeated rows link with each other. A row without
    vec_id takes part in counts but has no component and is kept. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    rows = scratch.cut(prepared(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))), "rows")
    own = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    own = scratch.cut(own, "classes")
    # A class of rows without vec_id still counts and links; its number lies above all ids, so it is no component's least.
    most = max(0, own.agg(F.max("id")).first()[0] or 0)
    own = own.withColumn("id", F.coalesce("id", F.lit(most) + 1 + F.pmod(F.xxhash64("key"), F.lit((1 << 63) - 2 - most))))
    basis = axes(own)
    tiled = in_groups(scratch.cut(tiles(own, basis, tile), "tiles"), tile, room)
    found = scratch.cut(compared(tiled, meetings(tiled, cosine), basis, cosine), "links")
    counts = found.filter("key is not null").groupBy("key").agg(F.sum("n").alias("linked"))
    joined = components(found.filter("key is null").select("a", "b"), scratch)
    by_class = own.select("key", "id", F.col("n").alias("copies")).join(counts, "key", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    by_class = by_class.select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id", "key").join(by_class, "key", "left")
    component = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("c", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND n > 0 AND isfinite(n)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""
