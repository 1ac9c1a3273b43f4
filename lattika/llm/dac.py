"""Token files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, and
a bitmap that says whether the id goes on in level k + 1; its place there is the number of set bits before
it, from a rank directory of one count per 512 bits. So id i of a file is read with one or two ranged reads
per level and no block is decoded.

A file holds, all little-endian: the magic, the numbers of documents, ids and levels, the doc_ids with a
null flag each, the documents' first ids, then per level chunks, bitmap words and rank counts. Files are
named by partition and number, hold ascending doc_ids, and are moved into place when whole, so that a
task's second attempt writes the same file again.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_parts, shuffle_partitions, task_number
from .tokens import BYTE, encoder

MAGIC, HEAD, BLOCK = b"LDAC0001", 4, 512
END_ID, FILE_IDS = 2, 1 << 23
"""The id behind every document; ids a file at most, but for one longer document."""


# ---- the code


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, rank counts) of each level."""
    out, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        words = np.packbits(np.concatenate([more, np.zeros(-len(more) % 64, bool)]), bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        per_block = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK // 64)) if len(counts) else counts
        out.append((left.astype(np.uint8), words, (np.cumsum(per_block) - per_block).astype("<u8")))
        if not more.any():
            return out
        left = left[more] >> 8


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file's bytes."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    levels = levels_of(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    parts = [MAGIC, np.array([len(ids), sizes.sum(), len(levels), 0], "<u8").tobytes()]
    parts += [np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes()]
    parts.append(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
    parts.append(np.array([len(x[0]) for x in levels], "<u8").tobytes())
    for chunks, words, ranks in levels:
        parts += [chunks.tobytes(), words.tobytes(), ranks.tobytes()]
    return b"".join(parts)


@dataclass
class Level:
    chunks: int
    bits: int
    ranks: int
    n: int


class Reader:
    """A token file behind a function read(offset, length) -> bytes."""

    def __init__(self, read):
        self.read = read
        head = read(0, 8 + 8 * HEAD)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, n_levels, _ = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        at = 8 + 8 * HEAD
        self.doc_ids = np.frombuffer(read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.nulls = np.frombuffer(read(at, self.n_docs), np.uint8).astype(bool)
        at += self.n_docs
        self.first = np.frombuffer(read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        sizes = [int(x) for x in np.frombuffer(read(at, 8 * n_levels), "<u8")]
        at += 8 * n_levels
        self.levels: list[Level] = []
        for n in sizes:
            words = -(-n // 64)
            self.levels.append(Level(at, at + n, at + n + 8 * words, n))
            at += n + 8 * words + 8 * (-(-words * 64 // BLOCK))

    def rank(self, level: Level, i: int) -> int:
        """Set bits of the level's bitmap before bit i."""
        block = i // BLOCK
        if block * BLOCK >= level.n:
            block = max(0, (level.n - 1) // BLOCK)
        before = int(np.frombuffer(self.read(level.ranks + 8 * block, 8), "<u8")[0]) if level.n else 0
        first = block * BLOCK // 64
        words = np.frombuffer(self.read(level.bits + 8 * first, 8 * (-(-i // 64) - first)), "<u8").copy() if i > first * 64 else np.zeros(0, np.uint64)
        if i % 64 and len(words):
            words[-1] &= np.uint64((1 << i % 64) - 1)
        return before + int(np.bitwise_count(words).sum())

    def get(self, i: int) -> int:
        """Id i of the file, by random access."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= self.read(level.chunks + i, 1)[0] << 8 * k
            if not self.read(level.bits + i // 8, 1)[0] >> i % 8 & 1:
                return value
            i = self.rank(level, i)
        raise ValueError("an id goes on behind the last level")

    def range(self, a: int, b: int, k: int = 0) -> np.ndarray:
        """Ids a to b: on each level the ones that go on are neighbours too."""
        level = self.levels[k]
        out = np.frombuffer(self.read(level.chunks + a, b - a), np.uint8).astype(np.uint32)
        raw = np.frombuffer(self.read(level.bits + a // 8, -(-b // 8) - a // 8), np.uint8)
        more = np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if more.any():
            at = self.rank(level, a)
            out[more] |= self.range(at, at + int(more.sum()), k + 1) << np.uint32(8)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.first[k]), int(self.first[k + 1]))


# ---- the files


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri, and the folder's path there."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def put(fs: pafs.FileSystem, path: str, body: bytes) -> None:
    hidden = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        f.write(body)
    fs.move(hidden, path)


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every whole text in ascending order of the key; returns (part, number, path, n_docs, n_ids) of each file.

    A null text counts as empty; a null key comes first; a long text may fill a file of its own; repeated rows are
    written each, in the order of their texts' hashes; other columns are ignored. The list of files is a table
    beside them, written by the tasks: the driver doesn't see it. An empty table writes no file.
    """

    def shard(batches):
        fs, base = store_of(folder)
        fs.create_dir(base, recursive=True)
        enc, number, part = encoder(tokenizer, BYTE), 0, task_number()
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        end = np.array([END_ID], np.uint32)

        def flush():
            nonlocal number
            path = f"{base}/part-{part:06d}-{number:04d}.dac"
            put(fs, path, pack(keys, ids))
            line = pa.record_batch([pa.array([x]) for x in (part, number, path, len(keys), sum(map(len, ids)))], names=["part", "number", "path", "n_docs", "n_ids"])
            keys.clear()
            ids.clear()
            number += 1
            return line

        filled = 0
        for piece in in_parts(batches):
            keys_now, texts = (c.to_pylist() for c in piece.columns)
            for k, x in zip(keys_now, enc.encode([t or "" for t in texts]), strict=True):
                if keys and filled + len(x) + 1 > file_ids:
                    yield flush()
                    filled = 0
                keys.append(k)
                ids.append(np.concatenate([x, end]))
                filled += len(x) + 1
        if keys:
            yield flush()

    spark = docs.sparkSession
    d = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).withColumn("h", F.xxhash64("t"))
    d = d.repartitionByRange(shuffle_partitions(spark), "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    lines = d.mapInArrow(shard, "part long, number long, path string, n_docs long, n_ids long")
    lines.write.parquet(f"{folder}/_files")
    return spark.read.schema(lines.schema).parquet(f"{folder}/_files")


def placed(files: DataFrame) -> DataFrame:
    """(path, start): each file's first id's number. Parts are summed first; a window runs over parts, one line each, and one over each part's files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One line per writing task: as many as shuffle partitions, so it may be broadcast.
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inside", inside).join(F.broadcast(before), "part").select("path", (F.col("base") + F.col("inside")).alias("start"))


def read(folder: str, files: DataFrame, span: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; about `span` ids are in memory at once."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def one(fs, path: str, start: int):
        with fs.open_input_file(path) as f:
            r = Reader(lambda offset, length: f.read_at(length, offset))
            a = 0
            while a < r.n_docs:
                b = max(a + 1, int(np.searchsorted(r.first, r.first[a] + span, "right")) - 1)
                low = int(r.first[a])
                ids = r.range(low, int(r.first[b])).astype("<u4")
                crc = [zlib.crc32(ids[int(x) - low : int(y) - low].tobytes()) for x, y in zip(r.first[a:b], r.first[a + 1 : b + 1], strict=True)]
                yield pa.record_batch([pa.array(r.doc_ids[a:b], pa.int64(), mask=r.nulls[a:b]), pa.array(start + r.first[a:b]), pa.array(np.diff(r.first[a : b + 1])), pa.array(crc, pa.int64())], schema=schema)
                a = b

    def scan(batches):
        fs, _ = store_of(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from one(fs, path, start)

    # Files are about equally large, so tasks get as many each.
    dealt = placed(files).repartition(shuffle_partitions(files.sparkSession), "path")
    return dealt.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, scratch: Scratch | None = None) -> DataFrame:
    """Writes the table's token files below the shared folder and reads them back."""
    scratch = scratch or Scratch(docs.sparkSession, "dac")
    folder = scratch.path("tokens")
    return read(folder, write(docs, folder, tokenizer))
