"""Sum-of-squares online packing of documents into training sequences.

N(h) counts the open windows filled to level h. A piece of s ids goes where the sum of squared counts
grows least: into a window of level h (N(h) falls, N(h + s) rises, a full window leaves) or a new one. The
level array has one entry per fill level. Documents longer than a window fill whole windows first. At a
partition's end, what its open windows hold is merged: the emptiest give their last pieces, cut where
needed, to the fullest, until at most one is partly filled; that one is cut into sequences whose lengths are
powers of two, which need no padding. Open windows hold ids of their own partition only, so a task needs
memory for at most its partition's ids (4 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, task_number
from .tokens import WORD, encoder

WINDOW, END_ID = 4096, 2
"""Ids a sequence, and the id behind each document."""
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

Piece = tuple  # (doc, start, ids, doc_tokens)


class Packer:
    """Packs pieces one by one; `take` returns what is settled: (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first: int = 0, window: int = WINDOW):
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)  # N(h), with N(0) and N(window) held at 0
        self.open: dict[int, list[tuple[int, list[Piece]]]] = {}
        self.ready: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.close(self.sequence(), [(doc, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self.place((doc, at, ids[at:], n))

    def place(self, piece: Piece) -> None:
        s, count = len(piece[2]), self.count
        # Half the growth of the sum of squares for each level h = 0 .. window - s; level 0 opens a window.
        grow = 1 - count[: self.window - s + 1] + count[s:]
        grow[-1] = 1 - count[self.window - s]
        cost = 2 * grow
        cost[count[: self.window - s + 1] == 0] = np.iinfo(np.int64).max
        cost[-1] -= cost[-1] != np.iinfo(np.int64).max  # a window that becomes full has no count to rise: 1 - 2 N(h)
        cost[0] = 2 * count[s] + 1
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equal ones the fullest
        if h:
            same = self.open[h]
            number, pieces = same.pop()
            if not same:
                del self.open[h]
            count[h] -= 1
        else:
            number, pieces = self.sequence(), []
        pieces.append(piece)
        if h + s == self.window:
            self.close(number, pieces)
        else:
            self.open.setdefault(h + s, []).append((number, pieces))
            count[h + s] += 1

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def close(self, number: int, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.ready.append((doc, start, ids, n, number, at))
            at += len(ids)

    def settle(self) -> None:
        """Fills the fullest windows with pieces from the emptiest; at most one stays open."""
        windows = [(h, number, pieces) for h in sorted(self.open) for number, pieces in self.open[h]]
        low, high = 0, len(windows) - 1
        fill = [h for h, _, _ in windows]
        while low < high:
            gap = self.window - fill[high]
            if gap == 0:
                self.close(*windows[high][1:])
                high -= 1
                continue
            giver = windows[low][2]
            doc, start, ids, n = giver.pop()
            moved = ids[max(0, len(ids) - gap) :]
            if len(moved) < len(ids):
                giver.append((doc, start, ids[: len(ids) - len(moved)], n))
            windows[high][2].append((doc, start + len(ids) - len(moved), moved, n))
            fill[high] += len(moved)
            fill[low] -= len(moved)
            if fill[low] == 0:
                low += 1
        self.count[:] = 0
        self.open.clear()
        if windows:
            h, number, pieces = fill[high], *windows[high][1:]
            if h == self.window:
                self.close(number, pieces)
            elif h:
                self.open[h], self.count[h] = [(number, pieces)], 1

    def finish(self) -> None:
        """Settles all; the last partly filled window becomes sequences of power-of-two lengths."""
        self.settle()
        for level, windows in self.open.items():
            number, pieces = windows[0]
            for bit in reversed(range(level.bit_length())):
                if not level >> bit & 1:
                    continue
                need, own = 1 << bit, []
                while need:
                    doc, start, ids, n = pieces.pop(0)
                    own.append((doc, start, ids[:need], n))
                    if len(ids) > need:
                        pieces.insert(0, (doc, start + need, ids[need:], n))
                    need -= len(own[-1][2])
                self.close(number, own)
                number = self.sequence() if level & ((1 << bit) - 1) else number
        self.open.clear()
        self.count[:] = 0

    def take(self) -> list[tuple]:
        out, self.ready = self.ready, []
        return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    ids = [x[2].astype("<u4").tobytes() for x in rows]
    columns = [[x[0] for x in rows], [x[1] for x in rows], [len(x[2]) for x in rows], ids, [x[3] for x in rows], [x[4] for x in rows], [x[5] for x in rows]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each partition packs its rows in their order, without a shuffle; a sequence's id holds the partition's
    number above its own. A null or empty text is the end id alone; a long text fills whole windows first;
    repeated rows are packed each; of windows whose level costs the same the fullest is taken; a null key stays
    null; an empty table gives no piece; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, end = encoder(tokenizer, WORD), Packer(task_number() << 33, window), np.array([END_ID], np.uint32)
        for part in in_parts(batches):
            keys, texts = (c.to_pylist() for c in part.columns)
            for k, ids in zip(keys, enc.encode([t or "" for t in texts]), strict=True):
                packer.add(k, np.concatenate([ids, end]))
            if packer.ready:
                yield batch_of(packer.take())
        packer.finish()
        yield batch_of(packer.take())

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
