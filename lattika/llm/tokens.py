"""Token ids of many texts by the tokenizers library, each distinct word encoded once.

A chunk of texts becomes one array of code points. Word boundaries come from character classes, as the
tokenizer's own pattern sets them; words get 64-bit polynomial hashes from prefix sums; only words not
seen before reach the library. Texts with characters for which that isn't known to be the same (letters
beyond U+024F, combining marks, apostrophes, control characters) go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD, BYTE = "word", "byte"
LIMIT, SPACE, BREAK, LETTER, NUMBER, OTHER, END, FOREIGN = 0x250, 0, 1, 2, 3, 4, 5, 6
CHUNK, CACHED = 1 << 20, 1_000_000
"""Characters a chunk, and words that a worker keeps."""
BASE = 0x9E3779B97F4A7C15


def classes() -> np.ndarray:
    """The class of each code point below LIMIT; 0 marks the end of a text."""
    out = np.full(LIMIT + 1, FOREIGN, np.uint8)
    for c in range(0x21, LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER if kind in "PS" else FOREIGN
        if len(chr(c).lower()) != 1:
            out[c] = FOREIGN
    out[ord("'")] = FOREIGN  # contractions
    out[0], out[ord(" ")], out[ord("\n")] = END, SPACE, BREAK
    return out


CLASS = classes()
CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, LIMIT + 1, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to 0, 1, ... and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        both = [np.full(size, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        _powers[:] = both
    return _powers[0], _powers[1]


def word_spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the lower-case tokenizer: runs of letters, single digits, runs of other signs; white space goes."""
    turn = np.empty(len(kind), bool)
    turn[0], turn[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start = np.flatnonzero(turn)
    end = np.append(start[1:], len(kind))
    real = (kind[start] >= LETTER) & (kind[start] <= OTHER)
    return start[real], end[real]


def byte_spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the byte-level tokenizer: runs of letters, numbers or other signs, each with one space before it; the rest of white space."""
    merged = np.where(kind == BREAK, SPACE, kind)
    turn = np.empty(len(kind), bool)
    turn[0], turn[1:] = True, merged[1:] != merged[:-1]
    start = np.flatnonzero(turn)
    end = np.append(start[1:], len(kind))
    what = merged[start]
    # White space before a word: its last character goes to the word if it is a space, else stands alone.
    before = np.flatnonzero((what[:-1] == SPACE) & (what[1:] != END))
    joined = before[kind[end[before] - 1] == SPACE]
    alone = before[(kind[end[before] - 1] == BREAK) & (end[before] - start[before] > 1)]
    end[joined] -= 1
    start[joined + 1] -= 1
    last = end[alone] - 1
    end[alone] -= 1
    start, end = np.concatenate([start, last]), np.concatenate([end, last + 1])
    real = (end > start) & (kind[np.minimum(start, len(kind) - 1)] != END)
    start, end = start[real], end[real]
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


class Encoder:
    """Encodes lists of texts with a tokenizer file; keeps the ids of words it has seen."""

    def __init__(self, path: str, scheme: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.scheme = scheme
        self.clear()

    def clear(self) -> None:
        # Sorted hashes of the words seen, and the slot of each: 16 bytes a word.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat, self.filled = np.zeros(1 << 18, np.uint32), 0

    def learn(self, words: list[str]) -> None:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        ids = [x.ids for x in found]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        while len(self.start) < self.used + len(ids):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        total = int(n.sum())
        while len(self.flat) < self.filled + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[self.used : self.used + len(ids)] = self.filled + np.cumsum(n) - n
        self.size[self.used : self.used + len(ids)] = n
        self.flat[self.filled : self.filled + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self.used, self.filled = self.used + len(ids), self.filled + total

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        out: list[np.ndarray] = []
        part: list[str] = []
        room = CHUNK
        for t in texts:
            if part and len(t) + 1 > room:
                out += self.chunk(part)
                part, room = [], CHUNK
            part.append(t)
            room -= len(t) + 1
        return out + (self.chunk(part) if part else [])

    def chunk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), LIMIT)
        kind = CLASS[points]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(lengths) - lengths
        strange = kind == FOREIGN
        ends = kind == END
        if strange.any() or int(ends.sum()) != len(texts):
            strange |= ends
            strange[first + lengths - 1] = False
            odd = set(np.searchsorted(first, np.flatnonzero(strange), "right") - 1)
            rest = iter(self.chunk([t for k, t in enumerate(texts) if k not in odd]) if len(odd) < len(texts) else [])
            return [self.whole(t) if k in odd else next(rest) for k, t in enumerate(texts)]
        if self.scheme == WORD:
            joined = joined.lower()
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            points = np.minimum(points, LIMIT)
            start, end = word_spans(kind)
        else:
            start, end = byte_spans(kind)
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(CODE[points] * up[: len(points)], out=sums[1:])
        hashes = (sums[end] - sums[start]) * down[start]
        known, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.used + len(known) > CACHED:
            self.clear()
        place = np.searchsorted(self.keys, known)
        seen = place < len(self.keys)
        seen[seen] = self.keys[place[seen]] == known[seen]
        slots = np.empty(len(known), np.int64)
        slots[seen] = self.slots[place[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            a, b = start[where[new]].tolist(), end[where[new]].tolist()
            slots[new] = np.arange(self.used, self.used + len(new))
            self.learn([joined[x:y] for x, y in zip(a, b, strict=True)])
            self.keys, self.slots = np.insert(self.keys, place[new], known[new]), np.insert(self.slots, place[new], slots[new])
        at = slots[back]
        n = self.size[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
        cut = total[np.searchsorted(start, np.append(first, len(points)))]
        return [ids[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, scheme: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, scheme) not in _encoders:
        _encoders[path, scheme] = Encoder(path, scheme)
    return _encoders[path, scheme]
