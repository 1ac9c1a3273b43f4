import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from lattika.llm import dac, packing  # noqa: E402
from lattika.llm.tokens import BYTE, WORD, encoder  # noqa: E402

FILES = {WORD: "word_bpe_49k.json", BYTE: "byte_bpe_50k.json"}
ALPHABET = st.text(st.sampled_from(list("abzABZ éÉß12 \n\n  .,!-'\t")) | st.characters(codec="utf-8", max_codepoint=0x3000), max_size=60)


@pytest.mark.parametrize("scheme", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=6))
def test_encoder_is_the_library(scheme, texts):
    e = encoder(public_tokenizers.path(FILES[scheme]), scheme)
    got = e.encode(texts)
    assert [x.tolist() for x in got] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("high", [2, 256, 70_000, 1 << 32])
def test_random_access(high):
    rng = np.random.default_rng(high)
    ids = [rng.integers(0, high, n).astype(np.uint32) for n in [0, 1, 700, 64, 513, *rng.integers(0, 300, 20)]]
    raw = dac.pack([*range(len(ids) - 1), None], ids)
    r = dac.Reader(lambda a, n: raw[a : a + n])
    flat = np.concatenate(ids)
    assert [r.document(k).tolist() for k in range(len(ids))] == [x.tolist() for x in ids]
    assert all(r.get(i) == flat[i] for i in range(len(flat)))
    assert r.nulls[-1] and not r.nulls[:-1].any()
    with pytest.raises(IndexError):
        r.get(len(flat))


def expected(rows, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(k, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for k, x in rows]


ROWS = [(5, "the cat  sat"), (1, None), (2, ""), (3, "Word " * 9000), (7, "ÀÉ it's\n\nfine"), (None, "lost"), (5, "the cat  sat")]


def test_files(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, start string, n_tokens int")
    got = dac.round_trip(docs, public_tokenizers.path(FILES[BYTE])).orderBy("start").collect()
    want = sorted(expected(ROWS, FILES[BYTE]), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (k, ids) in zip(got, want, strict=True):
        assert tuple(r) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert dac.round_trip(docs.limit(0), public_tokenizers.path(FILES[BYTE])).count() == 0


def test_small_files_hold_all(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (k % 7)) for k in range(60)], "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    files = dac.write(docs, folder, public_tokenizers.path(FILES[BYTE]), file_ids=20)
    assert files.count() > 8
    got = dac.read(folder, files, span=7).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(60))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80))
def test_packer_loses_nothing(sizes):
    p, window = packing.Packer(10, 32), 32
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype=np.uint32) + k)
    p.finish()
    docs, sequences = {}, {}
    for doc, start, ids, n, sequence, offset in p.take():
        assert n == sizes[doc]
        docs.setdefault(doc, []).append((start, ids))
        sequences.setdefault(sequence, []).append((offset, len(ids)))
    assert set(docs) == set(range(len(sizes)))
    for k, parts in docs.items():
        whole = np.concatenate([i for _, i in sorted(parts, key=lambda x: x[0])])
        assert whole.tolist() == (np.arange(sizes[k]) + k).tolist()
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at < window and at & (at - 1) == 0


def test_placement_is_sum_of_squares():
    rng = np.random.default_rng(3)
    p = packing.Packer(0, 12)
    count = [0] * 13
    for k, s in enumerate(rng.integers(1, 12, 400).tolist()):
        options = {}
        for h in range(12 - s + 1):
            if h and not count[h]:
                continue
            after = count.copy()
            if h:
                after[h] -= 1
            if h + s < 12:
                after[h + s] += 1
            options[h] = sum(x * x for x in after)
        best = min(options.values())
        p.add(k, np.zeros(s, np.uint32))
        h = max(h for h, v in options.items() if v == best)
        count[h] -= h > 0
        count[h + s] += h + s < 12
        assert p.count.tolist() == count


def test_pieces(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, offset string").coalesce(1)
    got = packing.digest(packing.pack(docs, public_tokenizers.path(FILES[WORD]))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for k, ids in expected([r for r in ROWS if r[0] != 5], FILES[WORD]):
        at = 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(docs.limit(0), public_tokenizers.path(FILES[WORD])).count() == 0


def test_most_windows_are_filled_by_placement():
    rng = np.random.default_rng(5)
    p = packing.Packer()
    for k, n in enumerate(rng.integers(1, 2048, 20_000).tolist()):
        p.add(k, np.zeros(n, np.uint32))
    placed = len({r[4] for r in p.take()})
    p.finish()
    assert placed > 0.9 * (placed + len({r[4] for r in p.take()}))


def test_pieces_with_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "word " * (k * 40_000), "s", 1.5, b"x", 7) for k in (1, 2)], "doc_id long, text string, start string, length double, ids binary, sequence_id long")
    got = packing.pack(docs, public_tokenizers.path(FILES[WORD])).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {1: 40_001, 2: 80_001}
    assert sum(r["length"] for r in got) == 120_002 and all(len(r["ids"]) == 4 * r["length"] for r in got)
