import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattika.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 300), st.integers(1, 8), st.integers(1, 4))
def test_round_trip(raw, frame, laced, blocks):
    payload = m.pad(raw)
    stored = m.write_samples(payload, frame=frame, laced=laced, blocks=blocks)
    media = m.Media(stored)
    assert media.payload(stored) == payload
    assert len(media.cues) == media.clusters
    for _, _, at in media.cues:
        assert stored[at : at + 4] == m.CLUSTER.to_bytes(4, "big")
    assert [p[1] for p in media.packets] == sorted(p[1] for p in media.packets)


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING])
def test_uneven_laces(kind):
    frames = [b"a" * 3, b"b" * 700, b"c" * 255, b"d" * 0, b"e" * 12]
    body = m.vint(1) + (5).to_bytes(2, "big") + bytes([m.kind_bits(kind)]) + m.lace(frames, kind)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body) + m.uint(m.BLOCK_DURATION, 50) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    cluster = m.uint(m.TIMESTAMP, 100) + group
    # Segment and cluster of unknown size, a void element between, and cues behind.
    segment = bytes.fromhex("1f43b675") + b"\x01" + b"\xff" * 7 + cluster + m.element(m.CUES, b"")
    stored = m.element(m.EBML, b"") + m.element(m.VOID, b"xx") + bytes.fromhex("18538067") + b"\xff" + segment
    media = m.Media(stored)
    assert [stored[p[2] : p[2] + p[3]] for p in media.packets] == frames
    assert [p[1] for p in media.packets] == [(105 + 10 * k) * 1_000_000 for k in range(5)]
    assert not any(p[4] for p in media.packets)


@pytest.mark.parametrize("bad", [b"", b"\x00\x01", b"\x1a\x45\xdf\xa3\x84", m.element(m.EBML, b""), m.element(m.SEGMENT, b"\x1f\x43\xb6\x75\x90")])
def test_malformed(bad):
    with pytest.raises(m.Malformed):
        m.Media(bad)


def test_query_rows(spark):
    long = "ß" * 50_000
    rows = [(1, None, "x"), (2, "", "y"), (3, "a" * 64, "z"), (4, long, "z"), (4, long, "z"), (None, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(m.digest(m.store(docs)).collect(), key=str)
    assert len(got) == 6
    for r in got:
        text = next(t or "" for k, t, _ in rows if k == r["doc_id"])
        padded = m.pad(text.encode())
        assert r["n_bytes"] == len(text.encode()) and r["payload_bytes"] == len(padded) and len(padded) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert m.digest(m.store(docs.limit(0))).count() == 0
    table = m.packets(m.store(docs).unionByName(spark.createDataFrame([(9, 0, None)], "doc_id long, n_bytes long, media binary")), "doc_id")
    assert table.filter("key = 9").first()["error"] is not None
    assert table.filter("key = 3").agg({"size": "sum"}).first()[0] == 64


def test_numbers_beyond_64_bits_are_an_error(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    raw = bytearray(m.store(docs).first()["media"])
    # The first cluster's timestamp, padded to eight bytes of ones.
    at = raw.index(bytes.fromhex("1f43b675"))
    assert m.Media(bytes(raw)).packets
    stamp = raw.index(0xE7, at)
    size = raw[stamp + 1] & 0x7F
    big = bytes([0xE7, 0x88]) + b"\xff" * 8
    head = raw[: at + 4] + bytes([0x01]) + b"\xff" * 7  # a cluster of unknown size takes the longer stamp
    width = 9 - raw[at + 4].bit_length()
    bad = head + big + raw[stamp + 2 + size :] if stamp == at + 4 + width else None
    assert bad is not None
    files = spark.createDataFrame([(1, bytes(raw)), (2, bytes(bad))], "doc_id long, media binary")
    got = m.packets(files, "doc_id").collect()
    assert [r["error"] for r in got if r["key"] == 1] == [None] * len([r for r in got if r["key"] == 1])
    assert [r["error"] is not None for r in got if r["key"] == 2] == [True]
