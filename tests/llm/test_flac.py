import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweft.llm import flac

TEXTS = ["", None, "a" * 576, "b" * 577, "Grüße\nan alle " * 300, "x", "\x00" * 2000, "".join(chr(32 + (i * i) % 90) for i in range(5000))]


def brute(text):
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // 576)) * 576
    return raw + b"\xff" * (size - len(raw))


def test_round_trip_and_digest(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id long, text string")
    stored = flac.flac_encode(docs)
    rows = {r.doc_id: r for r in flac.flac_digest(stored).collect()}
    for i, t in enumerate(TEXTS + TEXTS[:3]):
        want = brute(t)
        assert rows[i].n_bytes == len((t or "").encode())
        assert rows[i].payload_bytes == len(want)
        assert rows[i].payload_sha256 == hashlib.sha256(want).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(want[-32:])
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert media[0] == media[1] == media[len(TEXTS)] and rows[0].media_sha256 == hashlib.sha256(media[0]).hexdigest()
    blocks = flac.flac_blocks(stored).filter("doc_id = 4").orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [576 * i for i in range(len(blocks))]
    assert b"".join(bytes(b.pcm) for b in blocks) == brute(TEXTS[4])
    assert flac.seek(media[4], 1000, 700) == brute(TEXTS[4])[1000:1700]


def test_extra_columns_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, "hi", "mine", 7)], "doc_id long, text string, media string, n_bytes int")
    assert flac.flac_encode(docs).columns == ["doc_id", "n_bytes", "media"]
    assert flac.flac_digest(flac.flac_encode(docs.limit(0))).count() == 0
    wide = docs.withColumn("media2", F.lit(3))
    assert flac.flac_encode(wide).first().media2 == 3


def test_noise_uses_verbatim_and_streams_without_seek_table():
    rng = np.random.default_rng(3)
    raw = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (5, 600, 4000)] + [b"even text " * 400]
    out, first, _ = flac.payloads(pa.array(raw, pa.binary()))
    streams = flac.encode_payloads(out, first)
    assert (flac.decode_streams(pa.array(streams, pa.binary()))[0] == out).all()
    bare = []
    for s in streams:
        n = int.from_bytes(s[43:46], "big")
        bare.append(s[:4] + b"\x80" + s[5:42] + s[46 + n :])
    assert (flac.decode_streams(pa.array(bare, pa.binary()))[0] == out).all()


def test_damage_is_noticed():
    out, first, _ = flac.payloads(pa.array([b"some words in a row " * 100], pa.binary()))
    good = flac.encode_payloads(out, first)[0]
    for at in (len(good) - 50, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="FLAC"):
            flac.decode_streams(pa.array([bytes(bad)], pa.binary()))


def test_every_fixed_and_partitioned_form_is_decoded():
    """A bit-level writer of its own makes frames that the encoder never writes."""
    rng = np.random.default_rng(5)
    x = np.clip(np.cumsum(rng.integers(-3, 4, 576)), -100, 100)

    def frame(order, po, wide, escape):
        bits = []

        def put(v, n):
            bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))

        put((8 + order) << 1, 8)
        for v in x[:order]:
            put(int(v) & 255, 8)
        res = np.diff(x, n=order) if order else x
        put(wide, 2)
        put(po, 4)
        at = 0
        for part in range(1 << po):
            n = (576 >> po) - (order if part == 0 else 0)
            if escape and part % 2:
                put((32 if wide else 16) - 1, 4 + wide)
                put(11, 5)
                for v in res[at : at + n]:
                    put(int(v) & 2047, 11)
            else:
                put(1, 4 + wide)
                for v in res[at : at + n]:
                    z = (int(v) << 1) ^ (int(v) >> 63)
                    bits.extend([0] * (z >> 1))
                    put(1, 1)
                    put(z & 1, 1)
            at += n
        bits.extend([0] * (-len(bits) % 8))
        body = flac._frame_header(0) + np.packbits(bits).tobytes()
        raw = np.frombuffer(body, np.uint8)
        crc = int(flac._crc16(raw, np.array([0]), np.array([len(raw)]))[0])
        return body + crc.to_bytes(2, "big")

    for order in range(5):
        for po, wide, escape in ((0, 0, 0), (2, 1, 0), (4, 0, 1), (3, 1, 1)):
            data = np.frombuffer(frame(order, po, wide, escape), np.uint8)
            got, number, end = flac.decode_frames(data, np.array([0]))
            assert (got[0] == x).all() and end[0] == len(data) and number[0] == 0


def test_null_ids_and_very_long_texts(spark):
    text = "a long text é " * 150_000
    docs = spark.createDataFrame([(None, text, "x"), (None, None, "x"), (1, text, "x")], "doc_id long, text string, media string")
    rows = flac.flac_digest(flac.flac_encode(docs)).collect()
    payload = text.encode() + b"\xff" * (-len(text.encode()) % 576)
    want = hashlib.sha256(payload).hexdigest()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256 == want) for r in rows) == [(0, 0, False), (0, len(text.encode()), True), (1, len(text.encode()), True)]
