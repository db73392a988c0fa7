"""FLAC media columns: store bytes as 8-bit PCM in FLAC streams and read them back, in batches of frames.

A payload byte b is the signed sample b - 128.  Streams are plain FLAC: STREAMINFO,
a SEEKTABLE with one point per frame, and frames of 576 samples whose subframes are
constant, fixed-predictor, linear-predictor (LPC) or verbatim, with partitioned Rice
residuals.  Every frame carries CRC-8 (header) and CRC-16 (frame); STREAMINFO carries
the MD5 of the samples.  Decoding verifies all three and raises on a mismatch.

The kernels run over all frames of a batch at once: sample i of every frame is
decoded in one numpy step, so the interpreter's cost is per step, not per sample.
The decoder also reads partition orders above 0, 5-bit Rice parameters, escaped
partitions and streams without a seek table (mono, 8 bits, fixed block size).

Edge cases: null and empty texts are one block of padding; equal texts give equal
streams wherever they are encoded; further columns pass through ``flac_encode``
unless they clash with its outputs, which replace them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweft.llm.textvec import flat, slices

BLOCK = 576
RATE = 8000
PAD = 255
_LPC_ORDER, _LPC_PRECISION, _LPC_SHIFT = 2, 8, 6


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & mask
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
#: Coefficients of the fixed predictors of orders 0 to 4 (fixed values of the format).
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_ZEROS16 = np.full(1 << 16, 16, dtype=np.uint64)
for _q in range(15, -1, -1):
    _ZEROS16[1 << (15 - _q) : 1 << (16 - _q)] = _q


def _crc16(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte spans; shorter spans wait, as leading zeros leave a zero CRC unchanged."""
    crc = np.zeros(len(start), dtype=np.int64)
    longest = int((end - start).max(initial=0))
    for back in range(longest, 0, -1):
        at = end - back
        byte = np.where(at >= start, buf[np.maximum(at, 0)], 0)
        crc = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ byte]
    return crc


def _coded_number(n: int) -> bytes:
    """FLAC's extended UTF-8 form of a frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room >>= 1
    return bytes([((~room << 1) & 0xFF) | n, *reversed(tail)])


def _frame_header(number: int) -> bytes:
    head = b"\xff\xf8\x20\x02" + _coded_number(number)
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    return head + bytes([crc])


def _predicted(x: np.ndarray) -> list[tuple[int, int, list[int], int, np.ndarray]]:
    """Candidates for all frames: (subframe type, order, coefficients, shift, residual)."""
    out, diff = [], x
    for order in (0, 1, 2):
        out.append((8 + order, order, _FIXED[order], 0, diff[:, order:] if order == 0 else diff))
        diff = diff[:, 1:] - diff[:, :-1]
    return out


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised order-2 coefficients of every frame by least squares on its autocorrelation, and residuals."""
    r0, r1, r2 = ((x[:, lag:].astype(np.float64) * x[:, : BLOCK - lag]).sum(axis=1) for lag in (0, 1, 2))
    det = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    a = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], axis=1)
    half = 1 << (_LPC_PRECISION - 1)
    coef = np.clip(np.rint(a * (1 << _LPC_SHIFT)), -half, half - 1).astype(np.int32)
    guess = (coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> _LPC_SHIFT
    return coef, x[:, 2:] - guess


def _rice_cost(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of each frame's residual near the one its mean suggests, and the bits it takes."""
    n = folded.shape[1]
    k0 = np.clip(np.log2(np.maximum(folded.mean(axis=1), 1)).astype(np.int64), 0, 13)
    k, best = k0, None
    for step in (0, 1):
        kk = k0 + step
        bits = (folded >> kk[:, None].astype(np.int32)).sum(axis=1) + n * (1 + kk)
        if best is None:
            best = bits
        else:
            k, best = np.where(bits < best, kk, k), np.minimum(bits, best)
    return k, best


def _encoded_bits(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join bit strings: (value, bits<=24) pairs laid out row by row into bytes; each row starts on a byte."""
    total = length.sum(axis=1)
    size = (total + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    pos = np.cumsum(length, axis=1) - length + (base[:-1] * 8)[:, None]
    word = rows.astype(np.uint64) << (np.uint64(32) - length.astype(np.uint64) - (pos & 7).astype(np.uint64))
    at = (pos >> 3).ravel()
    word = word.ravel()
    out = np.zeros(int(base[-1]) + 4, dtype=np.float64)
    for i in range(4):
        part = (word >> np.uint64(24 - 8 * i)) & np.uint64(255)
        out += np.bincount(at + i, weights=part, minlength=len(out))[: len(out)]
    return out[: base[-1]].astype(np.uint8), base


def encode_frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """FLAC frames of an (n, 576) matrix of signed 8-bit samples with the given frame numbers."""
    n = len(x)
    x = x.astype(np.int32)
    tried = []
    for kind, order, coefs, shift, res in _predicted(x):
        folded = (res << 1) ^ (res >> 31)
        k, bits = _rice_cost(folded)
        tried.append((bits + 8 * order, kind, order, folded, k, None))
    coef, res = _lpc(x)
    folded = (res << 1) ^ (res >> 31)
    k, bits = _rice_cost(folded)
    tried.append((bits + 8 * _LPC_ORDER + 9 + _LPC_ORDER * _LPC_PRECISION, 32 + _LPC_ORDER - 1, _LPC_ORDER, folded, k, coef))
    cost = np.stack([t[0] for t in tried])
    widest = np.stack([(t[3] >> t[4][:, None].astype(np.int32)).max(axis=1) + t[4] + 1 for t in tried])
    cost = np.where(widest > 24, 1 << 40, cost)  # codes over 24 bits aren't packed here
    choice = cost.argmin(axis=0)
    choice = np.where((x == x[:, :1]).all(axis=1), -1, np.where(cost.min(axis=0) >= 8 * BLOCK, -2, choice))
    body: list[bytes] = [b""] * n
    for i in np.unique(choice):
        rows = np.flatnonzero(choice == i)
        if i == -1:
            for r in rows:
                body[r] = bytes([0, int(x[r, 0]) & 255])
            continue
        if i == -2:
            for r in rows:
                body[r] = b"\x02" + (x[r] & 255).astype(np.uint8).tobytes()
            continue
        _, kind, order, folded, k, coef = tried[i]
        m, k = len(rows), k[rows][:, None]
        v = folded[rows]
        head_v = [np.full((m, 1), kind << 1)]
        head_n = [8]
        for j in range(order):
            head_v.append((x[rows, j] & 255)[:, None])
            head_n.append(8)
        if coef is not None:
            head_v += [np.full((m, 1), _LPC_PRECISION - 1), np.full((m, 1), _LPC_SHIFT)]
            head_n += [4, 5]
            for j in range(order):
                head_v.append((coef[rows, j] & ((1 << _LPC_PRECISION) - 1))[:, None])
                head_n.append(_LPC_PRECISION)
        head_v += [np.full((m, 1), 0), k]  # Rice coding with 4-bit parameters, partition order 0
        head_n += [6, 4]
        value = np.concatenate([*head_v, (1 << k) | (v & ((1 << k) - 1))], axis=1)
        length = np.concatenate([np.broadcast_to(np.array(head_n), (m, len(head_n))), (v >> k) + 1 + k], axis=1)
        packed, base = _encoded_bits(value, length)
        packed = packed.tobytes()
        for j, r in enumerate(rows):
            body[r] = packed[base[j] : base[j + 1]]
    heads = {int(f): _frame_header(int(f)) for f in np.unique(number)}
    frames = [heads[int(f)] + b for f, b in zip(number, body, strict=True)]
    size = np.array([len(f) for f in frames])
    end = np.cumsum(size)
    crc = _crc16(np.frombuffer(b"".join(frames), np.uint8), end - size, end)
    return [f + struct.pack(">H", c) for f, c in zip(frames, crc.tolist(), strict=True)]


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded payload bytes of a batch, each document's first block, and unpadded sizes."""
    data, offs = flat(texts)
    size = np.diff(offs)
    blocks = np.maximum(1, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.full(int(first[-1]) * BLOCK, PAD, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offs[:-1], size)] = data
    return out, first, size


def encode_payloads(out: np.ndarray, first: np.ndarray) -> list[bytes]:
    """One FLAC stream for each document of the padded payload."""
    number = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    signed = (out.astype(np.int16) - 128).astype(np.int8)
    frames = encode_frames(signed.reshape(-1, BLOCK), number)
    streams = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = frames[a:b]
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | ((b - a) * BLOCK)).to_bytes(8, "big")
        info += hashlib.md5(signed[a * BLOCK : b * BLOCK].tobytes()).digest()
        at, points = 0, []
        for i, n in enumerate(sizes):
            points.append(struct.pack(">QQH", i * BLOCK, at, BLOCK))
            at += n
        table = b"".join(points)
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return streams


def _windows(buf: np.ndarray) -> np.ndarray:
    """The 64 bits that start at each byte."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf) + 8, dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(out)]
    return out


def _bits(win: np.ndarray, p: np.ndarray, n: np.ndarray | int, signed: bool = False) -> np.ndarray:
    """n (1 to 32) bits at bit position p of each lane."""
    w = win[p >> 3] << (p & 7).astype(np.uint64)
    v = (w >> (np.uint64(64) - np.asarray(n, dtype=np.uint64))).astype(np.int64)
    return np.where(v >> (np.asarray(n) - 1) & 1, v - (np.int64(1) << np.asarray(n, dtype=np.int64)), v) if signed else v


def _residual(win: np.ndarray, p: np.ndarray, order: int, wide: int, po: int, out: np.ndarray) -> np.ndarray:
    """Decode the partitioned Rice residual of lanes with one layout into rows order.. of ``out``; returns end positions."""
    k = np.zeros(len(p), dtype=np.uint64)
    raw = np.zeros(len(p), dtype=np.int64)
    per = BLOCK >> po
    one, top = np.uint64(1), np.uint64(48)
    for i in range(order, BLOCK):
        if i == order or i % per == 0:
            k = _bits(win, p, 4 + wide).astype(np.uint64)
            p = p + 4 + wide
            escape = k == (31 if wide else 15)
            raw = np.where(escape, _bits(win, p, 5), 0)
            p = np.where(escape, p + 5, p)
            plain, room = not escape.any(), np.uint64(63) - k
            step = k.astype(np.int64) + 1
        w, p0 = win[p >> 3] << (p & 7).astype(np.uint64), p
        q = _ZEROS16[w >> top]
        if (q == 16).any():
            more = q == 16
            while more.any():
                p = np.where(more, p + 16, p)
                w = np.where(more, win[p >> 3] << (p & 7).astype(np.uint64), w)
                z = _ZEROS16[w >> top]
                q = np.where(more, q + z, q)
                more &= z == 16
            seen = q % np.uint64(16)
        else:
            seen = q
        v = (q << k) | ((w << (seen + one) >> one) >> room)
        v = (v >> one).astype(np.int64) ^ -(v & one).astype(np.int64)
        if plain:
            out[i] = v
            p = p + seen.astype(np.int64) + step
        else:
            direct = np.where(raw > 0, _bits(win, p0, np.maximum(raw, 1), signed=True), 0)
            out[i] = np.where(escape, direct, v)
            p = np.where(escape, p0 + raw, p + seen.astype(np.int64) + step)
    return p


def decode_frames(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decode the frames that start at the given bytes: samples (n, 576), frame numbers, end bytes.

    Verifies sync, header CRC-8 and frame CRC-16 of every frame.
    """
    win = _windows(buf)
    buf = np.concatenate([buf, np.zeros(16, np.uint8)])
    if not (_bits(win, start * 8, 16) == 0xFFF8).all():
        raise ValueError("FLAC: no frame where the seek table has one")
    if not ((buf[start + 2] >> 4 == 2) & (buf[start + 3] >> 1 & 7 == 1) & (buf[start + 3] >> 4 == 0)).all():
        raise ValueError("FLAC: only mono frames of 576 8-bit samples are read")
    lead = buf[start + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    number = np.where(extra == 0, lead, lead & (0x3F >> np.maximum(extra, 1)))
    for i in range(1, 6):
        number = np.where(extra >= i, (number << 6) | (buf[start + 4 + i] & 0x3F), number)
    rate = buf[start + 2] & 15
    at = start + 5 + extra + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    crc = np.zeros(len(start), dtype=np.int64)
    for i in range(int((at - start).max(initial=0))):
        crc = np.where(start + i < at, _CRC8[crc ^ buf[np.minimum(start + i, at)]], crc)
    if not (crc == buf[at]).all():
        raise ValueError("FLAC: header CRC-8 mismatch")
    p = (at + 1) * 8
    kind = _bits(win, p, 8) >> 1
    if (_bits(win, p, 8) & 1).any():
        raise ValueError("FLAC: wasted bits are not read")
    p = p + 8
    x = np.zeros((BLOCK, len(start)), dtype=np.int64)
    end = np.zeros(len(start), dtype=np.int64)
    for t in np.unique(kind).tolist():
        lanes = np.flatnonzero(kind == t)
        pos = p[lanes]
        if t == 0:
            x[:, lanes] = _bits(win, pos, 8, signed=True)
            end[lanes] = pos + 8
            continue
        if t == 1:
            for i in range(BLOCK):
                x[i, lanes] = _bits(win, pos + 8 * i, 8, signed=True)
            end[lanes] = pos + 8 * BLOCK
            continue
        order = t - 8 if 8 <= t <= 12 else t - 31 if t >= 32 else -1
        if order < 0:
            raise ValueError("FLAC: reserved subframe type")
        own = np.zeros((BLOCK, len(lanes)), dtype=np.int64)
        for i in range(order):
            own[i] = _bits(win, pos, 8, signed=True)
            pos = pos + 8
        if t >= 32:
            precision = _bits(win, pos, 4) + 1
            shift = _bits(win, pos + 4, 5, signed=True)
            pos = pos + 9
            coefs = []
            for _ in range(order):
                coefs.append(_bits(win, pos, precision, signed=True))
                pos = pos + precision
        else:
            coefs, shift = [np.full(len(lanes), c) for c in _FIXED[order]], np.zeros(len(lanes), dtype=np.int64)
        layout = _bits(win, pos, 6)
        for form in np.unique(layout).tolist():
            some = np.flatnonzero(layout == form)
            res = own[:, some]
            end[lanes[some]] = _residual(win, pos[some] + 6, order, form >> 4, form & 15, res)
            own[:, some] = res
        if order:
            for i in range(order, BLOCK):
                guess = coefs[0] * own[i - 1]
                for j in range(1, order):
                    guess += coefs[j] * own[i - 1 - j]
                own[i] += guess >> shift
        x[:, lanes] = own
    stop = -(-end // 8)
    if not (_crc16(buf, start, stop) == _bits(win, stop * 8, 16)).all():
        raise ValueError("FLAC: frame CRC-16 mismatch")
    return x.T, number, stop + 2


def _meta(stream: memoryview) -> tuple[int, bytes, int, np.ndarray | None]:
    """Total samples, MD5, first frame byte and the frames' offsets (None without a full seek table)."""
    if bytes(stream[:4]) != b"fLaC":
        raise ValueError("FLAC: no stream marker")
    at, total, md5, points = 4, 0, b"", None
    while True:
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, last = stream[at + 4 : at + 4 + size], stream[at] >> 7
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), bytes(body[18:34])
        elif kind == 3:
            table = np.frombuffer(body, dtype=[("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
            table = table[table["sample"] != 2**64 - 1]
            if (table["sample"] == np.arange(len(table)) * BLOCK).all():
                points = table["at"].astype(np.int64)
        at += 4 + size
        if last:
            break
    return total, md5, at, points if points is not None and len(points) * BLOCK == total else None


def decode_streams(media: pa.Array, verify_md5: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes of a batch of FLAC streams, and each stream's first block."""
    data, offs = flat(media)
    view = memoryview(np.ascontiguousarray(data))
    metas = [_meta(view[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    blocks = np.array([m[0] // BLOCK for m in metas], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros((int(first[-1]), BLOCK), dtype=np.int64)
    seek = [i for i, m in enumerate(metas) if m[3] is not None]
    if seek:
        start = np.concatenate([offs[i] + metas[i][2] + metas[i][3] for i in seek])
        to = np.concatenate([np.arange(first[i], first[i + 1]) for i in seek])
        x, number, _ = decode_frames(data, start)
        if not (number == np.concatenate([np.arange(blocks[i]) for i in seek])).all():
            raise ValueError("FLAC: frame numbers out of order")
        out[to] = x
    rest = np.array([i for i, m in enumerate(metas) if m[3] is None], dtype=np.int64)
    at = np.array([offs[i] + metas[i][2] for i in rest], dtype=np.int64)
    done = 0
    while len(rest):
        live = blocks[rest] > done
        rest, at = rest[live], at[live]
        if len(rest):
            x, _, at = decode_frames(data, at)
            out[first[rest] + done] = x
            done += 1
    signed = out.astype(np.int8)
    if verify_md5:
        for i, m in enumerate(metas):
            if hashlib.md5(signed[first[i] : first[i + 1]].tobytes()).digest() != m[1]:
                raise ValueError("FLAC: MD5 mismatch")
    return (out + 128).astype(np.uint8).ravel(), first


def flac_encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``media`` (its FLAC stream) and ``n_bytes`` in place of the text column."""
    kept = [c for c in docs.columns if c not in (text, "media", "n_bytes")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out, first, size = payloads(part.column(text))
                streams = encode_payloads(out, first) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(size, pa.int64()), pa.array(streams, pa.binary())], [*kept, "n_bytes", "media"])

    return docs.select(*kept, docs[text].cast("string").alias(text)).mapInArrow(encode, schema)


def flac_blocks(stored: DataFrame, id_column: str = "doc_id", media: str = "media") -> DataFrame:
    """PCM blocks of stored streams: (id, block, sample_offset, pcm) with 576 samples each."""
    schema = T.StructType([stored.schema[id_column], T.StructField("block", T.LongType()), T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                raw, first = decode_streams(part.column(media))
                block = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
                ids = part.column(id_column).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(first))))
                pcm = [raw[i : i + BLOCK].tobytes() for i in range(0, len(raw), BLOCK)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(block), pa.array(block * BLOCK), pa.array(pcm, pa.binary())], schema.names)

    return stored.select(id_column, media).mapInArrow(decode, schema)


def seek(stream: bytes, sample: int, n: int) -> bytes:
    """Payload bytes [sample, sample + n) of one stream, decoding only the frames that hold them."""
    data = np.frombuffer(stream, np.uint8)
    total, _, at, points = _meta(memoryview(stream))
    if points is None:
        return decode_streams(pa.array([stream], pa.binary()))[0][sample : sample + n].tobytes()
    lo, hi = sample // BLOCK, -(-min(total, sample + n) // BLOCK)
    if hi <= lo:
        return b""
    x, _, _ = decode_frames(data, at + points[lo:hi])
    return (x.ravel() + 128).astype(np.uint8)[sample - lo * BLOCK :][:n].tobytes()


def _features(raw: np.ndarray, first: np.ndarray) -> list[str]:
    """Integer sample statistics of each stream: mean, mean energy, zero crossings and peak."""
    at, n = first[:-1] * BLOCK, np.diff(first) * BLOCK
    x = raw.astype(np.int64) - 128
    total, energy = np.add.reduceat(x, at), np.add.reduceat(x * x, at)
    cross = np.zeros(len(x), dtype=np.int64)
    cross[1:] = (x[1:] < 0) != (x[:-1] < 0)
    cross[at] = 0
    crossings, peak = np.add.reduceat(cross, at), np.maximum.reduceat(np.abs(x), at)
    return [f"mean={1000 * a // k};energy={b // k};crossings={c};peak={d}" for a, b, c, d, k in zip(total.tolist(), energy.tolist(), crossings.tolist(), peak.tolist(), n.tolist(), strict=True)]


def flac_digest(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Read stored streams back (verifying them) and give digests and features of what was read."""
    schema = T.StructType(
        [
            stored.schema[id_column],
            *(T.StructField(c, T.LongType()) for c in ("n_bytes", "payload_bytes")),
            T.StructField("payload_sha256", T.StringType()),
            *(T.StructField(c, T.LongType()) for c in ("tail_crc32", "media_bytes")),
            *(T.StructField(c, T.StringType()) for c in ("media_sha256", "feature")),
        ]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                raw, first = decode_streams(part.column("media"))
                whole = [raw[a:b].tobytes() for a, b in zip((first[:-1] * BLOCK).tolist(), (first[1:] * BLOCK).tolist(), strict=True)]
                media = part.column("media").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_column),
                        part.column("n_bytes"),
                        pa.array([len(x) for x in whole], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in whole], pa.string()),
                        pa.array([zlib.crc32(x[-32:]) for x in whole], pa.int64()),
                        pa.array([len(x) for x in media], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                        pa.array(_features(raw, first) if whole else [], pa.string()),
                    ],
                    schema.names,
                )

    return stored.select(id_column, "n_bytes", "media").mapInArrow(digest, schema)
