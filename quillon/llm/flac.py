"""FLAC columns: payloads as 8-bit mono streams, written and read with numpy.

Writing cuts a payload into frames of BLOCK samples. Each frame takes the cheapest of a constant, the fixed polynomial
predictors of order 0 to 4, a quantised linear predictor (Levinson-Durbin on the frame's autocorrelation) and verbatim
samples; residuals are Rice coded with one parameter. Every frame ends with a CRC-16, its header with a CRC-8, the
stream opens with STREAMINFO (with the MD5 of the samples) and a SEEKTABLE of one point per frame.

Reading checks every header's CRC-8 and frame's CRC-16, decodes the Rice residuals of all frames of a slice in lockstep
(one numpy step per sample position over all frames), runs the linear predictors the same way, and checks the MD5.
Frames of other encoders (several Rice partitions, escaped residuals, wasted bits, other sample sizes, two and more
channels) are decoded one by one. PCM blocks carry the offset of their first sample. No shuffle: narrow passes; a payload
never leaves its row.

Null payloads are empty; an empty one is padded to one unit. Equal payloads give equal streams. Extra columns are not
read. A stream whose checksums fail raises an error that names the check.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

BLOCK = 1024
RATE = 8000
#: Samples that are coded together; bounds a worker's memory unless one payload is larger.
GROUP = 1 << 20
LPC_ORDER, LPC_BITS = 4, 10
#: Coefficients of the format's fixed predictors, nearest sample first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of the format's CRC-8 (x^8+x^2+x+1) and CRC-16 (x^16+x^15+x^2+1)."""
    t8, t16 = np.arange(256, dtype=np.uint32), np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t8 = ((t8 << 1) ^ np.where(t8 & 0x80, 0x07, 0)) & 0xFF
        t16 = ((t16 << 1) ^ np.where(t16 & 0x8000, 0x8005, 0)) & 0xFFFF
    return t8.astype(np.uint8), t16.astype(np.uint16)


CRC8, CRC16 = _crc_tables()
_far = [CRC16]


def _crc16_at(n: int) -> np.ndarray:
    """Row d: what a byte adds to the CRC when d bytes follow it."""
    rows = _far[0].reshape(-1, 256)
    if len(rows) < n:
        out = np.empty((n, 256), np.uint16)
        out[: len(rows)] = rows
        for d in range(len(rows), n):
            out[d] = (out[d - 1] << 8) ^ CRC16[out[d - 1] >> 8]
        _far[0] = rows = out
    return rows


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each non-empty span; spans lie one after another."""
    size = ends - starts
    table = _crc16_at(int(size.max()))
    at = T.ragged(starts, size)
    parts = table[np.repeat(ends, size) - 1 - at, data[at]]
    return np.bitwise_xor.reduceat(parts, np.cumsum(size) - size)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _utf8(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            break
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *reversed(tail)])


def _header(n: int, number: int) -> bytes:
    h = bytes([0xFF, 0xF8, 0x74, 0x02]) + _utf8(number) + (n - 1).to_bytes(2, "big")  # 8 kHz, mono, 8 bits
    return h + bytes([crc8(h)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 63)


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors (frames x order, nearest first) and shifts, by Levinson-Durbin over all frames at once."""
    f = x.astype(np.float64)
    n = f.shape[1]
    r = np.stack([(f[:, k:] * f[:, : n - k]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    r[:, 0] += 1e-9 + 1e-6 * np.abs(r[:, 0])
    a = np.zeros((len(f), LPC_ORDER))
    err = r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, 1 : i + 1][:, ::-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    limit = (1 << (LPC_BITS - 1)) - 1
    shift = np.clip(np.floor(np.log2(limit / top)), 0, 15).astype(np.int64)
    q = np.clip(np.round(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64)
    return q, shift


def _rice_size(u: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter and bits of each frame's residual."""
    v = u[:, skip:]
    costs = np.stack([(v >> k).sum(1) + v.shape[1] * (k + 1) for k in range(9)], 1)
    k = costs.argmin(1)
    return k, costs[np.arange(len(k)), k]


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def _frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Coded frames of equal length; x: frames x samples."""
    m, n = x.shape
    plans = []  # bits, order, rice parameter, zigzag residual
    for order, c in enumerate(FIXED):
        r = x.copy()
        for j, w in enumerate(c):
            r[:, order:] -= w * x[:, order - 1 - j : n - 1 - j]
        u = _zigzag(r)
        k, cost = _rice_size(u, order)
        plans.append((cost + 8 * order + 10, k, u))
    q, shift = _lpc(x)
    pred = np.zeros((m, n - LPC_ORDER), np.int64)
    for j in range(LPC_ORDER):
        pred += q[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    r = x.copy()
    r[:, LPC_ORDER:] -= pred >> shift[:, None]
    u = _zigzag(r)
    k, cost = _rice_size(u, LPC_ORDER)
    plans.append((cost + LPC_ORDER * (8 + LPC_BITS) + 19, k, u))
    sizes = np.stack([p[0] for p in plans] + [np.full(m, 8 * n)], 1)
    choice = sizes.argmin(1)
    same = (x == x[:, :1]).all(1)
    out: list[bytes] = [b""] * m
    for kind in np.unique(choice[~same]).tolist():
        rows = np.flatnonzero((choice == kind) & ~same)
        if kind == 6:
            for i in rows:
                out[i] = bytes([0x02]) + x[i].astype(np.int8).tobytes()
            continue
        order = kind if kind < 5 else LPC_ORDER
        _, k, u = (p[rows] for p in plans[kind])
        raw, v = x[rows, :order] & 0xFF, u[:, order:]
        quot, low = v >> k[:, None], v & ((1 << k[:, None]) - 1)
        head = 8 + 8 * order + (0 if kind < 5 else 9 + LPC_BITS * order) + 10
        step = quot + 1 + k[:, None]
        end = head + step.sum(1)
        size = -(-end // 8)  # bytes
        base = np.cumsum(size * 8) - size * 8
        bits = np.zeros(int(size.sum()) * 8, np.uint8)
        _put(bits, base, np.full(len(rows), (0x10 | 2 * order) if kind < 5 else (0x40 | 2 * (order - 1))), 8)
        at = base + 8
        for j in range(order):
            _put(bits, at, raw[:, j], 8)
            at = at + 8
        if kind == 5:
            _put(bits, at, np.full(len(rows), LPC_BITS - 1), 4)
            _put(bits, at + 4, shift[rows], 5)
            at = at + 9
            for j in range(order):
                _put(bits, at, q[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
                at = at + LPC_BITS
        _put(bits, at, np.zeros(len(rows), np.int64), 6)
        _put(bits, at + 6, k, 4)
        at = at + 10
        stop = (at[:, None] + np.cumsum(step, 1) - 1 - k[:, None])
        bits[stop.ravel()] = 1
        for b in range(int(k.max())):
            has = k > b  # bit b of the remainder lies k - b places after the stop bit
            bits[(stop[has] + (k[has] - b)[:, None]).ravel()] = (low[has] >> b & 1).ravel()
        packed = np.packbits(bits)
        cut = np.cumsum(size).tolist()
        for i, a, b in zip(rows, [0, *cut], cut):
            out[i] = packed[a:b].tobytes()
    for i in np.flatnonzero(same):
        out[i] = bytes([0x00, int(x[i, 0]) & 0xFF])
    bodies = [_header(n, no) + b for no, b in zip(numbers, out)]
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    crc = crc16(flat, ends - [len(b) for b in bodies], ends)
    return [b + int(c).to_bytes(2, "big") for b, c in zip(bodies, crc)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of 8-bit samples (byte - 128) for each non-empty payload."""
    pcm = [(np.frombuffer(p, np.uint8).astype(np.int16) - 128).astype(np.int64) for p in payloads]
    coded: list[dict[int, bytes]] = [{} for _ in payloads]
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, x in enumerate(pcm):
        for no, start in enumerate(range(0, len(x), BLOCK)):
            by_size.setdefault(min(BLOCK, len(x) - start), []).append((i, no))
    for n, places in by_size.items():
        for k in range(0, len(places), max(1, GROUP // (4 * n))):
            part = places[k : k + max(1, GROUP // (4 * n))]
            x = np.stack([pcm[i][no * BLOCK : no * BLOCK + n] for i, no in part])
            for (i, no), f in zip(part, _frames(x, [no for _, no in part])):
                coded[i][no] = f
    out = []
    for p, x, frames in zip(payloads, pcm, coded):
        body = [frames[no] for no in range(len(frames))]
        sizes = [len(f) for f in body]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
        at = np.cumsum([0, *sizes[:-1]])
        seek = np.zeros(len(body), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"] = np.arange(len(body)) * BLOCK
        seek["offset"], seek["n"] = at, BLOCK
        seek["n"][-1] = len(p) - (len(body) - 1) * BLOCK
        table = seek.tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(body))
    return out


class Corrupt(ValueError):
    """A checksum of a stream does not hold."""


def _read_utf8(b: bytes, i: int) -> tuple[int, int]:
    lead = b[i]
    if lead < 0x80:
        return lead, i + 1
    n = 8 - (~lead & 0xFF).bit_length()
    v = lead & ((1 << (7 - n)) - 1)
    for k in range(1, n):
        v = v << 6 | b[i + k] & 0x3F
    return v, i + n


def _parse(b: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], tuple[int, int, int]]:
    """Samples, MD5, frames as (first sample, begin, end), and (rate, channels, bits) of a stream."""
    if b[:4] != b"fLaC":
        raise Corrupt("not a FLAC stream")
    i, last, total, md5, seek, form = 4, False, 0, b"", b"", (0, 1, 8)
    while not last:
        last, kind, n = bool(b[i] & 0x80), b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        block = b[i + 4 : i + 4 + n]
        i += 4 + n
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            total, md5 = packed & (1 << 36) - 1, block[18:34]
            form = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1)
        elif kind == 3:
            seek = block
    points = np.frombuffer(seek, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
    if len(points) and int(points["n"].astype(np.int64).sum()) == total:
        at = (points["offset"].astype(np.int64) + i).tolist()
    else:  # no whole seek table: every sync code whose header's CRC-8 holds and where a frame's CRC-16 ends
        at, j = [], i
        a = np.frombuffer(b, np.uint8)
        sync = [int(k) for k in np.flatnonzero((a[:-1] == 0xFF) & ((a[1:] & 0xFE) == 0xF8)) if k >= i and _is_header(b, int(k))]
        while j < len(b):
            at.append(j)
            ends = [k for k in sync if k > j] + [len(b)]
            found = next((k for k in ends if crc16(a, np.array([j]), np.array([k - 2]))[0] == int.from_bytes(b[k - 2 : k], "big")), None)
            if found is None:
                raise Corrupt("frame CRC-16")
            j = found
    ends = [*at[1:], len(b)]
    sizes, frames, done = [], [], 0
    for s, e in zip(at, ends):
        n, _ = _frame_size(b, s)
        frames.append((done, s, e))
        sizes.append(n)
        done += n
    if total and done != total:
        raise Corrupt("sample count")
    return done, md5, frames, form


def _is_header(b: bytes, s: int) -> bool:
    try:
        _frame_size(b, s)
    except (Corrupt, IndexError):
        return False
    return True


def _frame_size(b: bytes, s: int) -> tuple[int, int]:
    """Samples of the frame at s and where its subframe begins."""
    code = b[s + 2] >> 4
    _, i = _read_utf8(b, s + 4)
    if code == 6:
        n, i = b[i] + 1, i + 1
    elif code == 7:
        n, i = int.from_bytes(b[i : i + 2], "big") + 1, i + 2
    elif code == 1:
        n = 192
    elif 2 <= code <= 5:
        n = 576 << (code - 2)
    elif code >= 8:
        n = 256 << (code - 8)
    else:
        raise Corrupt("block size")
    rate = b[s + 2] & 15
    i += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if crc8(b[s:i]) != b[i]:
        raise Corrupt("header CRC-8")
    return n, i + 1


class _Bits:
    """The bits of a frame from its subframes on."""

    def __init__(self, data: bytes):
        self.bits, self.word, self.n, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes(), int.from_bytes(data, "big"), 8 * len(data), 0

    def take(self, w: int) -> int:
        self.at += w
        if self.at > self.n:
            raise Corrupt("end of frame")
        return self.word >> (self.n - self.at) & ((1 << w) - 1)

    def signed(self, w: int) -> int:
        v = self.take(w)
        return v - (1 << w) if w and v >> (w - 1) else v

    def unary(self) -> int:
        stop = self.bits.find(1, self.at)
        if stop < 0:
            raise Corrupt("end of frame")
        n, self.at = stop - self.at, stop + 1
        return n

    def subframe(self, n: int, bits: int) -> list[int]:
        """Samples of one channel's subframe."""
        kind = self.take(7)
        wasted = self.unary() + 1 if self.take(1) else 0
        bits -= wasted
        if kind == 0:
            out = [self.signed(bits)] * n
        elif kind == 1:
            out = [self.signed(bits) for _ in range(n)]
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            out, coef, shift = [self.signed(bits) for _ in range(order)], FIXED[order] if kind < 32 else [], 0
            if kind >= 32:
                precision = self.take(4) + 1
                shift = self.signed(5)
                coef = [self.signed(precision) for _ in range(order)]
            for r in self.residual(n, order):
                out.append(r + (sum(c * x for c, x in zip(coef, reversed(out[len(out) - order :]))) >> shift))
        else:
            raise Corrupt("subframe type")
        return [x << wasted for x in out]

    def residual(self, n: int, order: int) -> list[int]:
        method, parts = self.take(2), self.take(4)
        if method > 1 or (n >> parts) < order:
            raise Corrupt("residual coding")
        width, out = 4 + method, []
        for j in range(1 << parts):
            k, count = self.take(width), (n >> parts) - (0 if j else order)
            if k == (1 << width) - 1:
                w = self.take(5)
                out += [self.signed(w) for _ in range(count)]
            else:
                for _ in range(count):
                    u = self.unary() << k | self.take(k)
                    out.append(u >> 1 ^ -(u & 1))
        return out


#: Bits of a sample by the code of a frame's header; 0: as the stream says.
_SAMPLE_BITS = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame(b: bytes, s: int, e: int, bits: int) -> np.ndarray:
    """Samples x channels of the frame at s, decoded on its own."""
    n, i = _frame_size(b, s)
    code, size = b[s + 3] >> 4, _SAMPLE_BITS.get(b[s + 3] >> 1 & 7)
    if size is None or code > 10:
        raise Corrupt("frame header")
    bits = size or bits
    data = _Bits(b[i : e - 2])
    if code < 8:
        return np.array([data.subframe(n, bits) for _ in range(code + 1)], np.int64).T
    x, y = (np.array(data.subframe(n, bits + side), np.int64) for side in ((0, 1), (1, 0), (0, 1))[code - 8])
    if code == 8:  # left, side
        return np.stack([x, x - y], 1)
    if code == 9:  # side, right
        return np.stack([x + y, y], 1)
    mid = x * 2 | y & 1
    return np.stack([(mid + y) >> 1, (mid - y) >> 1], 1)


def read_pcm(b: bytes) -> tuple[tuple[int, int, int], np.ndarray]:
    """(rate, channels, bits) and samples x channels of any stream, all checksums verified."""
    total, md5, frames, form = _parse(b)
    flat = np.frombuffer(b, np.uint8)
    for _, s, e in frames:
        if crc16(flat, np.array([s]), np.array([e - 2]))[0] != int.from_bytes(b[e - 2 : e], "big"):
            raise Corrupt("frame CRC-16")
    x = np.concatenate([np.empty((0, form[1]), np.int64), *(_frame(b, s, e, form[2]) for _, s, e in frames)])
    if md5 != bytes(16) and hashlib.md5(_pcm_bytes(x, form[2])).digest() != md5:
        raise Corrupt("MD5")
    return form, x


def _pcm_bytes(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples of whole bytes."""
    size = -(-bits // 8)
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def decode(streams: list[bytes]) -> list[bytes]:
    """Payloads of 8-bit mono streams."""
    parsed = [_parse(b) for b in streams]
    if not streams:
        return []
    if any(p[3][1:] != (1, 8) for p in parsed):
        raise Corrupt("not 8-bit mono")
    flat = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)]).tolist()
    spans = np.array([(base[k] + s, base[k] + e) for k, p in enumerate(parsed) for _, s, e in p[2]])
    crc = crc16(flat, spans[:, 0], spans[:, 1] - 2)
    if (crc != (flat[spans[:, 1] - 2].astype(np.uint16) << 8 | flat[spans[:, 1] - 1])).any():
        raise Corrupt("frame CRC-16")
    out = [np.empty(p[0], np.int64) for p in parsed]
    coded: list[tuple] = []
    for k, (b, p) in enumerate(zip(streams, parsed)):
        for first, s, e in p[2]:
            n, i = _frame_size(b, s)
            kind = b[i] >> 1
            if b[i] & 1:  # wasted bits
                out[k][first : first + n] = _frame(b, s, e, 8)[:, 0]
            elif kind == 0:
                out[k][first : first + n] = np.int8(b[i + 1] - 256 if b[i + 1] > 127 else b[i + 1])
            elif kind == 1:
                out[k][first : first + n] = np.frombuffer(b, np.int8, n, i + 1)
            elif 8 <= kind <= 12 or kind >= 32:
                order = kind - 8 if kind < 32 else kind - 31
                warm = np.frombuffer(b, np.int8, order, i + 1).astype(np.int64)
                bit = 8 * (i + 1 + order)
                word = int.from_bytes(b[i + 1 + order : i + 1 + order + 128], "big")
                total = 8 * len(b[i + 1 + order : i + 1 + order + 128])
                pos = 0

                def take(w: int) -> int:
                    nonlocal pos
                    pos += w
                    return word >> (total - pos) & ((1 << w) - 1)

                if kind < 32:
                    coef, shift = FIXED[order], 0
                else:
                    prec, shift = take(4) + 1, take(5)
                    coef = [v - (1 << prec) if v >> (prec - 1) else v for v in (take(prec) for _ in range(order))]
                method, parts = take(2), take(4)
                k_rice = take(4 if method == 0 else 5)
                if method or parts or k_rice == 15 or k_rice > 16:
                    out[k][first : first + n] = _frame(b, s, e, 8)[:, 0]
                    continue
                coded.append((k, first, 8 * base[k] + bit + pos, k_rice, order, warm, coef, shift, n, base[k] + e))
            else:
                raise Corrupt("subframe type")
    for g in range(0, len(coded), GROUP // BLOCK):
        _lockstep(flat, coded[g : g + GROUP // BLOCK], out)
    payloads = []
    for x, p in zip(out, parsed):
        raw = x.astype(np.int8)
        if p[1] != bytes(16) and hashlib.md5(raw.tobytes()).digest() != p[1]:
            raise Corrupt("MD5")
        payloads.append((raw.astype(np.int16) + 128).astype(np.uint8).tobytes())
    return payloads


def _lockstep(flat: np.ndarray, frames: list[tuple], out: list[np.ndarray]) -> None:
    """Rice residuals and predictors of many frames: one step decodes a sample of every frame that is long enough."""
    frames = sorted(frames, key=lambda f: -f[8])
    m = len(frames)
    begin, k, order, shift, n = (np.array([f[i] for f in frames], np.int64) for i in (2, 3, 4, 7, 8))
    most = max(1, int(order.max()))
    # Predictors of lower order get zero coefficients; x has rows of zeros before the first sample.
    coef, x = np.zeros((most, m), np.int64), np.zeros((most + int(n[0]), m), np.int64)
    for i, f in enumerate(frames):
        for j, c in enumerate(f[6]):
            coef[most - 1 - j, i] = c
        x[most : most + f[4], i] = f[5]
    # Bits of the group's bytes, and for each the next set one at or after it.
    lo = int(begin.min()) // 8
    hi = max(f[9] for f in frames)
    bits = np.unpackbits(flat[lo:hi])
    total = len(bits)
    nxt = np.arange(total, dtype=np.int32)
    nxt[bits == 0] = total - 1
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    packed = np.concatenate([flat[lo:hi], np.zeros(8, np.uint8)])
    word = packed[:-3].astype(np.int64) << 16 | packed[1:-2].astype(np.int64) << 8 | packed[2:-1]  # 24 bits from each byte
    at = begin - 8 * lo
    mask, down = (np.int64(1) << k) - 1, 24 - k
    for t in range(int(order.min()), int(n[0])):
        if n[m - 1] <= t:  # frames are sorted by length: the shortest are done
            m = int(np.searchsorted(-n, -t, "left"))
            at, coef = at[:m], coef[:, :m]
            k, mask, down, shift, order = k[:m], mask[:m], down[:m], shift[:m], order[:m]
        stop = nxt[at]
        tail = stop + 1
        u = (stop - at) << k | (word[tail >> 3] >> (down - (tail & 7))) & mask
        v = ((u >> 1) ^ -(u & 1)) + (np.einsum("jm,jm->m", coef, x[t : t + most, :m]) >> shift)
        if t < most:
            live = order <= t
            x[most + t, :m] = np.where(live, v, x[most + t, :m])
            at = np.where(live, tail + k, at)
        else:
            x[most + t, :m] = v
            at = tail + k
    for i, f in enumerate(frames):
        out[f[0]][f[1] : f[1] + f[8]] = x[most : most + f[8], i]


def padded(text: bytes, unit: int = 64) -> bytes:
    """text with bytes 0 up to a positive multiple of unit."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def flac_column(df: DataFrame, id_col: str, text_col: str, unit: int = 64) -> DataFrame:
    """id, n_bytes (unpadded) and the FLAC stream of each row's padded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches, "id", "text", GROUP):
            media = encode([padded(s.text(i), unit) for i in range(len(s.ids))])
            yield pa.RecordBatch.from_arrays([s.batch.column("id"), pa.array(np.diff(s.offsets)), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Rows with about GROUP bytes of media, and their decoded payloads."""
    for b in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("media")), 0)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + GROUP, "right")))
            part = b.slice(i, j - i)
            media = part.column("media").to_pylist()
            yield part, media, decode(media)
            i = j


def blocks_of(payload: bytes) -> list[tuple[int, int, int, bytes]]:
    """block, first sample, samples and PCM bytes (signed 8-bit) of each frame of a payload."""
    pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    return [(k // BLOCK, k, len(pcm[k : k + BLOCK]), pcm[k : k + BLOCK]) for k in range(0, len(pcm), BLOCK)]


def joined(blocks: list[tuple[int, int, int, bytes]]) -> bytes:
    """The payload of PCM blocks, each placed at its offset."""
    out = np.zeros(sum(b[2] for b in blocks), np.uint8)
    for _, first, n, pcm in blocks:
        out[first : first + n] = np.frombuffer(pcm, np.uint8) ^ 0x80
    return out.tobytes()


def pcm_blocks(media: DataFrame) -> DataFrame:
    """id, block, first_sample, n_samples and PCM bytes (signed 8-bit) of each frame: a seek reads one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, payloads in _groups(batches):
            rows = [(key, *b) for key, p in zip(part.column("id").to_pylist(), payloads) for b in blocks_of(p)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "block", "first_sample", "n_samples", "pcm"])

    return media.select("id", "media").mapInArrow(run, "id long, block long, first_sample long, n_samples long, pcm binary")


def feature(payload: bytes) -> str:
    """Sample count, sum, energy and zero crossings of the decoded samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};blocks={-(-len(x) // BLOCK)}"


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored streams give when read back."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams, payloads in _groups(batches):
            payloads = [joined(blocks_of(p)) for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in streams], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in streams]), pa.array([feature(p) for p in payloads]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
