"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on slices of an Arrow string column as raw UTF-8 bytes with numpy, a few megabytes at a time, so
a Python worker's memory depends on the slice size and the longest single text, never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Word separators of every contract: space and the bytes 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z only; bytes of multi-byte characters are 0x80 and above and stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Stands for a null id inside the operators; it sorts before every other id.
NULL_ID = -(2**63)
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_STEP, _LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xA0761D6478BD642F)
#: Keeps the first n of 8 little-endian bytes.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Longer spans go to the library one by one.
LONG = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of the bytes data[s:e] of each span: eight bytes at a time are folded in and mixed, so unlike spans
    of up to 8 bytes and one length never collide; spans longer than LONG are hashed by xxh3."""
    size = ends - starts
    out = mix64(size.astype(U64) * _STEP + U64(salt))
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # 8 bytes from every place
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix64((out[live] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _LEFT)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), salt)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two sequences one after another from their hashes."""
    return mix64((a * _LEFT + mix64(b * _RIGHT + _STEP)) ^ U64(0x2545F4914F6CDD1D))


def window_hashes(codes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive codes, as a tree of mixed pairs; windows across documents are for the caller to mask."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    span, level, out, done = 1, mix64(codes + mix64(np.array([salt], U64))), None, 0
    while True:
        if k & span:
            part = level[done : done + n]
            out, done = part if out is None else _joined(out, part), done + span
        if 2 * span > k:
            return mix64(out + U64(k * int(_STEP) % 2**64))
        level = _joined(level[: len(level) - span], level[span:])
        span *= 2


def sequence_hash(codes: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of all codes as one window."""
    return window_hashes(codes, len(codes), salt)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit xxh3 of each whole text."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], U64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a:a+size] equals data[b:b+size] for every pair of spans."""
    other = a != b
    return bool((data[ragged(a[other], size[other])] == data[ragged(b[other], size[other])]).all())


class Slice(NamedTuple):
    """Some rows: their batch, where they lie in it, ids, and texts as one byte array with offsets."""

    batch: pa.RecordBatch
    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, max_bytes: int = SLICE_BYTES, lower: bool = False) -> Iterator[Slice]:
    """Cuts Arrow batches into slices of about max_bytes of text; null texts are empty, null ids NULL_ID. lower: texts
    in lower case by Unicode's simple rules."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(text_col).cast(pa.large_string()), "")
        ids = np.asarray(pc.fill_null(batch.column(id_col).cast(pa.int64()), NULL_ID))
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            j = min(j, len(ids))
            if lower:
                part = pc.utf8_lower(texts.slice(i, j - i))
                ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                raw = part.buffers()[2]
                chars = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
                yield Slice(batch.slice(i, j - i), ids[i:j], chars[ends[0] : ends[-1]], ends - ends[0])
            else:
                yield Slice(batch.slice(i, j - i), ids[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j


class Words(NamedTuple):
    """Words of a slice: byte spans, and for each document the index of its first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return Words(z, z, np.zeros(len(offsets), np.int64))
    blank = IS_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a document ends before this byte
    edge[offsets] = True
    start = ~blank
    start[1:] &= blank[:-1] | edge[1:-1]
    end = ~blank
    end[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets, "left"))


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over the first n window starts: the k words lie in one document."""
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last


def distinct_runs(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each run of equal sorted keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., starts[1], ...: the indices of all spans one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return np.ascontiguousarray(x).view(np.int64)
