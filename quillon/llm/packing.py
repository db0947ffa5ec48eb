"""Sequence packing by minimum bin slack.

Each document's ids (with an end id) are cut into whole windows of the capacity and one remainder. Remainders are held
as counts by length. For each window the longest waiting remainder is placed, then a bitset dynamic programme over the
other lengths (multiplicities in binary parts) finds the reachable sum closest to the capacity, and backtracking tells
how many remainders of each length fill it; the same filling is repeated while the counts last. A partition packs its
own remainders, at most PIECES at a time, so there is no shuffle and no group grows with the data; what a last window
lacks is cut into powers of two, which need no padding, by cutting its last piece freely.

Null text: empty, one piece with the end id alone. Null id: kept null in the pieces. Repeated rows: packed once each.
Extra columns are not read. Empty table: no piece. A sequence id is the partition's number and a running number, so it is
unique, and the same when a task over the same input runs again.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Remainders that are packed together at most.
PIECES = 100_000
#: Waiting ids that are packed together at most (4 bytes each).
WEIGHT = 12_000_000
#: A window this close to full is padded rather than cut into powers of two.
SLACK = 32
#: Chunks whose ids a worker keeps.
CACHE = 500_000


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each sum up closest to the capacity, not beyond; the longest length goes first."""
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    reach, mask = 1, (1 << (room + 1)) - 1
    parts: list[tuple[int, int, int]] = []  # bitset before, length, how many
    for n in lengths:
        left = counts[n] - (n == first)
        take = 1
        while left > 0 and n * min(take, left) <= room:
            k = min(take, left)
            parts.append((reach, n, k))
            reach |= (reach << (n * k)) & mask
            left -= k
            take *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for before, n, k in reversed(parts):
        if not before >> at & 1:
            used[n] += k
            at -= n * k
    return dict(used)


def min_bin_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until no length is left."""
    counts = {n: c for n, c in counts.items() if c}
    while counts:
        used = fill(counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        yield used, times


_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:"]] = True
_WORD_END = np.zeros(256, bool)
_WORD_END[[*range(48, 58), *range(97, 123)]] = True


def chunks_of(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space free chunks of lower-cased texts: starts, ends, and each document's first (one more at the end). One
    sign of punctuation after an ASCII letter or digit, or a letter of U+00C0 to U+00FF, at a word's end is a token of
    its own and a chunk of its own here, so that "word", "word," and "Word." share one."""
    w = T.words(low, offsets)
    n = w.ends - w.starts
    e = w.ends - 1
    a, b = low[np.maximum(e - 1, 0)], low[np.maximum(e - 2, 0)]
    latin = (n >= 3) & (b == 0xC3) & (a != 0x97) & (a != 0xB7)
    cut = (n >= 2) & _TAIL[low[e]] & (_WORD_END[a] | latin) if len(n) else np.zeros(0, bool)
    at = np.cumsum(1 + cut) - 1 - cut
    starts, ends = np.empty(len(n) + int(cut.sum()), np.int64), np.empty(len(n) + int(cut.sum()), np.int64)
    starts[at], ends[at] = w.starts, w.ends - cut
    starts[at[cut] + 1], ends[at[cut] + 1] = e[cut], w.ends[cut]
    return starts, ends, np.append(at, len(starts))[w.first]


class Encoder:
    """Ids of whole texts from the library, kept by white-space free chunk: no token of this vocabulary spans white
    space, and it lower-cases. New chunks that are plain Latin words go to the library many in one string, as each ends
    with the one symbol that carries the word end."""

    WORDS = 512

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.starts, self.used = np.empty(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        plain = np.array([t.isalpha() and max(t) < "\u0250" and t.lower().isalpha() for t in texts], bool)
        order = np.argsort(~plain, kind="stable")
        n = int(plain.sum())
        words = [texts[i] for i in order[:n]]
        ids, sizes = [], []
        groups = [words[i : i + self.WORDS] for i in range(0, n, self.WORDS)]
        for g, found in zip(groups, self.encoded([" ".join(g) for g in groups])):
            found = np.array(found, np.int32)
            cut = np.flatnonzero(self.ends[found]) + 1
            if len(cut) == len(g):
                ids.append(found)
                sizes.append(np.diff(cut, prepend=0))
            else:
                for one in self.encoded(g):
                    ids.append(np.array(one, np.int32))
                    sizes.append(np.array([len(one)]))
        for one in self.encoded([texts[i] for i in order[n:]]):
            ids.append(np.array(one, np.int32))
            sizes.append(np.array([len(one)]))
        new, size = np.concatenate(ids), np.concatenate(sizes)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + 2 * len(new), np.int32)])
        self.flat[self.used : self.used + len(new)] = new
        first = len(self.starts) - 1
        self.at.update(zip([chunks[i] for i in order], range(first, first + len(chunks))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(size)])
        self.used += len(new)

    def known(self, chunks: list[bytes]) -> np.ndarray:
        """Entries of distinct chunks."""
        fresh = [c for c in chunks if c not in self.at]
        if len(self.at) + len(fresh) > self.cache:
            self.clear()
            fresh = chunks
        if fresh:
            self.learn(fresh)
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, s: T.Slice) -> Iterator[np.ndarray]:
        """Ids of each document of a slice."""
        raw = s.data.tobytes()
        low = s.data if b"<|" in raw else T.LOWER[s.data]  # the special tokens' strings are matched before lower-casing
        starts, ends, first = chunks_of(low, s.offsets)
        raw = low.tobytes()
        _, at, inverse = np.unique(T.span_hashes(low, starts, ends, 3), return_index=True, return_inverse=True)
        size = ends - starts
        if (size != size[at][inverse]).any() or not T.same_bytes(low, starts, starts[at][inverse], size):  # hashes that met by chance
            _, at, inverse = np.unique(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], object), return_index=True, return_inverse=True)
        i = self.known([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])[inverse]
        size = self.starts[i + 1] - self.starts[i]
        ids = self.flat[T.ragged(self.starts[i], size)]
        bound = np.concatenate([[0], np.cumsum(size)])[first]
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            yield ids[a:b]


@lru_cache(1)
def encoder(path: str, cache: int) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path, cache)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. cache: chunks whose ids a
    worker keeps, some 150 bytes each; more than that are encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, cache)
        waiting: dict[int, list] = defaultdict(list)  # remainders by length: id, start, length, ids, tokens of the document
        out: list[tuple] = []
        held = 0
        task = TaskContext.get()
        numbers = count((task.partitionId() if task else 0) << 40)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for used, times in min_bin_slack({n: len(v) for n, v in waiting.items()}, capacity):
                for _ in range(times):
                    pieces = [waiting[n].pop() for n, k in sorted(used.items(), reverse=True) for _ in range(k)]
                    yield from place(pieces)
            waiting.clear()
            held = 0

        def place(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            total = sum(p[2] for p in pieces)
            if capacity - total <= SLACK:
                sizes = [total]
            else:
                sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
            seq, offset, room = next(numbers), 0, sizes.pop(0)
            for doc, start, length, ids, tokens in pieces:
                done = 0
                while done < length:
                    if offset == room:
                        seq, offset, room = next(numbers), 0, sizes.pop(0)
                    n = min(length - done, room - offset)
                    out.append((doc, start + done, n, zlib.crc32(ids[4 * done : 4 * (done + n)]), tokens, seq, offset))
                    done += n
                    offset += n
            if len(out) >= 20_000:
                yield emit()

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out))
            ids = pa.array([None if i == T.NULL_ID else i for i in cols[0]], pa.int64())
            batch = pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[1:])], [f.split()[0] for f in SCHEMA.split(", ")])
            out.clear()
            return batch

        weight = 0
        for s in T.slices(batches, "id", "text", 1 << 20):
            for doc, ids in zip(s.ids.tolist(), enc.encode(s)):
                raw = np.append(ids, np.int32(end_id)).astype("<u4").tobytes()
                tokens = len(raw) // 4
                for start in range(0, tokens - tokens % capacity, capacity):
                    out.append((doc, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), tokens, next(numbers), 0))
                if rest := tokens % capacity:
                    waiting[rest].append((doc, tokens - rest, rest, raw[4 * (tokens - rest) :], tokens))
                    held += 1
                    weight += rest
                if len(out) >= 20_000:
                    yield emit()
                if held >= PIECES or weight >= WEIGHT:
                    yield from flush()
                    weight = 0
        yield from flush()
        if out:
            yield emit()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
