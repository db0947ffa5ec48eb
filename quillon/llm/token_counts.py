"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice of documents that no earlier slice has shown are held together as ragged numpy arrays of symbol
ids. In each round every sequence finds its lowest-ranked adjacent pair and all sequences apply theirs at once, at all
of its places from the left; a sequence without a mergeable pair is finished. Since each merge of the vocabulary makes
a symbol of its own, no pair that a merge creates can rank before it, so the rounds reproduce one-at-a-time merging.
The surviving symbols are the count. No shuffle: a narrow Arrow pass over the documents.

Null text: empty, 0 tokens. Null id: kept as null. Repeated rows: one result each. Extra columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Chunks whose counts a worker keeps; when full it starts anew, which costs time, not results.
CACHE = 500_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class RankMerger:
    """Counts tokens of white-space free chunks under a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + suffix, -1) for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make one symbol: simultaneous merging would not be exact")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(merges)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cache: dict[bytes, int] = {}

    def pretokens(self, text: str) -> tuple[int, list[bytes]]:
        """Special tokens found as such, and the pre-tokens of the rest."""
        found, out = 0, []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                found += 1
            elif part:
                if not part.isascii():
                    part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                else:
                    part = part.lower()
                out += [p.encode() for p in self.pieces.findall(part)]
        return found, out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], self.none), self.made[at]

    def survivors(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        counts = lengths.copy()
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths)
        sym[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        while len(sym) > 1:
            same = owner[1:] == owner[:-1]
            rank, made = self.ranks(sym[:-1], sym[1:])
            rank[~same] = self.none
            begin = T.distinct_runs(owner)
            best = np.minimum.reduceat(np.append(rank, self.none), begin)
            size = np.diff(np.append(begin, len(owner)))
            hit = (rank < self.none) & (rank == np.repeat(best, size)[:-1])
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # Pairs of two equal symbols overlap in runs; the leftmost goes first, so every second one of a run stays.
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            live = np.repeat(best < self.none, size)
            np.subtract.at(counts, owner[at], 1)
            keep &= live  # finished sequences leave the arrays
            sym, owner = sym[keep], owner[keep]
        return counts

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.cache) + len(chunks) > CACHE:
            self.cache.clear()
        chunks = list(chunks)
        base, owner, tokens = [], [], []
        for i, c in enumerate(chunks):
            found, pre = self.pretokens(c.decode())
            base.append(found)
            owner += [i] * len(pre)
            tokens += pre
        total = np.array(base, np.int64)
        if tokens:
            np.add.at(total, np.array(owner), self.survivors(tokens))
        self.cache.update(zip(chunks, total.tolist()))

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        fresh = set().union(*split) - self.cache.keys() if split else set()
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = set().union(*split)
        if fresh:
            self.learn(fresh)
        get = self.cache.__getitem__
        return [sum(map(get, w)) for w in split]


@lru_cache(1)
def merger(path: str) -> RankMerger:
    """One merger for all tasks of a worker process."""
    return RankMerger(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = merger(tokenizer_path).counts
        for s in T.slices(batches, "id", "text", 1 << 20):
            n = np.array(counts([s.text(i) for i in range(len(s.ids))]), np.int64)
            yield pa.RecordBatch.from_arrays([s.batch.column("id"), pa.array(np.diff(s.offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
