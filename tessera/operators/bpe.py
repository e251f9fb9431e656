"""Byte-level BPE: training on the distributed word table, encoding and decoding."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.batches import small
from tessera.plans.shared import discard, materialize

SPLIT = re.compile(r"[ \n\t\r]|[^ \n\t\r]+")
Merges = list[tuple[int, int]]


def word_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pieces and their counts: runs of non-space bytes; white space never merges, so it is left out."""
    return docs.select(F.explode(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n\t\r]"), lambda w: F.length(w) > 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learn(words: Iterable[tuple[str, int]], n_merges: int) -> Merges:
    """Merges of the most frequent neighbour pair each time, ties to the smallest pair; id 256 + place. Counts follow only the words a merge touches."""
    seqs, counts = [], []
    for w, n in words:
        seqs.append(list(w.encode()))
        counts.append(n)
    pairs: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = {}
    for i, s in enumerate(seqs):
        for p in zip(s, s[1:], strict=False):
            pairs[p] += counts[i]
            where.setdefault(p, set()).add(i)
    merges: Merges = []
    while len(merges) < n_merges and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 1:
            break
        new = 256 + len(merges)
        merges.append(best)
        for i in where.pop(best, set()):
            s = seqs[i]
            for p in zip(s, s[1:], strict=False):
                pairs[p] -= counts[i]
                if pairs[p] <= 0:
                    del pairs[p]
            seqs[i] = s = apply(s, best, new)
            for p in zip(s, s[1:], strict=False):
                pairs[p] += counts[i]
                where.setdefault(p, set()).add(i)
        pairs.pop(best, None)
    return merges


def apply(seq: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """seq with the pair replaced from left to right."""
    out, i = [], 0
    while i < len(seq):
        if i + 1 < len(seq) and (seq[i], seq[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


#: Words of a block: a row of the table that training counts over and over.
BLOCK = 20_000


def _marked(pieces: list[str]) -> np.ndarray:
    """The bytes of pieces without newlines as 32-bit symbols, each piece closed by -1."""
    x = np.frombuffer(("\n".join(pieces) + "\n").encode(), dtype=np.uint8).astype(np.int32)
    x[x == 10] = -1
    return x


def _blocks(words: DataFrame) -> DataFrame:
    """(flat, n): the bytes of many words as 32-bit symbols, each word closed by -1, and the words' counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, BLOCK):
            yield _block(_marked(b.column(0).to_pylist()), b.column(1).to_numpy())

    return words.mapInArrow(run, "flat binary, n binary")


def _block(flat: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())], names=["flat", "n"])


def _joined(flat: np.ndarray, pair: tuple[int, int], new: int) -> np.ndarray:
    """apply() on all words at once."""
    at = np.flatnonzero((flat[:-1] == pair[0]) & (flat[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):  # every second one of a run, from its first on
        opens = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(opens, np.diff(opens, append=len(at)))) % 2 == 0]
    flat[at] = new
    return np.delete(flat, at + 1)


def _opened(batches: Iterable[pa.RecordBatch], merges: Merges, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and counts of each block with merges applied, their ids from first on."""
    for b in batches:
        for flat, n in zip(b.column(0), b.column(1), strict=True):
            x = np.frombuffer(flat.as_py(), dtype=np.int32).copy()
            for i, pair in enumerate(merges):
                x = _joined(x, pair, first + i)
            yield x, np.frombuffer(n.as_py(), dtype=np.int64)


def _merged(blocks: DataFrame, merges: Merges, first: int) -> DataFrame:
    """Blocks with merges applied; words that are one symbol drop."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, n in _opened(batches, merges, first):
            lengths = np.diff(np.flatnonzero(x < 0), prepend=-1)
            yield _block(x[np.repeat(lengths > 2, lengths)], n[lengths > 2])

    return blocks.mapInArrow(run, "flat binary, n binary")


def _ranked(blocks: DataFrame, merges: Merges, first: int, most: int) -> list[tuple[tuple[int, int], int]]:
    """The most frequent neighbour pairs after merges, and their counts, ties by the smaller pair; the driver gets `most` rows at most."""
    size = first + len(merges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, n in _opened(batches, merges, first):
            inside = (x[:-1] >= 0) & (x[1:] >= 0)
            n = n[np.cumsum(x < 0)[:-1][inside]]  # a word's place is the number of marks before it
            pair = x[:-1][inside].astype(np.int64) * size + x[1:][inside]
            if size * size <= 1 << 20:
                added = np.bincount(pair, weights=n, minlength=1).astype(np.int64)  # whole numbers below 2 ** 53
                keys = np.flatnonzero(added)
                added = added[keys]
            else:
                keys, place = np.unique(pair, return_inverse=True)
                added = np.zeros(len(keys), dtype=np.int64)
                np.add.at(added, place, n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(added)], names=["pair", "n"])

    total = blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return [(divmod(r.pair, size), r.n) for r in total.orderBy(F.desc("n"), "pair").limit(most).collect()]


def certain(ranked: list[tuple[tuple[int, int], int]], whole: bool) -> Merges:
    """The next merges that one count of all pairs decides.

    A merge (a, b) changes only the counts of pairs that end in a or begin with b, and the pairs it makes are no more frequent than
    those were. So the following pair is next as well if all pairs that a merge before it changes are less frequent. whole tells that no pair is
    missing; else those as frequent as the last may be.
    """
    out: Merges = []
    heads: set[int] = set()
    tails: set[int] = set()
    for n, group in itertools.groupby(ranked, key=lambda x: x[1]):
        tied = [p for p, _ in group]
        for at, (a, b) in enumerate(tied):
            if out and ((n == ranked[-1][1] and not whole) or any(q[1] in heads or q[0] in tails for q in tied[at:])):
                return out
            out.append((a, b))
            heads.add(a)
            tails.add(b)
    return out


def train(docs: DataFrame, vocab_size: int, text: str = "text", most: int = 512, held: int = 8) -> Merges:
    """Merges up to a vocabulary size from the counts of all documents: those of learn(), over a word table of any size.

    The table stays in Spark. A round sums the counts of all pairs, of which the driver gets the `most` frequent, and takes all merges
    that they decide; after `held` merges the table is written with them applied.
    """
    words = materialize(_blocks(word_table(docs, text)), "words")
    merges: Merges = []
    done = 0
    while len(merges) < vocab_size - 256:
        if len(merges) - done >= held:
            last, words = words, materialize(_merged(words, merges[done:], 256 + done), "words")
            discard(last)
            done = len(merges)
        ranked = _ranked(words, merges[done:], 256 + done, most)
        if not ranked:
            break
        merges += certain(ranked, len(ranked) < most)[: vocab_size - 256 - len(merges)]
    discard(words)
    return merges


class Coder:
    """Encoding and decoding under given merges."""

    def __init__(self, merges: Merges):
        self.rank = {p: i for i, p in enumerate(merges)}
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        for a, b in merges:
            self.bytes.append(self.bytes[a] + self.bytes[b])
        self.cache: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            found = list(piece.encode())
            while len(found) > 1:
                p = min(zip(found, found[1:], strict=False), key=lambda q: self.rank.get(q, 1 << 60))
                if p not in self.rank:
                    break
                found = apply(found, p, 256 + self.rank[p])
            if len(self.cache) < 100_000:
                self.cache[piece] = found
        return found

    def together(self, pieces: list[str]) -> list[list[int]]:
        """piece() of many pieces without white space: few merges run over all of them in turn, as none can make room for one before it."""
        if len(self.rank) > 1024 or not pieces:
            return [self.piece(p) for p in pieces]
        flat = _marked(pieces)
        for pair, i in self.rank.items():
            flat = _joined(flat, pair, 256 + i)
        ids, ends = flat.tolist(), np.flatnonzero(flat < 0).tolist()
        return [ids[s:e] for s, e in zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; pieces that are new to the texts are encoded together."""
        split = [SPLIT.findall(t or "") for t in texts]
        found = {p: [ord(p)] for p in " \n\t\r"}
        new = []
        for p in {p for pieces in split for p in pieces}.difference(found):
            if (ids := self.cache.get(p)) is None:
                new.append(p)
            else:
                found[p] = ids
        encoded = dict(zip(new, self.together(new), strict=True))
        found |= encoded
        if len(self.cache) < 100_000:
            self.cache |= encoded
        return [[i for p in pieces for i in found[p]] for pieces in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def encode(docs: DataFrame, merges: Merges, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) in Arrow batches; the merges ride with the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(merges)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coder.encode_all(b.column(1).to_pylist()), pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, merges: Merges, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(merges)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} {ids.schema[key].dataType.simpleString()}, text string")
