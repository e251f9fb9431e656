"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no vocabulary token can't be joined by any
merge, so a text may be cut between the two for certain: merges on either side
never meet, and the ids of the fragments, one after another, are the ids of the
whole. A table of 65,536 flags, made from the vocabulary, marks these pairs. A
text is cut at special tokens, by the tokenizer's pre-splitting pattern and then
at the forced boundaries; every fragment is encoded on its own by merges in rank
order, and fragments and short pieces are kept in bounded per-process caches.

A long fragment of n bytes takes n log n steps, so a long run without spaces costs no
more than prose. Texts with code points on which Python's and the tokenizer's
Unicode tables may differ are pre-split by the library; its encoder never runs.

Ids are little-endian unsigned 32-bit integers in a binary column. Special
tokens written in a text become their ids, as the library does by default.

Edge cases: a null text is empty and has no ids; a null id column decodes to an
empty text; ids that the vocabulary lacks decode to nothing and bytes that are
no UTF-8 to U+FFFD, as in the library; nulls in other columns, ties and repeated
rows stay as they are; an empty table gives no row; an input column with the
name of the output gives way.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm.batches import small
from tessera.llm.tokens import SAFE, byte_map, default_path, splitter

PIECES, FRAGMENTS = 500_000, 200_000
#: Longer pieces and fragments are encoded anew each time.
CACHED_BYTES = 64
#: Up to so many symbols a list is faster than a heap.
FEW = 40


class _Tokens(dict):
    """Id to bytes; unknown ids have none."""

    def __missing__(self, key: int) -> bytes:
        return b""


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        whole = Tokenizer.from_file(path)
        spec = json.loads(whole.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"no plain byte-level BPE file: {path}")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"special tokens with conditions: {path}")
        self.presplit = whole.pre_tokenizer.pre_tokenize_str
        to_byte = {c: b for b, c in byte_map().items()}
        vocab = model["vocab"]
        self.bytes = _Tokens({i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items()})
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = [vocab[c] for c in map(byte_map().__getitem__, range(256))]
        self.forced = forced_pairs(self.bytes.values())
        self.special = {t["content"]: t["id"] for t in added}
        for text, i in self.special.items():
            self.bytes[i] = bytes(map(to_byte.__getitem__, text)) if all(c in to_byte for c in text) else text.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if added else None
        self.find = splitter().findall
        self.pieces: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}

    def cuts(self, data: bytes) -> list[int]:
        """Places of the forced boundaries inside data."""
        if len(data) < CACHED_BYTES:
            forced = self.forced
            return [i for i in range(1, len(data)) if forced[data[i - 1] << 8 | data[i]]]
        codes = np.frombuffer(data, np.uint8).astype(np.int32)
        return (np.flatnonzero(np.frombuffer(self.forced, np.uint8)[codes[:-1] << 8 | codes[1:]]) + 1).tolist()

    def merged(self, data: bytes) -> bytes:
        """Ids of one fragment: the pair of lowest rank, of equal ones the leftmost, is joined until none is left."""
        ids = list(map(self.single.__getitem__, data))
        return self._few(ids) if len(ids) <= FEW else self._many(ids)

    def _few(self, ids: list[int]) -> bytes:
        """The same with the pairs of a short list looked through for each join."""
        get, none = self.merges.get, (1 << 31, 0)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((best[1], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], best[1]), none)
        return array("I", ids).tobytes()

    def _many(self, ids: list[int]) -> bytes:
        """The same with the pairs of a long list in a heap."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j == n or ids[j] != b:
                continue
            ids[i], ids[j], k = new, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def fragment(self, data: bytes) -> bytes:
        found = self.fragments.get(data)
        if found is None:
            found = self.merged(data)
            if len(self.fragments) < FRAGMENTS and len(data) <= CACHED_BYTES:
                self.fragments[data] = found
        return found

    def piece(self, text: str) -> bytes:
        """Ids of a pre-split piece, fragment by fragment."""
        found = self.pieces.get(text)
        if found is None:
            data = text.encode()
            edges = [0, *self.cuts(data), len(data)]
            found = b"".join([self.fragment(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
            if len(self.pieces) < PIECES and len(data) <= CACHED_BYTES:
                self.pieces[text] = found
        return found

    def encode_plain(self, text: str) -> bytes:
        """The ids of a text in which special tokens are plain text."""
        pieces = [text[a:b] for _, (a, b) in self.presplit(text)] if SAFE.search(text) else self.find(text)
        return b"".join(map(self.piece, pieces))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.split_special:
            return self.encode_plain(text)
        parts = self.split_special(text)  # special tokens at odd places
        if len(parts) == 1:
            return self.encode_plain(text)
        return b"".join([array("I", [self.special[p]]).tobytes() if k % 2 else self.encode_plain(p) for k, p in enumerate(parts)])

    def decode(self, ids: bytes | None) -> str:
        """The text of ids."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def forced_pairs(tokens: Iterable[bytes]) -> bytearray:
    """A flag for every pair of bytes, the first times 256 plus the second: 1 if it stands inside no token."""
    flags = bytearray(b"\1") * 65536
    for t in tokens:
        for a, b in zip(t, t[1:], strict=False):
            flags[a << 8 | b] = 0
    return flags


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a process and file."""
    return Codec(path)


def _mapped(df: DataFrame, column: str, out: str, made: T.DataType, kind: pa.DataType, work) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name != out or f.name == column]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for b in small(batches):
            values = pa.array(list(map(one, b.column(column).to_pylist())), kind)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), values], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, made)]))


def encoded(docs: DataFrame, column: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs and the ids of a text column."""
    path = path or default_path()
    return _mapped(docs, column, out, T.BinaryType(), pa.binary(), lambda: codec(path).encode)


def decoded(rows: DataFrame, column: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """rows and the texts of an id column."""
    path = path or default_path()
    return _mapped(rows, column, out, T.StringType(), pa.string(), lambda: codec(path).decode)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encoded(docs).drop("text")
    return decoded(ids).selectExpr("doc_id", "CAST(length(ids) DIV 4 AS LONG) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(CAST(decoded AS BINARY), 256) AS decoded_sha256")
