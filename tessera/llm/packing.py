"""Sum-of-squares packing of token sequences into fixed-length rows.

Documents are encoded where they lie and cut only if longer than the capacity;
pieces are dealt evenly over packing groups by a running slot (never by a key
that could be hot), sorted by falling length inside each group, and streamed
through the placer. Its state is one counter and one stack of open sequences a
residual gap. A piece goes where the sum over gaps of the squared number of open
sequences becomes smallest. Two rules go before that sum, as the fewest sequences
are asked for: a gap that the piece fills exactly, and no new sequence while an
open one fits (3,000 documents: 1,497 sequences at a bound of 1,496; the plain sum
makes 1,504). Placer(plain=True) and pack(plain=True) leave both rules out. Each group wastes at most the last
few sequences, so groups as large as a shuffle partition pack close to the bound.

Edge cases: null text is empty (the end id alone); null and repeated doc_ids are
separate documents; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.batches import ROWS, small

PIECES = "doc_id long, piece int, start long, length long, ids binary, slot long"
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
BATCH_BYTES = 8 << 20


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one if it fits, else whole capacities after a first rest."""
    if total <= capacity:
        return [(0, total)]
    rest = total % capacity
    starts = [0] if rest else []
    starts += range(rest, total, capacity)
    return [(s, (rest if s == 0 and rest else capacity)) for s in starts]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row a piece of docs (doc_id, text), with its ids in the encoder's width."""
    path = tokenizer or tokens.default_path()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end, w = np.array([end_id], dtype=enc.dtype).tobytes(), enc.width
        slot = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // w, capacity)):
                    rows.append((doc_id, k, start, length, ids[start * w : (start + length) * w], slot))
                    slot += 1
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield _batch(rows, _PIECES)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("slot", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Placer:
    """Online sum-of-squares placement into sequences of one capacity."""

    def __init__(self, capacity: int, plain: bool = False):
        self.capacity, self.made, self.plain = capacity, 0, plain
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to capacity ids."""
        size = self.capacity
        if self.plain:
            gap = self._least(length)
        elif self.open[length]:  # an exact fill removes an open gap and adds none
            gap = length
        else:
            old, new = self.count[length:size], self.count[: size - length]
            change = np.where(old > 0, new - old, size * (1 << 40))
            k = int(change.argmin()) if length < size else 0
            gap = length + k if length < size and old[k] else size
        if gap == size:
            at, self.made = self.made, self.made + 1
        else:
            at = self.open[gap].pop()
            self.count[gap] -= 1
        if left := gap - length:
            self.open[left].append(at)
            self.count[left] += 1
        return at, size - gap


    def _least(self, length: int) -> int:
        """The gap, or the capacity for a new sequence, that leaves the least sum of squares; the smallest of equals.

        Taking a sequence from gap g to g - length changes the sum by 2 * (count[g - length] - count[g] + 1); full and
        fresh sequences are not counted, so an exact fill changes it by 1 - 2 * count[g], a new one by 2 * count + 1.
        """
        size, count = self.capacity, self.count
        gaps = np.arange(length, size + 1)
        old, new = count[gaps], count[gaps - length]
        change = 2 * (new - old + 1)
        change[0] = 1 - 2 * old[0] if length < size else 0
        if length < size:
            change[-1] = 2 * new[-1] + 1
        change[:-1][old[:-1] == 0] = np.iinfo(np.int64).max
        return int(gaps[change.argmin()])


def pack(rows: DataFrame, capacity: int = 2048, width: int | None = None, plain: bool = False) -> DataFrame:
    """The pieces with the sequence and the place in it of each; sequence ids are unique over all groups.

    Given the encoder's width in bytes, ids come back as little-endian unsigned 32-bit integers, else as they are.
    """

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer, group = Placer(capacity, plain), TaskContext.get().partitionId() << 32
        for batch in small(batches, 4 * ROWS):
            at = [placer.place(n) for n in batch.column(3).to_pylist()]
            ids = batch.column(4)
            if width:
                ids = pa.array([tokens.widen(x, f"<u{width}") for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], ids, pa.array([group + s for s, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    dealt = rows.repartition("slot").sortWithinPartitions(F.desc("length"), "slot")
    return dealt.mapInArrow(place, PACKED)


def digest(packed: DataFrame) -> DataFrame:
    """CRC-32 in place of 32-bit ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    width = tokens.encoder(tokens.default_path()).width
    return digest(pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), width=width))
