"""Length-delimited binary token records with a separate offset index.

A shard is a run of records: length (8 bytes, little endian), its masked
CRC-32C (4), the payload, its masked CRC-32C (4): the framing that public
readers of such records know. A payload is header (doc_id 8 bytes, flags 4: bit
0 null doc_id, bit 1 one padding id at the end) and the ids, 2 bytes each where
the vocabulary allows, else 4, padded to whole words. Beside each shard lies an
index of (offset, payload length) pairs, 8 bytes each, for shuffled reads.

Edge cases: null text is empty (the end id alone); null doc_ids come last;
repeated doc_ids stay, ordered by text; an empty table gives no shard; extra
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.batches import small
from tessera.llm.crc32c import crc32c_words, masked
from tessera.plans.shared import scratch_path

MANIFEST = "shard string, n_docs long, n_ids long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids binary"
FLUSH_BYTES = 2 << 20
_HEAD = np.dtype([("doc_id", "<i8"), ("flags", "<u4")])


def frame(payloads: list[bytes], offset: int) -> tuple[bytes, bytes]:
    """Framed records and their index entries; payloads are whole 4-byte words."""
    size = np.array([len(p) for p in payloads], dtype="<u8")
    ends = np.cumsum(size // 4).astype(np.int64)
    body = masked(crc32c_words(b"".join(payloads), ends - (size // 4).astype(np.int64), ends))
    at = np.arange(len(size), dtype=np.int64) * 2
    head = masked(crc32c_words(size.tobytes(), at, at + 2))
    heads, tails = head.astype("<u4").tobytes(), body.astype("<u4").tobytes()
    sizes = size.tobytes()
    out = b"".join(x for i, p in enumerate(payloads) for x in (sizes[8 * i : 8 * i + 8], heads[4 * i : 4 * i + 4], p, tails[4 * i : 4 * i + 4]))
    total = size + np.uint64(16)
    starts = np.uint64(offset) + np.cumsum(total) - total
    return out, np.stack([starts, size], axis=1).astype("<u8").tobytes()


def unframe(data: bytes, entries: np.ndarray, base: int = 0) -> list[bytes]:
    """Payloads at the index's entries in data, which begins at file offset base; raises on any bad checksum."""
    if not len(entries):
        return []
    starts, size = entries[:, 0].astype(np.int64) - base, entries[:, 1].astype(np.int64)
    word = np.frombuffer(data, dtype="<u4")
    first = starts // 4
    head = masked(crc32c_words(data, first, first + 2))
    body = masked(crc32c_words(data, first + 3, first + 3 + size // 4))
    lengths = word[first].astype(np.int64) | word[first + 1].astype(np.int64) << 32
    if not ((word[first + 2] == head).all() and (lengths == size).all() and (word[first + 3 + size // 4] == body).all()):
        raise ValueError("a record's length or checksum does not match")
    return [data[s + 12 : s + 12 + n] for s, n in zip(starts.tolist(), size.tolist(), strict=True)]


def _payload(doc_id: int | None, ids: bytes) -> bytes:
    pad = -len(ids) % 4
    head = np.array([(doc_id or 0, (doc_id is None) | bool(pad) << 1)], dtype=_HEAD).tobytes()
    return head + ids + b"\0" * pad


#: Schemes that Spark's and Arrow's file systems name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def _open(uri: str):
    """(file system, path) of a folder that Spark names; a scheme that Arrow doesn't know is an error that says so."""
    scheme, mark, rest = uri.partition("://")
    uri = SCHEMES.get(scheme, scheme) + mark + rest
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"record files need a folder on file, hdfs, s3a, abfss or gs; got {uri}") from e


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, num_shards: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write shards in doc_id order below out; one manifest row a shard.

    Rows meet in doc_id ranges, so a shard is a range and no task sees more than one. A task writes under a
    temporary name and renames at its end: a lost or repeated attempt leaves only whole files.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        fs, root = _open(out)
        shard = f"shard-{TaskContext.get().partitionId():06d}"
        temp = f"{root}/.{shard}-{uuid.uuid4().hex}"
        files, n_docs, n_ids, offset, index = None, 0, 0, 0, []
        queue: list[bytes] = []

        def flush() -> None:
            nonlocal offset
            data, entries = frame(queue, offset)
            files.write(data)
            index.append(entries)
            offset += len(data)
            queue.clear()

        held = 0
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files = files or fs.open_output_stream(f"{temp}.bin")
                ids = enc.ids(text) + end
                n_docs, n_ids, held = n_docs + 1, n_ids + len(ids) // enc.width, held + len(ids)
                queue.append(_payload(doc_id, ids))
                if held >= FLUSH_BYTES:
                    flush()
                    held = 0
        if files:
            if queue:
                flush()
            files.close()
            with fs.open_output_stream(f"{temp}.idx") as f:
                f.write(b"".join(index))
            for kind in ("idx", "bin"):
                fs.move(f"{temp}.{kind}", f"{root}/{shard}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [offset]}, schema=_manifest_schema())

    keys = (F.col("doc_id").asc_nulls_last(),)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(num_shards, *keys) if num_shards else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys, "text").mapInArrow(write, MANIFEST)


def _manifest_schema() -> pa.Schema:
    return pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def write_records(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, out: str | None = None, num_shards: int | None = None) -> tuple[str, list[tuple[str, int]]]:
    """Write all docs; the folder's URI and (shard, ids before it), one entry a shard: as many as output files."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "records")
    fs, root = _open(out)
    fs.create_dir(root, recursive=True)
    rows = sorted((r.shard, r.n_ids) for r in write_shards(docs, out, tokenizer or tokens.default_path(), end_id, num_shards).select("shard", "n_ids").collect())
    starts, at = [], 0
    for shard, n in rows:
        starts.append((shard, at))
        at += n
    return out, starts


def read_records(spark: SparkSession, out: str, starts: list[tuple[str, int]], width: int) -> DataFrame:
    """One row a record with its ids as little-endian unsigned 32-bit integers (width bytes each in the files).

    Every length and checksum is verified. A task reads a shard a few MB at a time.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{shard}.idx") as f:
                    entries = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
                with fs.open_input_file(f"{root}/{shard}.bin") as f:
                    k = 0
                    while k < len(entries):
                        base = int(entries[k, 0])
                        stop = max(k + 1, int(np.searchsorted(entries[:, 0], np.uint64(base + FLUSH_BYTES))))
                        last = int(entries[stop - 1].sum()) + 16
                        f.seek(base)
                        payloads = unframe(f.read(last - base), entries[k:stop], base)
                        heads = np.frombuffer(b"".join(p[:12] for p in payloads), dtype=_HEAD)
                        ids = [p[12 : len(p) - width * (flag >> 1 & 1)] for p, flag in zip(payloads, heads["flags"].tolist(), strict=True)]
                        n = np.array([len(x) // width for x in ids], dtype=np.int64)
                        first = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(heads["doc_id"], mask=heads["flags"] & 1 == 1), pa.array(first), pa.array(n), pa.array([tokens.widen(x, f"<u{width}") for x in ids], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                        )
                        k = stop

    todo = spark.createDataFrame(starts, "shard string, start long")
    return todo.repartition(max(1, len(starts))).mapInArrow(read, READ)


def read_shuffled(out: str, shard: str, order: Iterable[int]) -> Iterator[bytes]:
    """Payloads of one shard in any order, each found by the index alone."""
    fs, root = _open(out)
    with fs.open_input_stream(f"{root}/{shard}.idx") as f:
        entries = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
    with fs.open_input_file(f"{root}/{shard}.bin") as f:
        for k in order:
            base, size = map(int, entries[k])
            f.seek(base)
            yield unframe(f.read(size + 16), entries[k : k + 1], base)[0]


def digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the 32-bit ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the record files, read them back and digest what was read."""
    width = tokens.encoder(tokens.default_path()).width
    out, starts = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest(read_records(spark, out, starts, width))
