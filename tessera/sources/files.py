"""Binary files: content sniffing, tensor containers and image sets in fixed-width formats."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bytes (hex) of known formats, in order of trial; the number is the offset.
MAGIC = (
    ("89504E470D0A1A0A", 0, "image"), ("FFD8FFE0", 0, "image"), ("FFD8FFE1", 0, "image"), ("FFD8FFDB", 0, "image"), ("FFD8FFEE", 0, "image"),
    ("474946383761", 0, "image"), ("474946383961", 0, "image"), ("49492A00", 0, "image"), ("4D4D002A", 0, "image"), ("424D", 0, "image"),
    ("25504446", 0, "pdf"), ("504B0304", 0, "zip"), ("1F8B", 0, "compressed"), ("377ABCAF271C", 0, "compressed"), ("526172211A07", 0, "compressed"),
    ("4D5A", 0, "executable"), ("7F454C46", 0, "executable"), ("FEEDFACE", 0, "executable"), ("FEEDFACF", 0, "executable"),
    ("494433", 0, "audio"), ("FFFB", 0, "audio"), ("664C6143", 0, "audio"), ("4F676753", 0, "audio"), ("66747970", 4, "video"), ("1A45DFA3", 0, "video"),
)
HEAD_BYTES, MAX_ENTROPY, MIN_PRINTABLE, MAX_CONTROL = 8192, 6.5, 0.9, 0.1


def magic(head: Column, path: Column) -> Column:
    """Format by leading bytes, or null; a zip container of an office name is an office file."""
    h, out = F.hex(F.substring(head, 1, 16)), None
    for code, at, kind in MAGIC:
        hit = F.substring(h, 2 * at + 1, len(code)) == code
        value = F.when(F.regexp_like(F.lower(path), F.lit(r"\.(docx|xlsx|pptx)$")), "office").otherwise("compressed") if kind == "zip" else F.lit(kind)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _measures(heads: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("head").to_pylist():
                x = np.frombuffer(data or b"", dtype=np.uint8)
                p = np.bincount(x, minlength=256) / max(len(x), 1)
                entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
                blank = p[[9, 10, 13]].sum()
                printable = p[32:127].sum() + blank + p[128:248].sum()  # UTF-8 lead and continuation bytes count
                rows.append((entropy, float(printable), float(p[:32].sum() - blank)))
            e, q, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e, pa.float64()), pa.array(q, pa.float64()), pa.array(c, pa.float64())], names=[*b.schema.names, "entropy", "printable", "control"])

    return heads.mapInArrow(run, "path string, head binary, entropy double, printable double, control double")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, is_text, kind) of every file: magic bytes, then XML or HTML openings, then printable shares and byte entropy of the first 8 KB."""
    heads = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return classify(heads)


def classify(heads: DataFrame) -> DataFrame:
    """sniff() over a table (path, head)."""
    x = _measures(heads.select("path", "head"))
    opening = F.upper(F.decode(F.substring("head", 1, 16), "ISO-8859-1"))
    xml = F.regexp_like(opening, F.lit("^(<\\?XML|<!DOCTYPE|<HTML[> ])"))
    plain = (F.col("printable") > MIN_PRINTABLE) & (F.col("control") < MAX_CONTROL) & (F.col("entropy") < MAX_ENTROPY)
    found = magic(F.col("head"), F.col("path"))
    kind = F.when(F.length("head") == 0, "unknown").when(found.isNotNull(), found).when(xml, "xml").when(plain, "text").otherwise("unknown")
    return x.select("path", kind.isin("xml", "text").alias("is_text"), kind.alias("kind"))


#: Fixed values of the public container format: scalar type codes, and (values, bytes) of a block by tensor type.
_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
_STRING, _ARRAY = 8, 9
BLOCKS = {
    0: (1, 4), 1: (1, 2), 2: (32, 18), 3: (32, 20), 6: (32, 22), 7: (32, 24), 8: (32, 34), 9: (32, 36), 10: (256, 84), 11: (256, 110), 12: (256, 144),
    13: (256, 176), 14: (256, 210), 15: (256, 292), 20: (32, 18), 24: (1, 1), 25: (1, 2), 26: (1, 4), 27: (1, 8), 28: (1, 8), 30: (1, 2),
}


class _Reader:
    """Sequential reads of a container's header."""

    def __init__(self, f):
        self.f = f

    def take(self, n: int) -> bytes:
        out = self.f.read(n)
        if len(out) != n:
            raise ValueError("the file ends within its header")
        return out

    def number(self, code: str):
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.take(self.number("Q")).decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == _STRING:
            return self.text()
        if kind == _ARRAY:
            inner, n = self.number("I"), self.number("Q")
            return [self.value(inner) for _ in range(n)]
        return self.number(_SCALARS[kind])


def read_header(f) -> tuple[list[tuple[str, int, str]], list[tuple[str, list[int], int, int, int]]]:
    """(key, type, value as JSON) and (name, dims, type, absolute offset, bytes) of a tensor container, version 2 or 3."""
    import json

    r = _Reader(f)
    if r.take(4) != b"GGUF" or r.number("I") not in (2, 3):
        raise ValueError("not a tensor container of version 2 or 3")
    n_tensors, n_keys = r.number("Q"), r.number("Q")
    meta, align = [], 32
    for _ in range(n_keys):
        key, kind = r.text(), r.number("I")
        value = r.value(kind)
        if key == "general.alignment":
            align = int(value) or 32
        meta.append((key, kind, json.dumps(value)))
    tensors = []
    for _ in range(n_tensors):
        name, dims = r.text(), [r.number("Q") for _ in range(r.number("I"))]
        kind, offset = r.number("I"), r.number("Q")
        per, size = BLOCKS[kind]
        count = int(np.prod(dims, dtype=np.int64)) if dims else 1
        if count % per:
            raise ValueError(f"{name} does not fill its blocks")
        tensors.append((name, dims, kind, offset, count // per * size))
    start = -(-f.tell() // align) * align
    return meta, [(n, d, k, start + o, b) for n, d, k, o, b in tensors]


def container(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Metadata (path, key, type, value) and tensors (path, name, dims, type, offset, n_bytes); only headers are read, a file a task."""

    def each(batches, pick: int, schema: pa.Schema):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    rows = read_header(f)[pick]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([[path] * len(rows), *map(list, zip(*rows, strict=True))], schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    s, i = pa.string(), pa.int64()
    meta = pa.schema([("path", s), ("key", s), ("type", pa.int32()), ("value", s)])
    tens = pa.schema([("path", s), ("name", s), ("dims", pa.list_(i)), ("type", pa.int32()), ("offset", i), ("n_bytes", i)])
    return (
        files.mapInArrow(lambda b: each(b, 0, meta), "path string, key string, type int, value string"),
        files.mapInArrow(lambda b: each(b, 1, tens), "path string, name string, dims array<long>, type int, offset long, n_bytes long"),
    )


def images_fixed(spark: SparkSession, path: str, header: int, label_bytes: int, pixels: int) -> DataFrame:
    """(path, pos, label, pixels) of files of fixed-width records after a header, such as image benchmark batches."""
    width = label_bytes + pixels

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=np.uint8)[header:]
                x = x[: len(x) // width * width].reshape(-1, width)
                label = x[:, label_bytes - 1].astype(np.int32) if label_bytes else np.zeros(len(x), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(label), pa.array([r.tobytes() for r in x[:, label_bytes:]], pa.binary())], names=["path", "pos", "label", "pixels"]
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos int, label int, pixels binary")
