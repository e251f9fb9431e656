"""Fourier transforms of arrays and block-wise tensor decoding, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Cosine terms of the usual windows.
WINDOWS = {
    "hann": (0.5, -0.5), "blackman": (0.42, -0.5, 0.08), "blackman_nuttall": (0.3635819, -0.4891775, 0.1365995, -0.0106411), "blackman_harris": (0.35875, -0.48829, 0.14128, -0.01168),
}


def window(kind: str, n: int, periodic: bool = False) -> np.ndarray:
    """Coefficients of a window of n samples."""
    x = 2 * np.pi * np.arange(n) / (n if periodic else max(n - 1, 1))
    return sum(a * np.cos(k * x) for k, a in enumerate(WINDOWS[kind]))


def kaiser(n: int, beta: float) -> np.ndarray:
    return np.kaiser(n, beta)


def stft(signal: np.ndarray, size: int, hop: int, kind: str = "hann") -> np.ndarray:
    """Spectra of windows that begin at every hop: frames by size / 2 + 1; a signal shorter than a window gives none."""
    if len(signal) < size:
        return np.zeros((0, size // 2 + 1), dtype=complex)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(signal, dtype=float), size)[::hop]
    return np.fft.rfft(frames * window(kind, size, True), axis=1)


def spectra(df: DataFrame, key: str, values: str, size: int, hop: int, kind: str = "hann") -> DataFrame:
    """(key, frame, power array) of an array column."""
    schema = T.StructType([df.schema[key], T.StructField("frame", T.IntegerType()), T.StructField("power", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = np.abs(stft(np.array(v or [], dtype=float), size, hop, kind)) ** 2
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(p), b.schema.field(0).type), pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[key, "frame", "power"])

    return df.select(key, values).mapInArrow(run, schema)


# Tensor blocks of the public container: type code to decoder of raw bytes.


def _half(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<f2").astype(np.float32)


def _blocks(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, size)


def _nibbles(q: np.ndarray) -> np.ndarray:
    """Low halves of all bytes, then high halves."""
    return np.concatenate([q & 15, q >> 4], axis=1).astype(np.float32)


def _high_bits(raw: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(raw).view("<u4")
    return ((bits >> np.arange(32, dtype=np.uint32)) & 1).astype(np.float32) * 16


def decode(data: bytes, kind: int) -> np.ndarray:
    """Numbers of a tensor's raw bytes: 32- and 16-bit floats, and blocks of 32 with a scale, with or without a least value."""
    if kind == 0:
        return np.frombuffer(data, "<f4").copy()
    if kind == 1:
        return np.frombuffer(data, "<f2").astype(np.float32)
    if kind == 30:
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    if kind == 2:
        b = _blocks(data, 18)
        return (_half(b[:, :2]) * (_nibbles(b[:, 2:]) - 8)).ravel()
    if kind == 3:
        b = _blocks(data, 20)
        return (_half(b[:, :2]) * _nibbles(b[:, 4:]) + _half(b[:, 2:4])).ravel()
    if kind == 6:
        b = _blocks(data, 22)
        return (_half(b[:, :2]) * (_nibbles(b[:, 6:]) + _high_bits(b[:, 2:6]) - 16)).ravel()
    if kind == 7:
        b = _blocks(data, 24)
        return (_half(b[:, :2]) * (_nibbles(b[:, 8:]) + _high_bits(b[:, 4:8])) + _half(b[:, 2:4])).ravel()
    if kind == 8:
        b = _blocks(data, 34)
        return (_half(b[:, :2]) * np.ascontiguousarray(b[:, 2:]).view(np.int8)).astype(np.float32).ravel()
    raise ValueError(f"no decoder for tensor type {kind}")
