"""Distribution divergence: documents against language references.

Base rules count words, repeats and symbols. The verdict compares two histograms
of a document with references by the Jensen-Shannon distance (base 2, so 0 to 1):
character classes and the shares of common words, each with one reference a
language. Each comparison has a least length below which it does
not speak, as a short text's histogram is mostly noise, and speaks only where the
document's lang has references or is null, so no script is judged by another's
shares. Classes are held against the reference of the document's lang (the nearest
for null); words against the nearest of all, so a wrong label rejects nothing.

Edge cases: null text has no words and fails the base; null or unknown lang is
judged as above; repeated rows and nulls in other columns stay as they are; an
empty table gives no row. An input column with a result's
name gives way to it; a prefix for the results keeps both.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import small

MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words in repeated windows
MIN_CHARS_CLASS, MAX_CLASS_DISTANCE = 200, 0.2
MIN_WORDS_COMMON, MAX_COMMON_DISTANCE = 150, 0.28

CLASSES = ("letter", "capital", "digit", "space", "sentence", "symbol", "other")
#: Usual shares of the classes in running prose, by general knowledge: word lengths give the spaces, noun capitals set German apart, elisions French.
CLASS_SHARES = {
    "en": (0.785, 0.030, 0.006, 0.155, 0.0225, 0.0005, 0.001),
    "fr": (0.778, 0.024, 0.006, 0.158, 0.0325, 0.0005, 0.001),
    "de": (0.790, 0.052, 0.006, 0.128, 0.0225, 0.0005, 0.001),
    "es": (0.790, 0.026, 0.006, 0.152, 0.0245, 0.0005, 0.001),
}
SENTENCE, SYMBOLS = ".,;:!?'\"()-", "#*$%&|<>"

#: The most frequent function words of each language.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec",
    "de": "der die und in den von zu das mit sich des für auf ist im dem nicht ein eine als",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
#: Zipf's law over those words: the share of the first, by general knowledge 6 %, falls as 1 / (rank + 1) ** 0.85 or so.
FIRST_SHARE, ZIPF = 0.06, 0.85
STRIP = b".,;:!?'\"()[]"


@functools.cache
def _class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, CLASSES.index("other"), dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind in ("Lu", "Lt"):
            out[cp] = 1
        elif kind[0] in "LM":
            out[cp] = 0
        elif kind[0] == "N":
            out[cp] = 2
        elif kind[0] == "Z":
            out[cp] = 3
    for chars, k in ((" \t\n\r\v\f", 3), (SENTENCE, 4), (SYMBOLS, 5)):
        for c in chars:
            out[ord(c)] = k
    return out


@functools.cache
def _references() -> tuple[dict[bytes, list[tuple[int, int]]], np.ndarray]:
    """Word to its (language row, bin), and a row of shares a language, the rest in the last bin."""
    most = max(len(x.split()) for x in COMMON.values())
    where: dict[bytes, list[tuple[int, int]]] = {}
    shares = np.zeros((len(COMMON), most + 1))
    for i, ws in enumerate(COMMON.values()):
        for j, w in enumerate(ws.split()):
            where.setdefault(w.encode(), []).append((i, j))
            shares[i, j] = FIRST_SHARE / (j + 1) ** ZIPF
        shares[i, most] = 1 - shares[i].sum()
    return where, shares


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the last axis."""
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def repeat_words(ids: np.ndarray, n_ids: int) -> int:
    """Words covered by 3-word windows that stand in the text twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1].astype(np.int64) * n_ids + ids[1:]
    if n_ids > 1_000_000:  # keep the key within 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, at, n = np.unique(pair[:-1] * n_ids + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def measure(text: bytes | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), class counts and common-word counts a language."""
    where, shares = _references()
    common = np.zeros(shares.shape)
    ws = text.split() if text else []
    if not ws:
        return [0] * 5, np.zeros(len(CLASSES)), common
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in ws])
    times = np.bincount(ids)
    for w, n in zip(number, times.tolist(), strict=True):
        if len(w) < 12 and (at := where.get(w.strip(STRIP).lower())):
            for i, j in at:
                common[i, j] += n
    common[:, -1] = len(ws) - common.sum(1)
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), dtype="<u4")
    classes = np.bincount(_class_table()[points], minlength=len(CLASSES)).astype(float)
    blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return [len(ws), len(points) - blanks, symbols, dup_lines(text), repeat_words(ids, len(number))], classes, common


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_classes", "js_words")


def judge(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs (with text and lang) and the measures, base verdict, final verdict and both distances (null where the guard holds)."""
    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()] * 2
    added = [T.StructField(prefix + n, k) for n, k in zip(COLUMNS, kinds, strict=True)]
    docs = docs.drop(*[f.name for f in added])
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shares = _references()
        prose, line = np.array(list(CLASS_SHARES.values())), {k: i for i, k in enumerate(CLASS_SHARES)}
        for b in small(batches):
            text = b.column("text").cast(pa.binary()).to_pylist()
            found = [measure(t) for t in text]
            counts = np.array([f[0] for f in found], dtype=np.int64)
            classes, common = np.stack([f[1] for f in found]), np.stack([f[2] for f in found])
            total, n = classes.sum(1), counts[:, 0]
            failed = (n < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * n)
            each = js_distance((classes / np.maximum(total, 1)[:, None])[:, None, :], prose)
            by_word = js_distance(common / np.maximum(n, 1)[:, None, None], shares).min(1)
            lang = b.column("lang").to_pylist()
            own = np.array([line.get(x, -1) for x in lang])
            by_class = np.where(own >= 0, each[np.arange(len(own)), own], each.min(1))
            known = np.array([x is None or x in line for x in lang])
            says, speaks = known & (total >= MIN_CHARS_CLASS), known & (n >= MIN_WORDS_COMMON)
            kept = ~failed & ~(says & (by_class > MAX_CLASS_DISTANCE)) & ~(speaks & (by_word > MAX_COMMON_DISTANCE))
            made = [pa.array(counts[:, k]) for k in range(5)] + [pa.array(failed), pa.array(kept), pa.array(by_class, mask=~says), pa.array(by_word, mask=~speaks)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *(prefix + c for c in COLUMNS)])

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, "_quality_").filter("_quality_kept").select(*[f"`{c}`" for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")).drop("lang", "text")
    return judged.withColumns({c: F.round(c, 6) for c in ("js_classes", "js_words")})
