"""Secret scans with structural confirmation.

Base kinds are pattern matches. The method then takes long base64 and hex runs,
PEM bodies and dotted triples, decodes them and reports only what parses whole:
a signed token whose header names an algorithm, a DER private key whose nested
lengths add up, or an OpenSSH private key with its magic and counted fields.

Spans are code points, end exclusive. Edge cases: null or empty text has none;
nulls in other columns, ties and repeated rows change nothing; an empty table
gives no row. Time follows the length of a text whatever it holds: key marks are
found in one scan and paired, lines that continue a wrapped key are listed once,
and a candidate is decoded only if it ends where its own length says. A key has at
most MOST bytes (RSA of 100,000 bits fits).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.batches import small

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
LEAST = {"assign": 8, "access": 16}

JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
PEM = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]++ )*?PRIVATE KEY)-----")
#: Header lines below a BEGIN, then the body.
HEADERS = re.compile(r"(?:(?:\s|\\+[nr])*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?:\\+[nr]|[\r\n]))*+")
BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\+[nrt])++")
#: DER sequences begin with byte 0x30, M in base64; the OpenSSH magic with b3BlbnNzaC1rZXkt.
B64 = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))(?:M|b3BlbnNzaC1rZXkt)(?=[A-Za-z0-9+/_-]{39})")
RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: The next line of a wrapped run; line ends may be escaped, as in JSON and source.
WRAP = re.compile(r"[ \t]*(?:\\+[nr]|[\r\n])+[ \t]*([A-Za-z0-9+/_-]+)")
PAD = re.compile(r"={0,2}")
HEXDER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
SSH_MAGIC = b"openssh-key-v1\0"  # fixed by the public key format
MOST = 1 << 16


def _unbase64(text: str) -> bytes | None:
    return _unline(re.sub(r"\s+|\\+[nrt]", "", text))


def _unline(text: str) -> bytes | None:
    """The bytes of base64 without line ends."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill data exactly, all nested sequences checked; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 8:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 128:  # DER takes the shortest form
                return None
        if at + n > len(data):
            return None
        content = data[at : at + n]
        if tag in (0x30, 0x31) and der_items(content, depth + 1) is None:
            return None
        out.append((tag, content))
        at += n
    return out


def is_der_key(data: bytes | None) -> bool:
    """A DER private key: RSA (version and 8 integers), DSA (version 0 and 5 integers), EC (version 1 and octets) or the wrapped forms with an algorithm or encryption."""
    top = der_items(data) if data and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    inner = der_items(top[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:2] == [2, 4] and inner[0][1] == b"\1":
        return 16 <= len(inner[1][1]) <= 72
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):
        return (der_items(inner[1][1]) or [(0, b"")])[0][0] == 6
    if len(tags) >= 9 and set(tags[:9]) == {2} and inner[0][1] in (b"\0", b"\1"):
        return True
    if tags == [2] * 6 and inner[0][1] == b"\0":
        return True
    return tags == [0x30, 4] and (der_items(inner[0][1]) or [(0, b"")])[0][0] == 6 and len(inner[1][1]) >= 32


def is_sealed(headers: str, data: bytes | None) -> bool:
    """A key under a passphrase: headers say so and name a cipher, the body is whole cipher blocks."""
    return "ENCRYPTED" in headers and "DEK-Info:" in headers and bool(data) and len(data) >= 32 and len(data) % 8 == 0


def is_ssh_key(data: bytes | None) -> bool:
    """An OpenSSH private key: magic, three counted strings, a key count and a counted key each."""
    if not data or not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for k in range(5):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:  # the number of keys
            if not 1 <= n <= 16:
                return False
        else:
            at += n
    return at <= len(data)


def key_kind(data: bytes | None) -> str | None:
    return "ssh" if is_ssh_key(data) else "der" if is_der_key(data) else None


def _der_size(head: bytes) -> int:
    """Bytes of a DER value, by its first bytes; 0 if they begin none."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    if head[1] & 0x80 and (head[1] & 0x7F) > 4:
        return 0
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return 0 if k > 4 or head[1] == 0x80 else 2 + (int.from_bytes(head[2 : 2 + k], "big") + k if k else head[1])


def key_bodies(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, header lines, body) of every BEGIN mark and the END mark of its kind that follows it."""
    begin = None
    for m in PEM.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2]:
            head = HEADERS.match(text, begin.end(), m.start())
            if BODY.fullmatch(text, head.end(), m.start()):
                yield begin.start(), m.end(), head[0], text[head.end() : m.start()]
        begin = m if m[1] == "BEGIN" else None


class Lines:
    """Lines of base64 that follow one another, each looked for once."""

    def __init__(self, text: str):
        self.text = text
        self.places: dict[int, tuple[tuple[list[int], list[int], list[int]], int]] = {}

    def after(self, start: int, end: int) -> tuple[tuple[list[int], list[int], list[int]], int]:
        """(starts, ends, characters up to each end) of the chain that holds the line ending at end, and its place there."""
        if end not in self.places:
            starts, ends, total = chain = [start], [end], [end - start]
            self.places[end] = chain, 0
            while m := WRAP.match(self.text, ends[-1]):
                starts.append(m.start(1))
                ends.append(m.end(1))
                total.append(total[-1] + m.end(1) - m.start(1))
                self.places[m.end(1)] = chain, len(ends) - 1
        return self.places[end]


def wrapped_key(text: str, start: int, end: int, lines: Lines) -> tuple[str, int] | None:
    """(kind, end) of a base64 key whose first line is given: DER takes lines up to its own length, OpenSSH lines as wide as the first and a shorter one."""
    ssh = text.startswith("b3Blb", start)
    size = 0 if ssh else _der_size(_unline(text[start : start + 12]) or b"")
    if not ssh and not 0 < size <= MOST:
        return None
    need, width = -(-size * 4 // 3), end - start
    if not ssh and width > need + 2:
        return None
    if (ssh or width >= need) and (kind := key_kind(_unline(text[start:end]))):
        return kind, end
    if text[end - 1] == "=":
        return None
    (starts, ends, total), at = lines.after(start, end)
    if ssh:
        last, most = at, -(-MOST * 4 // 3)
        while last + 1 < len(ends) and total[last] - total[at] < most:
            wide = ends[last + 1] - starts[last + 1]
            if wide > width:
                break
            last += 1
            if wide < width:
                break
    else:
        goal = total[at] + need - width
        last = bisect_left(total, goal, at)
        if last == len(total) or total[last] != goal:
            return None
    kind = key_kind(_unline("".join([text[start:end], *(text[a:b] for a, b in zip(starts[at + 1 : last + 1], ends[at + 1 : last + 1], strict=True))])))
    return (kind, PAD.match(text, ends[last]).end()) if kind else None


def is_jwt(head: str, body: str) -> bool:
    """A JSON header that names an algorithm, over a JSON object or opaque body."""
    try:
        header = json.loads(_unbase64(head) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and _unbase64(body) is not None


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_jwt(m[1], m[2])]
    within: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for start, end, head, body in key_bodies(text):
            data = _unbase64(body)
            if kind := key_kind(data) or ("der" if is_sealed(head, data) else None):
                found.append((kind, start, end))
                within.append((start, end))
    end = free = 0
    lines, inside = Lines(text), iter([*within, (len(text), len(text))])
    since, until = next(inside)
    for m in B64.finditer(text):  # a run that is no key may hold one after a separator
        start = m.start()
        while start >= until:
            since, until = next(inside)
        if start < free or start >= since:
            continue
        if start >= end:
            end = RUN.match(text, start).end()
        if key := wrapped_key(text, start, end, lines):
            found.append((key[0], start, key[1]))
            free = key[1]
        elif m[0] != "M":
            free = end
    for m in HEXDER.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str | None:
    """text with each maximal run of overlapping spans replaced by mark."""
    if not spans:
        return text
    out, at = [], 0
    runs: list[list[int]] = []
    for _, a, b in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs (with text) and their spans as an array; an input column of that name gives way."""
    docs = docs.drop(f"{prefix}spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, SPANS)], names=[*b.schema.names, f"{prefix}spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{prefix}spans", _SPANS)]))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span replaced in text, and n_chars to match; all rows and columns stay."""
    names, at = docs.columns, docs.columns.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            text = [redact(t, scan(t)) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(text, b.schema.field(at).type)
            if chars is not None:
                old = b.column(chars).to_pylist()
                columns[chars] = pa.array([n if n is None or t is None else len(t) for n, t in zip(old, text, strict=True)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and span digests of every document, derived from the spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    count = "CAST(size(filter(spans, s -> s.kind = '{0}')) AS LONG) AS n_{0}"
    text = "array_join(transform({0}, s -> concat_ws(':', s.kind, CAST(s.start AS STRING), CAST(s.end AS STRING))), ',')"
    base = text.format("filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))")
    return found.selectExpr("doc_id", *[count.format(k) for k in KINDS[:3]], f"sha2({base}, 256) AS base_sha256", f"{text.format('spans')} AS spans")
