"""Fill-in-middle transformation on ropes.

A text becomes a rope: leaves of at most LEAF code points under a balanced binary
tree, each node with the line ends and code points below it cached. Two unit ranks
are drawn from a hash of the seed and doc_id; the tree is split at both by descent
along the cached counts, and prefix, middle and suffix are joined in their new
order with sentinels between, sharing subtrees and copying only the leaves at the
cuts. The way back takes the output and its form alone: the sentinels' places give
two code-point ranks at which the output's rope is split, the subtrees are joined
in their old order.

Units are lines, `[^\\n]*\\n|[^\\n]+`. The sentinels don't overlap one another and a
text that contains one stays plain, so each is found exactly where it was put.

Edge cases: null and empty texts are plain, with 0 units and an empty output; a
text of any length takes time in proportion; a null doc_id draws like an empty
string; nulls in other columns, ties and repeated rows stay as they are (equal ids
draw equal numbers); an empty table gives no row; input columns with the names of
the outputs give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.batches import small

SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
LEAF = 2048
ENDS, CHARS = 0, 1  # what a rank counts


class Rope:
    """A leaf with a text or a node over two ropes; size holds its line ends and code points. Never changed once made."""

    __slots__ = ("text", "left", "right", "size")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = (text.count("\n"), len(text)) if text is not None else (left.size[0] + right.size[0], left.size[1] + right.size[1])

    def leaves(self) -> Iterator[str]:
        """Texts of the leaves from left to right."""
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.text is None:
                open_ += [node.right, node.left]
            else:
                yield node.text

    def __str__(self) -> str:
        return "".join(self.leaves())


def rope(text: str) -> Rope:
    """A balanced rope of a text."""
    level = [Rope(text[i : i + LEAF]) for i in range(0, len(text), LEAF)] or [Rope("")]
    while len(level) > 1:
        level = [Rope(None, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def units(whole: Rope, text: str) -> int:
    """Lines of a rope: its line ends, and a last line without one."""
    return whole.size[ENDS] + (text[-1:] not in ("", "\n"))


def join(*parts: Rope | None) -> Rope:
    """The parts one after another; small neighbours become one leaf."""
    out: Rope | None = None
    for part in parts:
        if part is None or not part.size[CHARS]:
            continue
        if out is None:
            out = part
        elif out.text is not None and part.text is not None and out.size[CHARS] + part.size[CHARS] <= LEAF:
            out = Rope(out.text + part.text)
        else:
            out = Rope(None, out, part)
    return out or Rope("")


def split(node: Rope, rank: int, by: int) -> tuple[Rope | None, Rope | None]:
    """The shortest beginning that holds rank line ends or code points, and the rest."""
    if rank <= 0:
        return None, node
    if node.text is not None:
        at = rank
        if by == ENDS:
            at = 0
            for _ in range(rank):
                at = node.text.index("\n", at) + 1
        return Rope(node.text[:at]), Rope(node.text[at:])
    inside = node.left.size[by]
    if rank <= inside:
        a, b = split(node.left, rank, by)
        return a, join(b, node.right)
    a, b = split(node.right, rank - inside, by)
    return join(node.left, a), b


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 for a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str | None, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    text = text or ""
    whole = rope(text)
    n = units(whole, text)
    h = draws(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, suffix = split(whole, high, ENDS) if high < n else (whole, None)
    prefix, middle = (None, None) if head is None else split(head, low, ENDS) if low < n else (head, None)
    p, s, m = map(Rope, SENTINELS)
    form = "spm" if h[3] % 100 < spm else "psm"
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.size[CHARS] if prefix else 0, middle.size[CHARS] if middle else 0, str(out)


def restore(output: str | None, form: str) -> str:
    """The text that an output was made of."""
    output = output or ""
    if form == "plain":
        return output
    first, second = ("<S>", "<P>") if form == "spm" else ("<P>", "<S>")
    if not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    parts, rest, done = [], rope(output), 0
    for mark, at in ((first, 0), (second, output.index(second)), ("<M>", output.index("<M>"))):
        part, rest = split(rest, at - done, CHARS)
        parts.append(part)
        _, rest = split(rest, len(mark), CHARS)
        rest = rest or Rope("")
        done = at + len(mark)
    parts.append(rest)
    _, a, b, middle = parts
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return str(join(prefix, middle, suffix))


_OUT = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def infilled(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text and others) with n, form, prefix_chars, middle_chars and output in place of text."""
    made = [f.name for f in _OUT]
    fields = [f for f in docs.schema.fields if f.name not in ("text", *made)]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = [transform(i, t, rate, spm, seed) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            columns = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], names=[*names, *made])

    return docs.mapInArrow(run, T.StructType([*fields, *_OUT]))


def restored(rows: DataFrame, out: str = "restored") -> DataFrame:
    """rows (output, form and others) with the rebuilt text."""
    rows = rows.drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = list(map(restore, b.column("output").to_pylist(), b.column("form").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, sizes and digests of every document's output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return restored(infilled(docs)).selectExpr(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(CAST(output AS BINARY), 256) AS output_sha256", "sha2(CAST(restored AS BINARY), 256) AS restored_sha256"
    )


_DRAW = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{SEED}:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, {_DRAW} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} AS plain FROM k),
p AS (SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 :], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
