"""Alignment of two tokenizers' tokens by byte ranges.

Every worker encodes the texts of an Arrow batch with both tokenizers and hands
DuckDB two interval tables, one row a token: id, start and end in bytes, counted
over the whole chunk, so that one order serves all its documents. An as-of join
finds for each A token the B token in which it ends; where both end together a
group closes, and a window sum of these places numbers the groups. Groups with several
tokens on both sides go through a range join of A's and B's byte ranges, which gives the
overlapping pairs. Links are the token pairs that end together; their counts a document and
id pair leave the worker as partial counts, which Spark sums over the corpus.

Size of what is broadcast: of a linked pair one token's bytes end with the other's,
so the A and B vocabularies hold at most as many linkable id pairs as they have bytes
in all tokens together, whatever the corpus; `pair_bound` counts these. The table
of corpus counts, a row a pair, stays below that (some 10 MB for the default files).

A chunk is CHUNK bytes of texts or one longer text; a worker's memory follows the longer
of both. DuckDB runs in memory, on one thread, and writes no files.

A encodes space and text, B encodes the text and adds the space itself; strings of
special tokens are plain text to both. Tokens whose joined bytes differ from space
and text (a normalising tokenizer) can't be aligned.

Edge cases: null and empty texts, and texts that can't be aligned, have no tokens: zeros,
an empty groups text and no links; nulls in other columns, ties and repeated rows stay
(each row's links count); an empty table gives no row; input columns with the names of
the outputs give way.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm.batches import small
from tessera.llm.tokens import SAFE, byte_map, default_path, encoder
from tessera.plans.shared import materialize

CHUNK, WORDS = 1 << 20, 300_000

#: Every A token, the B token in which it ends, whether both end together, and its group: the number of such places before it.
MEETINGS = """
CREATE OR REPLACE TEMP TABLE meetings AS
SELECT *, (sum(closes) OVER (ORDER BY e) - closes)::INT AS g
FROM (SELECT a.doc, a.id AS a_id, a.s, a.e, b.id AS b_id, b.pos AS b_pos, (a.e = b.e)::INT AS closes FROM a ASOF JOIN b ON a.e <= b.e)"""
#: Groups in order: their A tokens and the last B token.
GROUPS = "SELECT any_value(doc) AS doc, count(*) AS n_a, max(b_pos) AS last_b FROM meetings GROUP BY g ORDER BY g"
#: Overlapping pairs of groups with several tokens on both sides (g, first_b, last_b), by byte ranges.
OVERLAPS = """
WITH m AS (SELECT meetings.doc, s, e FROM meetings JOIN several USING (g)),
n AS (SELECT b.s, b.e FROM (SELECT unnest(range(first_b, last_b + 1)) AS pos FROM several) JOIN b USING (pos))
SELECT m.doc, count(*) AS n FROM m JOIN n ON m.s < n.e AND m.e > n.s GROUP BY 1"""
LINKS = """
WITH n AS (SELECT doc, a_id, b_id, count(*) AS n FROM meetings WHERE closes = 1 GROUP BY ALL),
l AS (SELECT doc, list({'a_id': a_id::INT, 'b_id': b_id::INT, 'n': n} ORDER BY a_id, b_id) AS links FROM n GROUP BY doc)
SELECT coalesce(links, []) AS links FROM range(?) r(doc) LEFT JOIN l USING (doc) ORDER BY doc"""


class Words:
    """Encoder of a piece file: where no piece has a word mark behind another character, words can't merge, so each is encoded once and kept in a bounded cache."""

    UNIT = re.compile("▁+[^▁]*")

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model = model
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces) and model.id_to_piece(model.encode("a")[0])[0] == "▁"
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers; words that are new to the cache go to the model together."""
        if not self.apart:
            return [array("I", ids).tobytes() for ids in self.model.encode([t or "" for t in texts], num_threads=1)]
        words = [self.UNIT.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        known = self.known
        new = list({w for own in words for w in own if w not in known})
        ids = self.model.encode([w[1:].replace("▁", " ") for w in new], num_threads=1)
        made = {w: array("I", i if len(w) > 1 else [self.model.piece_to_id("▁")]).tobytes() for w, i in zip(new, ids, strict=True)}
        if len(known) < WORDS:
            known.update((w, i) for w, i in made.items() if len(w) <= 64)
        return [b"".join([known.get(w) or made[w] for w in own]) for own in words]


class Aligner:
    """Two tokenizers, their tokens' bytes and a DuckDB connection."""

    def __init__(self, a_path: str, b_path: str):
        self.a = encoder(a_path)
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = Words(model)
        self.a_plain = Tokenizer.from_file(a_path)
        self.a_plain.encode_special_tokens = True
        self.a_bytes = token_bytes(self.a_plain)
        self.b_bytes = piece_bytes(model)
        size = max(self.a_bytes) + 1
        self.a_len = np.array([len(self.a_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        numbers = list(map(str, range(max(size, len(self.b_bytes)))))
        self.within, self.middle, self.end = (np.array([n + mark for n in numbers], object) for mark in ",|;")
        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of each text; none for texts that can't be aligned."""
        none = np.empty(0, np.uint32)
        out = []
        for text, ids in zip(texts, self.b.encode(texts), strict=True):
            whole = f" {text}" if text else ""
            a, b = self.a_ids(whole), np.frombuffer(ids, "<u4")
            data = whole.encode()
            same = self.a_len[a].sum() == len(data) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == data  # A's bytes are the text's, cut
            out.append((a, b) if same else (none, none))
        return out

    def a_ids(self, text: str) -> np.ndarray:
        """A's ids of a text in which special tokens are plain text."""
        if SAFE.search(text):
            return np.array(self.a_plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.a.lookup, self.a.find(text))), self.a.dtype).astype(np.uint32)

    @staticmethod
    def table(ids: list[np.ndarray], lengths: np.ndarray) -> pa.Table:
        """The interval table of a chunk's tokens."""
        every = np.concatenate(ids)
        ends = np.cumsum(lengths[every])
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        columns = {"doc": doc, "pos": np.arange(len(every)), "id": every, "s": ends - lengths[every], "e": ends}
        kind = np.int32 if not len(ends) or ends[-1] < 1 << 31 else np.int64
        return pa.table({k: v.astype(kind) for k, v in columns.items()})

    def chunk(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, n_overlaps, groups and links of all texts."""
        ids = self.tokens(texts)
        rows, con = len(texts), self.con
        a, b = self.table([x for x, _ in ids], self.a_len), self.table([y for _, y in ids], self.b_len)
        con.register("a", a)
        con.register("b", b)
        con.execute(MEETINGS)
        sizes = con.execute(GROUPS).fetchnumpy()
        doc, n_a, last = sizes["doc"], sizes["n_a"], sizes["last_b"]
        n_b = np.diff(last, prepend=-1)  # B's tokens follow one another
        both = np.flatnonzero((n_a > 1) & (n_b > 1))
        con.register("several", pa.table({"g": both, "first_b": (last - n_b + 1)[both], "last_b": last[both]}))
        crossed = con.execute(OVERLAPS).fetchnumpy()
        con.unregister("several")
        lone = (n_a == 1) | (n_b == 1)  # a lone token overlaps its whole group
        n_overlaps = np.bincount(doc[lone], np.maximum(n_a, n_b)[lone], rows) + np.bincount(crossed["doc"], crossed["n"], rows)
        linked = con.execute("SELECT doc, sum(closes)::BIGINT AS n FROM meetings GROUP BY doc").fetchnumpy()
        links = con.sql(LINKS, params=[rows]).to_arrow_table().column("links").combine_chunks()
        con.unregister("a")
        con.unregister("b")
        text = self.woven(a["id"].to_numpy(), b["id"].to_numpy(), n_a, n_b)
        edges = np.cumsum([0] + [len(x) + len(y) for x, y in ids]).tolist()
        groups = ["".join(text[i:j].tolist())[:-1] for i, j in zip(edges, edges[1:], strict=False)]
        n_groups = np.bincount(doc, minlength=rows)
        n_links = np.bincount(linked["doc"], linked["n"], rows).astype(np.int64)
        counts = [np.array([len(x) for x, _ in ids]), np.array([len(y) for _, y in ids]), n_groups, n_links, n_overlaps.astype(np.int64)]
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string()), links.cast(pa.list_(_LINK))]

    def woven(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Every token's number and the mark behind it, A's of a group before B's."""
        out = np.empty(len(a) + len(b), object)
        a_ends, b_ends = np.cumsum(n_a), np.cumsum(n_b)
        for ids, ends, others, mark in ((a, a_ends, np.repeat(b_ends - n_b, n_a), self.middle), (b, b_ends, np.repeat(a_ends, n_b), self.end)):
            words = self.within[ids]
            words[ends - 1] = mark[ids[ends - 1]]
            out[np.arange(len(ids)) + others] = words
        return out


def token_bytes(tokenizer: Tokenizer) -> dict[int, bytes]:
    """The bytes of each token of a byte-level vocabulary; special tokens stand for their own text."""
    to_byte = {c: b for b, c in byte_map().items()}
    return {i: bytes(map(to_byte.__getitem__, t)) if all(c in to_byte for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes that each piece stands for."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def pair_bound(a: Iterable[bytes], b: Iterable[bytes]) -> int:
    """Token pairs of which one ends with the other: more can't end together."""
    count: list[dict[bytes, int]] = [{}, {}]
    for side, tokens in zip(count, (a, b), strict=True):
        for t in tokens:
            side[t] = side.get(t, 0) + 1
    one, other = count
    whole = sum(n * other.get(t[k:], 0) for t, n in one.items() for k in range(len(t)))
    return whole + sum(n * one.get(t[k:], 0) for t, n in other.items() for k in range(1, len(t)))


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a process and pair of files."""
    return Aligner(a_path, b_path)


_OUT = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")] + [
    T.StructField("groups", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("a_id", T.IntegerType()), T.StructField("b_id", T.IntegerType()), T.StructField("n", T.LongType())]))),
]
_LINK = pa.struct([("a_id", pa.int32()), ("b_id", pa.int32()), ("n", pa.int64())])


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK bytes of text, or one row."""
    size = 0
    start = 0
    for i, t in enumerate(batch.column("text")):
        n = len(t.as_buffer()) if t.is_valid else 0
        if i > start and size + n > CHUNK:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """docs (text and others) with token, group, link and overlap numbers, the groups as text and the links of each id pair, in place of text."""
    a_path, b_path = a_path or default_path(), b_path or public_tokenizers.path("piece_bpe_32k.model")
    made = [f.name for f in _OUT]
    fields = [f for f in docs.schema.fields if f.name not in ("text", *made)]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_path, b_path)
        for batch in small(batches):
            for b in _chunks(batch):
                columns = one.chunk(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], names=[*names, *made])

    return docs.mapInArrow(run, T.StructType([*fields, *_OUT]))


def pair_counts(links: DataFrame) -> DataFrame:
    """a_id, b_id, total (links of the pair in all rows) and best (no pair with its B id has more), from rows of a_id, b_id and n."""
    totals = links.groupBy("a_id", "b_id").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b_id")))


def scored(rows: DataFrame, key: str) -> DataFrame:
    """key, n_best and count_sum of rows with links, by the counts of the whole table; key is unique and rows is a written table, as it is read twice."""
    links = rows.select(key, F.inline("links"))
    counts = pair_counts(links)
    return (
        links.join(F.broadcast(counts), ["a_id", "b_id"])
        .groupBy(key)
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.expr("CASE WHEN n_a = 0 THEN '' ELSE sha2(groups, 256) END")
    rows = aligned(docs).withColumn("groups_sha256", digest).drop("groups").withColumn("_row", F.monotonically_increasing_id())
    held = materialize(rows, "aligned")
    found = held.drop("links").join(scored(held, "_row"), "_row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", "n_overlaps")
