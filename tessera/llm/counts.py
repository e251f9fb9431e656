"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the pieces lists every match in a word; dynamic
programming over match ends carries the best score and the number of pieces on
that path, never the pieces. Ties follow the public unigram tokenizer: a path
replaces another only with a strictly higher score, and starts are tried from
left to right, so of equal paths to an end the one whose last piece starts first
stays. A code point that no single piece covers may be an unknown, scored 10
below the lowest piece; a run of unknowns is one piece, or its UTF-8 bytes where
the vocabulary has byte pieces.

Spaces become word marks, a text is cut before each mark, and counts
of words are kept in a bounded per-process cache, so any length costs memory for
one text only.

Vocabulary: the text pieces and scores of a piece file (a parameter), as they stand;
its control, unknown and byte pieces match no text.

Edge cases: null or empty text has 0 pieces; nulls in other columns, ties and
repeated rows change nothing; an empty table gives no row.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.batches import small

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed by the public unigram tokenizer
CACHE_ENTRIES = 300_000
WORD = re.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the pieces that plain text can match, in id order, and whether bytes stand for unknowns, of a sentencepiece file.

    Control, unknown, unused and byte pieces are markup of the file, not text.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    return pieces, sum(sp.is_byte(i) for i in range(n)) == 256


class Counter:
    """Piece counts under one vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]], bytes_: bool = False):
        self.trie = ahocorasick.Automaton()
        for piece, score in dict(vocab).items():
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.bytes = bytes_
        self.cache: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Pieces of the best path of one word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in self.trie.iter(word):
            ends[end].append(hit)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        open_run = [False] * (n + 1)  # the best path ends in an unknown
        for end in range(1, n + 1):
            hits = ends[end - 1]
            hits.sort(reverse=True)  # longest first: the leftmost start
            best, pieces, run, single = None, 0, False, False
            for length, s in hits:
                if length == 1:
                    single = True
                total = s + score[end - length]
                if best is None or total > best:
                    best, pieces, run = total, count[end - length] + 1, False
            if not single:
                total = self.unknown + score[end - 1]
                if best is None or total > best:
                    best, run = total, True
                    own = len(word[end - 1].encode()) if self.bytes else 1
                    pieces = count[end - 1] + (own if self.bytes or not open_run[end - 1] else 0)
            score[end], count[end], open_run[end] = best, pieces, run
        return count[n]

    def count(self, text: str | None) -> int:
        """Pieces of a text; the word mark stands for its start and for every space."""
        if not text:
            return 0
        total, cache = 0, self.cache
        text = text.replace(" ", MARK)
        for word in WORD.findall(text if text[0] == MARK else MARK + text):
            n = cache.get(word)
            if n is None:
                n = self.viterbi(word)
                if len(cache) < CACHE_ENTRIES and len(word) <= 64:
                    cache[word] = n
            total += n
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*vocabulary(path))


def count_tokens(docs: DataFrame, out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs (with text) and the piece count of each text; an input column named out gives way."""
    docs = docs.drop(out)
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.count(t) for t in b.column("text").to_pylist()], pa.int64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece count of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
