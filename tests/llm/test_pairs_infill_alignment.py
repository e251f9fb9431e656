"""Forced-boundary BPE, fill-in-middle ropes and cross-tokenizer alignment against the libraries and plain versions."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import alignment, bytepairs, infill, queries, tokens
from tokenizers import Tokenizer

from tests.llm import cases

SF = "/root/testdata/sf0.001"
MIXED = "abc de'stll 0123\n\t  éßñÇ日本語한🙂՘́_-#▁\x00\x85<|>"


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def codec():
    return bytepairs.codec(tokens.default_path())


@pytest.fixture(scope="module")
def aligner():
    return alignment.aligner(tokens.default_path(), public_tokenizers.path("piece_bpe_32k.model"))


def test_forced_pairs_stand_in_no_token(codec):
    merged = [t for i, t in codec.bytes.items() if i not in codec.special.values()]  # no merge makes a special token
    inside = {t[i : i + 2] for t in merged for i in range(len(t) - 1)}
    for a in range(256):
        for b in range(256):
            assert bool(codec.forced[a << 8 | b]) == (bytes((a, b)) not in inside)


def test_cuts_are_the_same_in_short_and_long_fragments(codec):
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab.,<>'\xc3\xa9\x00 ") for _ in range(5000))
    assert codec.cuts(data) == [i for i in range(1, len(data)) if codec.forced[data[i - 1] << 8 | data[i]]] and codec.cuts(data)
    short = data[:40]
    assert codec.cuts(short) == [i for i in codec.cuts(data) if i < 40]


def test_lists_and_heaps_join_alike(codec):
    rng = random.Random(8)
    for _ in range(500):
        ids = [codec.single[b] for b in "".join(rng.choice(MIXED) for _ in range(rng.randint(1, 60))).encode()]
        assert codec._few(ids[:]) == codec._many(ids[:])


def test_fragments_alone_give_the_ids_of_the_whole(codec):
    """Merging a piece whole gives what its fragments give one after another."""
    rng = random.Random(6)
    for _ in range(400):
        data = "".join(rng.choice(MIXED) for _ in range(rng.randint(1, 50))).encode()
        edges = [0, *codec.cuts(data), len(data)]
        assert codec.merged(data) == b"".join(codec.merged(data[a:b]) for a, b in zip(edges, edges[1:], strict=False))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(MIXED), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_encoding_equals_the_library(text):
    codec, whole = bytepairs.codec(tokens.default_path()), tokens.encoder(tokens.default_path()).tokenizer
    got = codec.encode(text)
    assert ids_of(got) == whole.encode(text, add_special_tokens=False).ids
    assert codec.decode(got) == text


def test_special_tokens_and_unknown_ids(codec, library):
    for text in ("<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|>'s"):
        assert ids_of(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids
    plain = Tokenizer.from_file(tokens.default_path())
    plain.encode_special_tokens = True
    assert ids_of(codec.encode_plain("a<|endoftext|> b")) == plain.encode("a<|endoftext|> b", add_special_tokens=False).ids
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_300) for _ in range(15)]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", "=-", "'", "aA1", " ", "\n", "日"])
def test_long_runs_take_about_linear_time(codec, library, unit):
    text = unit * 60_000
    began = time.time()
    got = codec.encode(text)
    assert time.time() - began < 10
    assert ids_of(got) == library.encode(text, add_special_tokens=False).ids


def test_other_vocabulary_kinds_are_refused():
    with pytest.raises(ValueError):
        bytepairs.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_codec_over_edge_cases(spark, library):
    docs = cases.documents(spark)
    got = bytepairs.decoded(bytepairs.encoded(docs))
    assert got.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == (r.text or "")
        assert ids_of(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
    assert bytepairs.decoded(bytepairs.encoded(cases.empty(spark))).count() == 0


def test_op11_against_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.queries()["op11_forced_boundary_bpe"](spark, SF).collect():
        ids = library.encode(texts.pop(r.doc_id) or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not texts


def plain_infill(doc_id, text, rate=infill.RATE, spm=infill.SPM):
    """The contract said with lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=400, deadline=None)
@given(st.integers(), st.text(alphabet="ab\n<>PSMé🙂", max_size=60), st.sampled_from([1, 2, 3, 7, 2048]))
def test_infill_on_small_leaves(doc_id, text, leaf):
    held, infill.LEAF = infill.LEAF, leaf
    try:
        got = infill.transform(doc_id, text)
        assert got == plain_infill(doc_id, text)
        assert infill.restore(got[4], got[1]) == text
    finally:
        infill.LEAF = held


def test_rope_caches_and_splits():
    rng = random.Random(3)
    text = "".join(rng.choice("ab\né") for _ in range(30_000))
    whole = infill.rope(text)
    assert whole.size == (text.count("\n"), len(text)) and str(whole) == text
    for rank in (1, 17, whole.size[0] // 2, whole.size[0]):
        a, b = infill.split(whole, rank, infill.ENDS)
        at = [m.end() for m in re.finditer("\n", text)][rank - 1]
        assert (str(a), str(b) if b else "") == (text[:at], text[at:]) and a.size == (rank, at)
        assert str(infill.join(b, a)) == text[at:] + text[:at]
    for rank in (0, 1, 2048, 2049, 29_999, 30_000):
        a, b = infill.split(whole, rank, infill.CHARS)
        assert (str(a or ""), str(b or "")) == (text[:rank], text[rank:])


def test_infill_takes_linear_time():
    for text in ("\n" * 1_000_000, "x" * 1_000_000, "ab\n" * 400_000):
        began = time.time()
        got = infill.transform(5, text)
        assert infill.restore(got[4], got[1]) == text and time.time() - began < 5


def test_infill_over_edge_cases(spark):
    docs = cases.documents(spark)
    got = infill.restored(infill.infilled(docs, rate=60, spm=30)).collect()
    texts = Counter((d[0], *plain_infill(d[0], d[1], 60, 30), d[1] or "") for d in cases.rows())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == texts
    assert {r.form for r in got} == {"plain", "spm", "psm"} and set(docs.columns) - {"text"} <= set(got[0].asDict())
    assert infill.restored(infill.infilled(cases.empty(spark))).count() == 0
    with pytest.raises(ValueError):
        infill.restore("text", "psm")


def test_op12_against_duckdb(spark):
    got = queries.queries()["op12_rope_infill"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op12_rope_infill"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(object).where(got.notna(), None).equals(want[got.columns].astype(object).where(want[got.columns].notna(), None))
    assert (got.restored_sha256 != got.output_sha256).any()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(MIXED + "  \n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_apart_equal_the_library(text):
    words = alignment.aligner(tokens.default_path(), public_tokenizers.path("piece_bpe_32k.model")).b
    assert words.apart and ids_of(words.encode([text])[0]) == words.model.encode(text)


def plain_alignment(a_ids, b_ids, a_bytes, b_bytes):
    """(groups text, links, overlaps) by walking both token lists."""

    def spans(ids, known):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(known[i])))
            at += len(known[i])
        return out

    a, b = spans(a_ids, a_bytes), spans(b_ids, b_bytes)
    ends = {e for _, e in a} & {e for _, e in b}
    groups, links, i, j = [], Counter(), 0, 0
    for e in sorted(ends):
        x, y = [], []
        while i < len(a) and a[i][1] <= e:
            x.append(a_ids[i])
            i += 1
        while j < len(b) and b[j][1] <= e:
            y.append(b_ids[j])
            j += 1
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        links[x[-1], y[-1]] += 1
    overlaps = sum(s < v and u < e for s, e in a for u, v in b) if len(a) < 400 else None
    return ";".join(groups), links, overlaps


def test_alignment_of_mixed_texts(aligner):
    rng = random.Random(4)
    texts = [None, "", " ", "a▁b", "<s>", "<0x41>", "<|endoftext|>", *("".join(rng.choice(MIXED) for _ in range(rng.randint(1, 90))) for _ in range(300))]
    both = Tokenizer.from_file(tokens.default_path())
    both.encode_special_tokens = True
    got = list(zip(*[c.to_pylist() for c in aligner.chunk(texts)], strict=True))
    none = 0
    for text, (n_a, n_b, n_groups, n_links, n_overlaps, groups, links) in zip(texts, got, strict=True):
        a = both.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = aligner.b.model.encode(text) if text else []
        if not text or b"".join(aligner.b_bytes[i] for i in b) != f" {text}".encode():
            none += 1
            assert (n_a, n_b, n_groups, n_links, n_overlaps, groups, links) == (0, 0, 0, 0, 0, "", [])
            continue
        want, pairs, overlaps = plain_alignment(a, b, aligner.a_bytes, aligner.b_bytes)
        assert (n_a, n_b, groups, n_overlaps) == (len(a), len(b), want, overlaps), text
        assert n_groups == want.count(";") + 1 and n_links == sum(pairs.values())
        assert {(x["a_id"], x["b_id"]): x["n"] for x in links} == pairs
    assert none >= 3 and any(o > max(a, b) for a, b, _, _, o, _, _ in got)


def test_many_to_many_groups_are_joined(aligner):
    """A group with several tokens on both sides overlaps by byte ranges."""
    for text in ("ééé日本語한🙂🙂", "unbelievablyxqz zqxjk", "01234567890123"):
        a, b = aligner.a_ids(f" {text}").tolist(), aligner.b.model.encode(text)
        want = plain_alignment(a, b, aligner.a_bytes, aligner.b_bytes)
        got = [c.to_pylist()[0] for c in aligner.chunk([text])]
        assert (got[5], got[4]) == (want[0], want[2])


def test_linked_pairs_end_with_one_another(aligner):
    texts = [cases.prose(1, 300), "日本語 ééé 12.50"]
    bound = alignment.pair_bound(aligner.a_bytes.values(), aligner.b_bytes)
    assert bound <= sum(map(len, aligner.a_bytes.values())) * 2 + sum(map(len, aligner.b_bytes)) * 2
    for links in aligner.chunk(texts)[6].to_pylist():
        for x in links:
            a, b = aligner.a_bytes[x["a_id"]], aligner.b_bytes[x["b_id"]]
            assert a.endswith(b) or b.endswith(a)
    assert alignment.pair_bound([b"a", b"ba", b"cba"], [b"a", b"ba"]) == 6


def test_alignment_over_edge_cases(spark):
    docs = cases.documents(spark)
    rows = alignment.aligned(docs).collect()
    assert len(rows) == docs.count() and set(docs.columns) - {"text"} <= set(rows[0].asDict())
    assert all(r.n_a == 0 and r.groups == "" for r in rows if r.doc_id in (4, 5))
    assert all(r.n_groups == r.n_links > 0 for r in rows if r.doc_id in (1, 6))
    assert alignment.aligned(cases.empty(spark)).count() == 0


def test_op13_against_plain_counts(spark, aligner):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.queries()["op13_interval_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    kept, total = {}, Counter()
    for i, text in docs:
        b = aligner.b.model.encode(text or "")
        if text and b"".join(aligner.b_bytes[x] for x in b) == f" {text}".encode():
            a = aligner.a_ids(f" {text}").tolist()
            groups, links, _ = plain_alignment(a, b, aligner.a_bytes, aligner.b_bytes)
            kept[i] = (len(a), len(b), groups, links)
            total += links
    highest = {}
    for (_, b), n in total.items():
        highest[b] = max(n, highest.get(b, 0))
    for i, _ in docs:
        r = got[i]
        if i not in kept:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = kept[i]
        best = sum(n for (a, b), n in links.items() if total[a, b] == highest[b])
        summed = sum(n * total[p] for p, n in links.items())
        n = groups.count(";") + 1
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (n_a, n_b, n, n, best, summed, hashlib.sha256(groups.encode()).hexdigest())
