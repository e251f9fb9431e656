"""Properties that hold for any input."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import cpsjoin, html, packing, quality, records, secrets, substrings, tokens
from tessera.llm.crc32c import crc32c_words, masked

TEXT = st.text(st.sampled_from("ab cé日🙂\n\t.#<>&;/=:'\"-AKI0f"), max_size=200)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_ids_decode_to_the_text(text):
    enc = tokens.encoder(tokens.default_path())
    ids = np.frombuffer(enc.ids(text), enc.dtype).tolist()
    assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.tokenizer.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: b + bytes(-len(b) % 4)), max_size=12), st.integers(0, 1 << 40))
def test_frames_round_trip(payloads, offset):
    data, index = records.frame(payloads, offset) if payloads else (b"", b"")
    entries = np.frombuffer(index, "<u8").reshape(-1, 2)
    assert records.unframe(data, entries, offset) == payloads
    assert len(data) == sum(len(p) + 16 for p in payloads)


def test_mask_is_the_public_one():
    crc = crc32c_words(b"12345678", np.array([0]), np.array([2]))
    x = int(crc[0])
    assert int(masked(crc)[0]) == (((x >> 15) | (x << 17)) + 0xA282EAD8) & 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_any_order_packs_without_overlap(sizes):
    placer, rows = packing.Placer(64), {}
    for n in sizes:
        at, offset = placer.place(n)
        assert offset == sum(rows.get(at, []))
        rows.setdefault(at, []).append(n)
    assert all(sum(r) <= 64 for r in rows.values())
    assert sum(sum(r) <= 32 for r in rows.values()) <= 1 or not sizes


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_scans_and_extraction_never_fail(text):
    spans = secrets.scan(text)
    assert all(0 <= a < b <= len(text) for _, a, b in spans) and spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))
    assert secrets.redact(text, []) == text
    out = html.extract(text)
    assert out == "\n".join(" ".join(x.split()) for x in out.split("\n")) or not out
    assert quality.measure(text.encode())[0][0] == len(text.encode().split())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), min_size=1, max_size=60), st.integers(1, 20))
def test_range_hashes_follow_content(words, k):
    w = substrings.Words(words, {})
    n = len(words) - k + 1
    if n > 0:
        got = w.ranges(np.arange(n), k).tolist()
        seen = {}
        for i, h in enumerate(got):
            assert seen.setdefault(tuple(words[i : i + k]), h) == h
        assert len(set(got)) == len(seen)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=80), st.integers(1, 30))
def test_sliding_minimum(values, width):
    x = np.array(values, dtype=np.uint64)
    if width <= len(x):
        assert substrings.least(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=30, deadline=None)
@given(st.text(st.sampled_from("ab c"), max_size=60))
def test_shingle_sets_are_sorted_and_stable(text):
    s = cpsjoin.shingle_set(text.encode())
    assert (np.diff(s.astype(object)) > 0).all() and s.tolist() == cpsjoin.shingle_set((text + " ").encode()).tolist()
    assert cpsjoin.sketch(s) == cpsjoin.sketch(s[::-1].copy()) and zlib.crc32(cpsjoin.sketch(s)) >= 0


def test_recall_plan_meets_its_target():
    """Simulated chosen paths at similarity 0.8: the planned runs find at least the recall asked for."""
    rng = np.random.default_rng(0)
    runs = cpsjoin.runs_for(0.8, 0.99)
    found = 0
    for trial in range(300):
        a = rng.integers(0, 1 << 32, cpsjoin.TOKENS, dtype=np.uint64).astype("<u4")
        b = a.copy()
        b[rng.random(cpsjoin.TOKENS) > 0.8] ^= 1
        tokens_ = np.stack([a, b])
        met = False
        for r in range(runs):
            nodes = np.array([trial * 1000 + r + 1], dtype=np.uint64)
            for _ in range(3):
                if not len(nodes):
                    break
                _, left = cpsjoin.children(nodes, np.repeat(tokens_[:1], len(nodes), 0), 0.8)
                _, right = cpsjoin.children(nodes, np.repeat(tokens_[1:], len(nodes), 0), 0.8)
                nodes = np.intersect1d(left, right)
            met |= bool(len(nodes))
        found += met
    assert found >= 297


def test_recall_plan_meets_its_target_at_the_last_depth(spark, monkeypatch):
    """Nodes that split MAX_DEPTH times get the runs that this depth takes, and simulated paths that long find the recall asked for."""
    made, split = [], cpsjoin._split

    def counted(rows, threshold, runs):
        made.append(0 if runs is None else runs if isinstance(runs, int) else len(runs))
        return split(rows, threshold, runs)

    monkeypatch.setattr(cpsjoin, "_split", counted)
    monkeypatch.setattr(cpsjoin, "LEAF", 1)
    monkeypatch.setattr(cpsjoin, "DENSE", 2.0)
    monkeypatch.setattr(cpsjoin, "MAX_DEPTH", 9)
    shared_ = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{shared_} own{i}") for i in range(12)], "doc_id long, text string")
    assert {r.n_links for r in cpsjoin.join(docs).collect()} == {11}
    assert sum(made) == cpsjoin.runs_for(0.8, 0.99, 9) > cpsjoin.runs_for(0.8, 0.99)

    rng, found, runs = np.random.default_rng(1), 0, cpsjoin.runs_for(0.8, 0.99, 12)
    for trial in range(600):
        a = rng.integers(0, 1 << 32, cpsjoin.TOKENS, dtype=np.uint64).astype("<u4")
        b = a.copy()
        b[rng.permutation(cpsjoin.TOKENS)[:13]] ^= 1  # 51 of 64 tokens agree, as near to 0.8 as they come
        met = False
        for r in range(runs):
            nodes = np.array([trial * 1000 + r + 1], dtype=np.uint64)
            for _ in range(12):
                if len(nodes):
                    nodes = np.intersect1d(*(cpsjoin.children(nodes, np.repeat(x[None], len(nodes), 0), 0.8)[1] for x in (a, b)))
            met |= bool(len(nodes))
        found += met
    assert found >= 0.98 * 600
