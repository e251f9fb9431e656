import collections

import numpy as np
from tessera.llm import blocks, cpsjoin, embeddings, substrings
from tessera.operators import components

from tests.llm import cases


def shingles(text):
    ws = (text or "").encode().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def brute_links(sets, threshold=0.8):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def near_docs():
    """Groups of exact and near copies of sizes 1 to 40, and shared passages."""
    rng = np.random.default_rng(4)
    rows, passage = [], cases.prose(99, 60)
    for g, size in enumerate([1, 1, 2, 3, 8, 40, 40]):
        words = cases.prose(g, 200).split(" ")
        for k in range(size):
            own = list(words)
            for _ in range(k % 7):
                own[int(rng.integers(len(own)))] = f"w{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, passage + " " + cases.prose(200 + k, 30)) for k in range(20)]
    return rows


def test_join_against_brute_force(spark):
    rows = near_docs()
    sets = [shingles(t) for _, t in rows]
    links = brute_links(sets)
    n = collections.Counter(x for p in links for x in p)
    root = closure(len(rows), links)
    got = {r.doc_id: (r.n_links, r.class_id, r.keep) for r in cpsjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in range(len(rows))}


def test_join_edge_cases(spark):
    docs = cases.documents(spark)
    got = cpsjoin.join(docs).collect()
    assert len(got) == len(cases.rows())
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.n_links, r.class_id))
    assert by_id[1] == [(3, 1)] and by_id[2] == [(3, 1)] and by_id[3] == [(3, 1)]
    assert by_id[4] == [(0, 4)] and by_id[5] == [(0, 5)] and by_id[10] == [(0, 10)] and by_id[8] == [(0, 8)]
    assert by_id[7] == [(1, 7), (1, 7)] and sorted(by_id[None], key=str) == [(0, None), (3, 1)]
    kept = cpsjoin.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, None, 8, 9, 10, 11]))
    assert cpsjoin.join(cases.empty(spark)).count() == 0


def test_large_dense_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(cpsjoin, "SET_BLOCK", 6)
    monkeypatch.setattr(cpsjoin, "BLOCK", 6)
    monkeypatch.setattr(cpsjoin, "LEAF", 4)
    test_join_against_brute_force(spark)


def shuffled(spark, after=-1):
    """Bytes that stages above a number wrote for shuffles, and the last stage's number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    found = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(x.shuffleWriteBytes() for x in stages if x.stageId() > after), max((x.stageId() for x in stages), default=-1)


def test_sketches_of_classes_that_do_not_split_are_not_exchanged(spark, monkeypatch):
    """A few classes alike split at every depth among many that end early: no depth exchanges all sketches or all rows."""
    monkeypatch.setattr(cpsjoin, "LEAF", 4)
    monkeypatch.setattr(cpsjoin, "DENSE", 2.0)
    monkeypatch.setattr(cpsjoin, "MAX_DEPTH", 6)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng, made, split = np.random.default_rng(6), [], cpsjoin._split
    monkeypatch.setattr(cpsjoin, "_split", lambda *x: made.append(x[2]) or split(*x))
    tokens = rng.integers(0, 1 << 32, (4000, cpsjoin.TOKENS), dtype=np.uint64).astype("<u4")
    tokens[:12, :60] = tokens[0, :60]
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(tokens)]
    classes = cpsjoin.materialize(spark.createDataFrame(rows, "cid long, _cps_sketch binary"), "classes")
    _, last = shuffled(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no side were small
        leaves, depth = cpsjoin._leaves(classes, 0.8, range(2))
        met = sum(x.count() for x in leaves)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert depth == len(made) == 6 and met > 0
    assert shuffled(spark, last)[0] < tokens.nbytes / 2  # a depth's sketches alone would be twice that


def test_jaccard_links_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(60)]
    got = cpsjoin.jaccard_links(sets, 0.6)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            k = len(np.intersect1d(a, b))
            assert got[i, j] == (10 * k >= 6 * (len(a) + len(b) - k))


def test_components_on_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "id long, other long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}


def test_block_deal_meets_every_pair_once(spark):
    rows = spark.createDataFrame([(1, i, 25) for i in range(25)] + [(2, 100 + i, 3) for i in range(3)], "key long, id long, c long")
    seen = collections.Counter()
    for (_, i, j), g in _groups(blocks.deal(rows, "key", "id", "c", 6).collect()):
        mask = blocks.pair_mask(np.array([r._block for r in g]), i == j)
        for a, b in zip(*np.nonzero(mask), strict=True):
            seen[(g[a].id, g[b].id)] += 1
    assert set(seen.values()) == {1} and len(seen) == 25 * 24 + 3 * 2


def _groups(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[(r.key, r._i, r._j)].append(r)
    return out.items()


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 16))
    near = base[:60].repeat(3, 0) + 0.07 * rng.standard_normal((180, 16))
    x = np.concatenate([base, near, base[:5], 2 * base[5:8]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    links = [(i, j) for i in range(len(x)) for j in range(i) if s[i, j]]
    n, root = collections.Counter(a for p in links for a in p), closure(len(x), links)
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0] * 15 + [None]), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0] * 3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), recall=0.999999).collect()}
    assert got == {**{i: (n[i], root[i], root[i] == i) for i in range(len(x))}, **{i: (0, i, True) for i, _ in bad}}
    repeated = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [1.0, -2.0])], "vec_id long, embedding array<double>")
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in embeddings.near_duplicates(repeated).collect()) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)]))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_removal(rows, length):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for s in range(len(w) - length + 1):
                k = tuple(w[s : s + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for s in range(len(w) - length + 1):
                if first[tuple(w[s : s + length])] < i:
                    gone |= set(range(s, s + length))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    passages = [[f"p{rng.integers(50)}" for _ in range(int(rng.integers(5, 40)))] for _ in range(12)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(int(rng.integers(0, 6))):
            ws += passages[int(rng.integers(12))] if rng.random() < 0.7 else [f"q{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 20)))]
        if rng.random() < 0.3 and ws:
            ws[int(rng.integers(len(ws)))] = "edit"
        rows.append((int(rng.integers(0, 100)), " ".join(ws)))
    rows += [(500, "a " * 90), (501, "a " * 70), (502, "a b " * 40)]
    for length in (8, 9, 20):
        got = [tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()]
        assert sorted(got, key=str) == brute_removal(rows, length)


def test_substring_edge_cases(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = [tuple(r) for r in substrings.remove_repeats(cases.documents(spark)).collect()]
    assert sorted(got, key=str) == brute_removal(rows, 50)
    assert substrings.remove_repeats(cases.empty(spark)).count() == 0


def test_segments_of_very_long_texts(monkeypatch):
    w = [f"w{i % 97}".encode() for i in range(2000)]
    whole = substrings.anchors(substrings.Words(w, {}), len(w), 50)
    monkeypatch.setattr(substrings, "SEGMENT", 300)
    cut = substrings.anchors(substrings.Words(w, {}), len(w), 50)

    def places(found):
        return {int(s) + k: int(a) for a, _, s, n in zip(*found, strict=True) for k in range(int(n))}

    assert places(whole) == places(cut)


def test_components_of_any_magnitude(spark):
    """Vectors whose squares overflow or vanish in double precision still link by direction alone."""
    base = [0.3, -1.0, 2.0, 0.7]
    rows = [(1, [x * 1e200 for x in base]), (2, [x * 1e-200 for x in base]), (3, [x * 1.0 for x in base]), (4, [x * 1.7e308 / 2 for x in base[:1] + base[2:3] + base[1:2] + base[3:]])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
