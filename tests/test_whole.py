"""Queries take whole texts and tables: brute force in plain Python, without prefixes and row filters."""

import base64
import collections
import functools
import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import catalog
from tessera.operators import corpus, datasets, graphs, sequences

SF = "/root/testdata/sf0.001"


def run(spark, name, where=SF):
    return catalog.queries()[name](spark, where).collect()


def words(text):
    return [w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]


@pytest.fixture
def small(spark, tmp_path):
    """Texts whose shared words and last characters lie behind the first 40 words."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(50))
    turns = [(1, 0, "user", f"{a} same words at the end"), (1, 1, "assistant", f"{b} same words at the end"), (2, 0, "user", "x y"), (2, 1, "assistant", "y x y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, a), (2, "short"), (3, "é" * 90)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {(t[0], t[1]): t[3] for t in turns}


def test_overlaps_take_whole_texts(spark, small):
    where, texts = small

    def clipped(a, b, n):
        grams = [collections.Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, b)]
        return (grams[0] & grams[1]).total()

    plain, scored = {r.conv_id: r for r in run(spark, "token_overlap", where)}, {r.conv_id: r for r in run(spark, "ngram_overlap", where)}
    for c in (1, 2):
        a, b = words(texts[c, 0]), words(texts[c, 1])
        k = clipped(a, b, 1)
        assert k and (plain[c].precision, plain[c].recall) == (round(k / len(b), 6), round(k / len(a), 6))
        assert plain[c].f1 == round(2 * k / (len(a) + len(b)), 6)
        top = min(len(a), len(b), 4)
        assert abs(scored[c].score - sum(clipped(a, b, n) / (len(b) - n + 1) for n in range(1, top + 1)) / top) < 1e-6


def test_ngrams_are_counted_where_their_row_lies(spark):
    rows = [(1, ["a", "b", "a", "b"], ["a", "b", "c"]), (2, [], ["a"]), (3, None, ["a"]), (4, ["x", "y"], ["x", "y"]), (5, ["a"] * 3000, ["a"] * 2000)]
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = sequences.ngram_overlap(df, ["k"], F.col("a"), F.col("b"))
    assert {r.k: r.score for r in got.collect()} == {1: round((2 / 3 + 1 / 2 + 0) / 3, 6), 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_where_their_row_lies(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "a", "c", "a"]), (2, [], ["a"]), (3, ["a"], None), (4, ["x"] * 3000, ["x"] * 1000)], "k int, a array<string>, b array<string>")
    got = sequences.overlap(df, ["k"], F.col("a"), F.col("b"))
    assert {r.k: (r.precision, r.recall) for r in got.collect()} == {1: (0.5, 2 / 3), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 1 / 3)}
    assert {r.k: round(r.f1, 6) for r in got.collect()} == {1: round(4 / 7, 6), 2: 0.0, 3: 0.0, 4: 0.5}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_hashes_and_augmentation_take_whole_texts(spark, small):
    where, _ = small
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    assert {r.doc_id: r.b for r in run(spark, "hash_functions", where)} == {k: base64.b64encode(t.encode()).decode() for k, t in texts.items()}
    assert [len(r.seq) for r in datasets._ids(spark, where).collect()] == [60]


def test_sections_hold_the_rest_of_a_text(spark, tmp_path):
    texts = {1: "x" * 80 + "rest " * 100 + "\n### Own heading\nbody of it\nand more", 2: "short", 3: "y" * 81}
    spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").withColumn("source", F.lit("web")).write.parquet(f"{tmp_path}/documents.parquet")
    want, rebuilt = {}, {}
    for k, t in texts.items():
        text = f"Of web\n### Summary\n{t[:80]}\n### En\n{t[80:]}"
        heads = list(re.finditer(r"^###\s+(.+?)\s*$", text, re.M))
        ends = [h.start() for h in heads[1:]] + [len(text)]
        want[k] = [(0, "", text[: heads[0].start()])] + [(i, h[1], text[h.end() : e]) for i, (h, e) in enumerate(zip(heads, ends, strict=True), 1)]
        joined = "".join(b if not h else f"### {h}\n{b}" for _, h, b in want[k] if h != "Summary")
        rebuilt[k] = re.sub(r"\n{3,}", "\n\n", joined).strip()
    got = run(spark, "split_sections", str(tmp_path))
    assert {k: sorted((r.pos, r.heading, r.body) for r in got if r.doc_id == k) for k in texts} == want
    assert {r.doc_id: r.text for r in run(spark, "rebuild_answer", str(tmp_path))} == rebuilt


def test_texts_without_headings_and_dropped_sections(spark):
    df = spark.createDataFrame([(1, "no heading\n####x"), (2, ""), (3, None), (4, "### A\nx\n### B\n"), (5, "### A\nonly")], "k int, t string")
    got = sorted((r.k, r.pos, r.heading, r.body) for r in corpus.sections(df, "k", "t").collect())
    assert got == [(1, 0, "", "no heading\n####x"), (2, 0, "", ""), (3, 0, "", ""), (4, 1, "A", "\nx\n"), (4, 2, "B", ""), (5, 1, "A", "\nonly")]
    assert {r.k: r.text for r in corpus.without_sections(df, "k", "t", [" a "]).collect()} == {1: "no heading\n####x", 2: "", 3: "", 4: "### B", 5: ""}
    assert {r.k: r.t for r in corpus.without_sections(df, "k", "t", []).collect()}[4] == "### A\nx\n### B\n"


CLEANED = (
    ("According to the notes of May: The rest stays.", "The rest stays."),
    ("Before <!-- hidden\nlines --> after", "Before after"),
    ("Top. This Page Intentionally Left Blank. Bottom", "Top. Bottom"),
    ("Name |---|:--:| value", "Name value"),
    ("left | | right", "left right"),
    ("one ==== two", "one two"),
    ("see T H I S O N E L I N E now", "see now"),
    ("x | y", "x y"),
    ("bell\x07 rings", "bell rings"),
    ("wide\u00a0\t gap", "wide gap"),
    ("up  \n  down", "up\ndown"),
    ("a\n\n\n\nb", "a\n\nb"),
    (" ;: edge ,", "edge"),
    ("", ""),
    (None, ""),
)
WHOLE = (
    ("fragment of a. Then it starts. And ends. tail without", "Then it starts. And ends."),
    ("no sentence", "no sentence"),
    ("x. Y", "Y"),
    ("One. two three four five six seven", "One. two three four five six seven"),
    ("", ""),
)


def test_every_rule_of_cleaning(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "i int, t string").select("i", corpus.cleaned(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: c for i, (_, c) in enumerate(CLEANED)}
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WHOLE)], "i int, t string").select("i", corpus.whole_sentences(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: w for i, (_, w) in enumerate(WHOLE)}


def test_cuts_pass_only_texts_that_show_their_sign(spark):
    rng = random.Random(4)
    parts = ["|", "  ", "\t", " \n ", "\n\n\n", "\f", "\u00a0", "----", "_=.-", "<!-- x", "-->", "a", " A B C D E F G H I J K", "According to ", ":", "THIS page intentionally LEFT blank", "continued from Previous page.", "\x07", "\u200b", "\u00e9", "it's", "-'", ". ", "\u65e5\u672c"]
    texts = ["According to "[: 13 * (i % 2)] + "".join(rng.choice(parts) for _ in range(rng.choice((2, 9, 40)))) for i in range(600)]
    t = F.col("t")
    plain = functools.reduce(lambda x, c: F.regexp_replace(x, *c), corpus.CUTS, t)
    word, run = "[a-z][a-z\\-']*", "[^ \t\n\f\r]+"
    key = F.sha1(F.trim(F.regexp_replace(F.lower(t), "[ \t\n\r]+", " ")).cast("binary"))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    same = [corpus.cleaned(t) == F.btrim(plain, F.lit(" ;:,\n\t")), corpus.words(t) == F.regexp_extract_all(F.lower(t), F.lit(word), F.lit(0)), corpus.runs(t) == F.regexp_extract_all(t, F.lit(run), F.lit(0)), corpus.copy_key(t) == key]
    assert df.filter(~functools.reduce(lambda a, b: a & b, same)).count() == 0


def test_long_rows_of_cells_and_blanks(spark):
    texts = [("cells", "left" + " |" * 50000 + " right"), ("blanks", "left" + " " * 200000 + "right"), ("one cell", "left |" + " " * 200000 + "right")]
    began = time.time()
    got = spark.createDataFrame(texts, "k string, t string").select("k", corpus.cleaned(F.col("t")).alias("c")).collect()
    assert {r.k: r.c for r in got} == {k: "left right" for k, _ in texts}
    assert time.time() - began < 30  # not with the square of a run


def test_rejected_texts_are_not_joined(spark):
    docs = spark.createDataFrame([(i, "en", "Short") for i in range(5)] + [(9, "en", None)], "doc_id long, lang string, text string")
    got = corpus.judged(docs)
    assert sorted((r.doc_id, r.n_chars, r.reject_reason) for r in got.collect()) == [(i, 5, "too_short") for i in range(5)] + [(9, 0, "no_text")]
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_composed_forms(spark):
    rows = [(1, "ﬁne ① text."), (2, None), (3, "e\u0301"), (4, "plain")]
    assert [r.t for r in corpus.nfkc(spark.createDataFrame(rows, "i int, t string"), "t").orderBy("i").collect()] == ["fine 1 text.", None, "é", "plain"]


def test_composed_forms_take_few_rows_at_a_time(spark):
    rows = [(i, "\ufb01 " * (i % 7) if i % 5 else None) for i in range(1300)]
    got = corpus.nfkc(spark.createDataFrame(rows, "i int, t string"), "t")
    assert {r.i: r.t for r in got.collect()} == {i: t if t is None else t.replace("\ufb01", "fi") for i, t in rows}
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # whole batches of 10,000 texts as Python strings


def test_reasons_in_their_order(spark):
    body = "The committee met in the old hall, and every member spoke about plans for the coming year; nobody left before the end. "
    base = " ".join(f"{body}Point {w} was read." for w in ("alpha", "beta", "gamma", "delta"))
    texts = [base, base.upper(), "", "Short one.", base.replace("Point beta was read.", "Any mention of commercial products is for information only."), "1234 5678 " * 80, "word " * 100 + ".", " ".join(a + b for a in "abcdefghijkl" for b in "mnopqrstuv")]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.reject_reason for r in corpus.judged(docs).collect()}
    assert got == {0: "kept", 1: "duplicate", 2: "no_text", 3: "too_short", 4: "boilerplate", 5: "alpha", 6: "diversity", 7: "fragments"}


def test_murmur_of_many_strings(spark):
    from tessera.functions.numeric import hashed, murmur3, murmur3_all

    values = [b"", b"a", b"abcd", b"abcde", b"x" * 1001, "日本".encode()] * 3
    assert murmur3_all(values, 7).tolist() == [murmur3(v, 7) for v in values] and murmur3_all([]).tolist() == []
    rows = hashed(spark.createDataFrame([(None,), ("ab",), ("",)], "s string"), "s").collect()
    assert {r.s: r.murmur for r in rows} == {None: None, "ab": murmur3(b"ab"), "": 0}


def test_matrices_take_all_suppliers(spark, tmp_path):
    lines = [(i % 3 + 1, j, float(i * j % 7 + 1)) for i in range(9) for j in (1, 2, 39, 40, 55, 900)]
    spark.createDataFrame(lines, "l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(j, j / 2) for j in (1, 2, 39, 40, 55, 900)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    m = collections.defaultdict(float)
    for i, j, v in lines:
        m[i, j] += v
    where, rows = str(tmp_path), range(1, 4)
    suppliers = {j for _, j in m}
    assert {r.i: r.v for r in run(spark, "matrix_vector", where)} == {i: sum(m[i, j] * j / 2 for j in suppliers) for i in rows}
    assert {(r.i, r.j): r.v for r in run(spark, "matrix_product", where)} == {(a, b): sum(m[a, j] * m[b, j] for j in suppliers) for a in rows for b in rows}
    assert run(spark, "matrix_trace", where)[0].trace == m[1, 1] + m[2, 2]


def test_graphs_and_assignments_take_all_lines(spark, tmp_path):
    lines = [(s, p, float(q)) for q, (s, p) in enumerate([(1, 10), (1, 11), (2, 11), (2, 12), (3, 20), (3, 21), (4, 21), (4, 22), (4, 20)], 1)]
    where = str(tmp_path)
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").withColumn("l_orderkey", F.col("l_suppkey")).write.parquet(f"{where}/lineitem.parquet")
    spark.createDataFrame([(s, s % 2) for s in range(1, 5)], "s_suppkey long, s_nationkey long").write.parquet(f"{where}/supplier.parquet")
    spark.createDataFrame([(p, p % 4 + 1, f"b{p % 3}") for _, p, _ in lines], "p_partkey long, p_size int, p_brand string").distinct().write.parquet(f"{where}/part.parquet")
    assert {(r.node, r.root) for r in run(spark, "connected_components", where)} == {(p, 10) for p in (10, 11, 12)} | {(p, 20) for p in (20, 21, 22)}
    assert {(r.root, r.n) for r in run(spark, "component_sizes", where)} == {(10, 3), (20, 3)}
    edges = {(-p, s) for s, p, _ in lines}
    wed = {(x, y) for x, s in edges for y, t in edges if s == t and x < y}
    assert {(r.a, r.b) for r in run(spark, "moral_graph", where)} == edges | wed
    scores, got = collections.defaultdict(lambda: collections.defaultdict(float)), collections.defaultdict(float)
    for s, p, q in lines:
        scores[p % 4 + 1][s % 2, f"b{p % 3}"] += q
    for r in run(spark, "best_assignment", where):
        got[r.g] += r.score
    brands = [f"b{k}" for k in range(3)]
    assert got == {g: max(sum(pairs.get((a, b), 0.0) for a, b in zip((0, 1), order)) for order in itertools.permutations(brands, 2)) for g, pairs in scores.items()} and 4 in got


def test_code_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(8000, 64)) * rng.uniform(0.5, 2, 64))], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 200 = 0")
    exact = {(r.src, r.dst) for r in graphs.nearest(queries, rows, 5).collect()}
    assert len(exact) == 200 and len(exact & {(r.src, r.dst) for r in graphs.nearest_by_code(queries, rows, 5).collect()}) >= 180


def test_code_neighbours_of_the_whole_table(spark):
    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no test tables")
    exact, close = ({(r.src, r.dst) for r in run(spark, name, where)} for name in ("nearest_neighbours", "nearest_by_code"))
    assert len(exact) == 200 and len(exact & close) >= 180


def test_edit_similarity_counts_code_points(spark):
    """DuckDB's distance counts bytes, so plain rows decide."""
    pairs = [("kitten", "sitting"), ("é日x", "e日"), ("", ""), ("abc", ""), ("same", "same")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.s for r in df.select("i", sequences.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(abs(got[i] - (1 - distance(a, b) / max(len(a), len(b)) if a or b else 1)) < 1e-12 for i, (a, b) in enumerate(pairs))


def test_clusters_by_distance_and_by_angle(spark):
    rng = np.random.default_rng(4)
    centre = np.array([[5.0, 0], [0, 5.0], [-5.0, -5.0]])
    points = [(i, (centre[i % 3] * (1 + i % 4) + rng.normal(size=2) * 0.1).tolist()) for i in range(60)]
    df = spark.createDataFrame([(100, [0.0, 0.0]), *points], "id long, v array<double>")
    centres, near = graphs.angular(df, "id", "v", 3)
    label = {r.id: r.cluster for r in near.collect()}
    assert 100 not in label and len({(i % 3, label[i]) for i in range(60)}) == 3 and np.allclose(np.linalg.norm(centres, axis=1), 1)
    flat = spark.createDataFrame([(i, (centre[i % 3] + rng.normal(size=2) * 0.1).tolist()) for i in range(60)], "id long, v array<double>")
    label = {r.id: r.cluster for r in graphs.kmeans(flat, "id", "v", 3)[1].collect()}
    assert len({(i % 3, label[i]) for i in range(60)}) == 3
