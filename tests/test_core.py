"""The relational core: golden values, brute force and DuckDB on the smallest tables."""

import collections
import io
import math
import os
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import catalog
from tessera.functions import strings
from tessera.operators import bpe, components, graphs, sequences, statistics
from tessera.plans.prefix import running
from tessera.plans.session import TABLES
from tessera.sources import corpora, files
from tessera.streaming import stateful, windows

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(r[n]) for n in names) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    names = sorted(names)
    assert plain([r.asDict() for r in got.collect()], names) == plain([dict(zip([c[0] for c in want.description], r, strict=True)) for r in want.fetchall()], names)


def test_every_query_without_sql_runs(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() >= 0


def test_average_precision_golden(spark):
    cases = {"a": [], "c": [1, 1, 0, 1], "d": [1, 1, 0, 1, 1], "e": [1]}
    rows = [(k, i, bool(x)) for k, v in cases.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, pos int, rel boolean")
    got = {r.k: r.ap for r in statistics.average_precision(df, "k", [F.asc("pos")], F.col("rel")).collect()}
    assert got == {"c": round((2 + 3 / 4) / 3, 6), "d": round((2 + 4 / 5 + 4 / 5) / 4, 6), "e": 1.0}
    assert statistics.average_precision(df.filter("k = 'e'"), "k", [F.asc("pos")], F.col("rel"), 1).first().ap == 0.5


@pytest.mark.parametrize("low, high, rate, threshold", [([1, 1, 1], [2, 2, 2], 0, 2), ([2, 2, 2], [1, 1, 1], 1, 2), ([1, 1, 1], [1, 1, 1], 1, 1), ([1, 1, 1, 3], [2, 2, 0, 2], 0.25, 2), ([], [1, 4], 0, 1), ([1, 4], [], 0, 5)])
def test_equal_error_rate_golden(spark, low, high, rate, threshold):
    rows = [(i, float(v), h) for i, (v, h) in enumerate([(v, False) for v in low] + [(v, True) for v in high])]
    got = statistics.equal_error_rate(spark.createDataFrame(rows, "id int, score double, high boolean"), "score", "high", ["id"]).first()
    assert (got.rate, got.threshold) == (rate, threshold)


def test_event_score_golden(spark):
    rows = [(1000, 1000, 500, 2000), (1000, 1000, 700, 2000), (1000, 1000, 300, 2000), (10, 1000, 9, 2000)]
    df = spark.createDataFrame(rows, "a long, b long, ab long, n long").select(statistics.g_score(F.col("a"), F.col("b"), F.col("ab"), F.col("n")).alias("g"))
    want = [0, 164.565757010104, -164.565757010104, 3.69672251700842]
    assert all(abs(r.g / 2 - w) < 1e-6 or abs(r.g - w) < 1e-6 for r, w in zip(df.collect(), want, strict=True))


def test_trend_golden(spark):
    up, down = [1, 2, 3, 4, 5, 6, 7, 8], [8, 7, 6, 5, 4, 4, 3, 2]
    rows = [("u", i, float(v)) for i, v in enumerate(up)] + [("d", i, float(v)) for i, v in enumerate(down)]
    got = {r.k: r.slope for r in statistics.trend(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    assert got["u"] == 1.0 and got["d"] < -0.8
    assert statistics.probability_increasing(0) == 0.5 and statistics.probability_increasing(5) > 0.99


def test_running_sums_over_a_global_order(spark):
    rows = [(i, random.Random(i).randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    got = {r.i: r.s for r in running(df, [F.asc("i")], {"s": F.col("v")}).collect()}
    total = 0
    for i, v in rows:
        total += v
        assert got[i] == total


def test_string_functions(spark):
    df = spark.createDataFrame([("one, two,three four",), ("",), ("  x ",), (None,), ("a]b^c-d",)], "s string")
    got = df.select(strings.split(F.col("s"), " ,").alias("p"), strings.trim(F.col("s")).alias("t"), strings.right_substr(F.col("s"), ",").alias("r"), strings.left_substr(F.col("s"), "]^").alias("l")).collect()
    assert got[0].p == ["one", "two", "three", "four"] and got[1].p == [] and got[2].t == "x" and got[3].p is None
    assert got[0].r == "three four" and got[2].r == "" and got[4].l == "a"
    assert [r[0] for r in df.select(strings.rpad(F.col("s"), 3, "x")).collect()][0] == "one, two,three four"
    assert spark.range(1).select(strings.pad(F.lit("ab"), 5, "-")).first()[0] == "--ab-"


def test_window_edge_cases(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [7]), (3, []), (4, [1, 2])], "k int, s array<int>")
    got = [(r.k, r.start, r.window, r.labels) for r in sequences.causal_windows(df, "k", F.col("s"), 3, 2).orderBy("k", "start").collect()]
    assert got == [(1, 0, [1, 2, 3], [2, 3, 4]), (1, 2, [3, 4, 5], [4, 5, -100]), (4, 0, [1, 2, 0], [2, -100, -100])]
    nxt = [(r.t, r.window, r.target) for r in sequences.next_token_windows(df, "k", F.col("s"), 3).filter("k = 1").orderBy("t").collect()]
    assert nxt == [(1, [0, 0, 1], 2), (2, [0, 1, 2], 3), (3, [1, 2, 3], 4), (4, [2, 3, 4], 5)]


def test_graph_operators_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), 1.0) for _ in range(45)]
    df = spark.createDataFrame(edges, "i1 long, i2 long, w double")
    root = {i: i for i in range(60)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    touched = {x for a, b, _ in edges for x in (a, b) if a != b}
    assert {r.node: r.root for r in components.components(df, "i1", "i2").collect()} == {x: find(x) for x in touched}
    assert graphs.has_cycle(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 1)], "parent long, child long"))
    assert not graphs.has_cycle(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "parent long, child long"))


def test_kmeans_separates_squares(spark):
    points = [(3 * c + k, [c * 10 + dx, dy]) for c in range(3) for k, (dx, dy) in enumerate([(0.0, 0.0), (0.5, 0.0), (0.0, 0.5)])]
    _, got = graphs.kmeans(spark.createDataFrame(points, "vec_id long, embedding array<double>"), "vec_id", "embedding", 3)
    groups = collections.defaultdict(set)
    for r in got.collect():
        groups[r.cluster].add(r.vec_id // 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]


def test_bpe_round_trip_and_order(spark):
    texts = ["low lower lowest low", "日本語 日本 ünï", None, "", "a  b\n\tc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    merges = bpe.train(docs, 270)
    assert merges[0] == (ord("l"), ord("o")) or merges[0] < (ord("o"), ord("w"))
    coder = bpe.Coder(merges)
    for r in bpe.encode(docs, merges).collect():
        assert coder.decode(r.ids) == (texts[r.doc_id] or "")
    slow = bpe.learn([("abab", 3), ("aba", 2)], 2)
    assert slow == [(97, 98), (256, 256)] or slow == [(97, 98), (256, 97)]


def test_bpe_trains_where_the_words_lie(spark, monkeypatch):
    """The merges of learn(), in whatever batches they are found, without the word table on the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("aab\u00e9") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (98, None), (99, "aaaaaaa aaaaaa")], "doc_id long, text string")
    want = bpe.learn(sorted((r.word, r.n) for r in bpe.word_table(docs).collect()), 60)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("words reach the driver"))
    assert bpe.train(docs, 256 + 60) == want
    assert bpe.train(docs, 256 + 25, most=5, held=2) == want[:25]
    assert bpe.train(docs.filter("doc_id = 98"), 300) == []
    coder = bpe.Coder(want)
    for t in texts:
        assert coder.encode(t) == [i for p in bpe.SPLIT.findall(t) for i in bpe.Coder(want).piece(p)]


def test_sentinel_files_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "c.txt").write_bytes(b"header\r\n<<<doc>>>\r\nfirst\r\nline  \n\n<<<doc>>>\n\n<<<doc>>>\nsecond <<<doc>>> inside\n")
    assert [(r.text) for r in corpora.documents(spark, str(tmp_path / "d")).orderBy("pos").collect()] == ["first\nline", "second <<<doc>>> inside"]
    rows = [("s", "u\nv", "a"), ("", "q", "b"), ("x", "", "c"), (None, "q2", "b2")]
    corpora.write_records(spark.createDataFrame(rows, "system string, user string, assistant string").coalesce(1), str(tmp_path / "r"))
    got = [(r.system, r.user, r.assistant) for r in corpora.records(spark, str(tmp_path / "r")).orderBy("pos").collect()]
    assert got == [("s", "u\nv", "a"), ("", "q", "b"), ("", "q2", "b2")]
    corpora.write_documents(spark.createDataFrame([("one",), ("two\nlines",)], "text string").coalesce(1), str(tmp_path / "w"))
    assert [r.text for r in corpora.documents(spark, str(tmp_path / "w")).orderBy("pos").collect()] == ["one", "two\nlines"]


def test_sentinel_files_are_read_in_splits(spark, tmp_path):
    """One file over many splits: parts that lie in several come back whole, and no task reads the file."""
    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice("ab\u00e9 ") for _ in range(rng.randrange(1, 40))) + "." for _ in range(rng.choice([1, 1, 2, 60]))) for _ in range(80)]
    (tmp_path / "c.txt").write_bytes("head\r\n".encode() + "".join(f"<<<doc>>>\r\n{t}\n" for t in texts).encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = corpora.documents(spark, str(tmp_path / "c.txt"))
        assert spark.read.text(str(tmp_path / "c.txt")).rdd.getNumPartitions() > 20
        assert [(r.pos, r.text) for r in got.orderBy("pos").collect()] == list(enumerate(texts))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "wholetext" not in plan and got.rdd.getNumPartitions() > 20
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_libsvm_round_trip(spark, tmp_path):
    (tmp_path / "x.svm").write_text("1 1:0.5 3:2 # note\n-1 2:1\n\n")
    df = corpora.libsvm(spark, str(tmp_path / "x.svm"))
    assert sorted((r.label, tuple(sorted(r.features.items()))) for r in corpora.from_zero(df).collect()) == [(-1.0, ((1, 1.0),)), (1.0, ((0, 0.5), (2, 2.0)))]
    corpora.write_libsvm(df, str(tmp_path / "out"))
    assert corpora.libsvm(spark, str(tmp_path / "out")).count() == 2


def test_sniffing(spark):
    heads = [
        ("a.png", b"\x89PNG\r\n\x1a\n..."), ("b.docx", b"PK\x03\x04zz"), ("b.zip", b"PK\x03\x04zz"), ("c.xml", b"<?xml version='1.0'?>"), ("d.html", b"<html >x"), ("e.txt", "Plain text, é.".encode() * 9),
        ("f.bin", bytes(range(256)) * 8), ("g.bmp", b"BMore text"), ("h", b""), ("i.mp4", b"\0\0\0\x18ftypmp42"),
    ]
    got = {r.path: (r.is_text, r.kind) for r in files.classify(spark.createDataFrame(heads, "path string, head binary")).collect()}
    assert got == {
        "a.png": (False, "image"), "b.docx": (False, "office"), "b.zip": (False, "compressed"), "c.xml": (True, "xml"), "d.html": (True, "xml"), "e.txt": (True, "text"), "f.bin": (False, "unknown"),
        "g.bmp": (False, "image"), "h": (False, "unknown"), "i.mp4": (False, "video"),
    }


def test_tensor_container(spark, tmp_path):
    def text(s):
        return struct.pack("<Q", len(s)) + s.encode()

    head = b"GGUF" + struct.pack("<IQQ", 3, 2, 3) + text("general.name") + struct.pack("<I", 8) + text("tiny") + text("n") + struct.pack("<II", 4, 7)
    head += text("list") + struct.pack("<IIQ", 9, 5, 2) + struct.pack("<ii", -1, 2)
    head += text("w") + struct.pack("<I", 2) + struct.pack("<QQ", 32, 4) + struct.pack("<IQ", 8, 0) + text("b") + struct.pack("<I", 1) + struct.pack("<Q", 3) + struct.pack("<IQ", 0, 160)
    path = tmp_path / "m.gguf"
    path.write_bytes(head + b"\0" * 200)
    meta, tensors = files.container(spark, [f"file://{path}"])
    assert {r.key: r.value for r in meta.collect()} == {"general.name": '"tiny"', "n": "7", "list": "[-1, 2]"}
    start = -(-len(head) // 32) * 32
    assert {r.name: (r.dims, r.offset, r.n_bytes) for r in tensors.collect()} == {"w": ([32, 4], start, 136), "b": ([3], start + 160, 12)}
    with pytest.raises(ValueError):
        files.read_header(io.BytesIO(b"nope"))


def test_streaming_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "1 hour", ["event_type"], "365 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling(events, "1 hour", ["event_type"])
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, batch.collect()))


def test_stateful_statistics_and_filter(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    q = stateful.running_stats(stream(), "user_id", "value").writeStream.outputMode("update").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("stats").collect():
        if r.n >= last.get(r.key, (0,))[0]:
            last[r.key] = (r.n, r.mean, r.variance)
    for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect():
        n, mean, variance = last[r.user_id]
        assert n == r.n and abs(mean - r.m) < 1e-9 and abs(variance - (r.v or 0)) < 1e-6
    q = stateful.filtered(stream(), "user_id", "event_id", "value").writeStream.outputMode("append").format("memory").queryName("filtered").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("filtered").count() == events.count()
    f = stateful.Momentum(1.0, 0.1)
    track = [f.update(3.0 * t)[0] for t in range(40)]
    assert abs(track[-1] - 117) < 1.5


def test_murmur_and_geometry(spark):
    from tessera.functions import numeric

    # public test values of the 32-bit hash
    assert numeric.murmur3(b"") == 0 and numeric.murmur3(b"", 1) == 0x514E28B7 and numeric.murmur3(b"test", 0x9747B28C) == 0x704B81DC
    assert numeric.murmur3(b"Hello, world!", 0x9747B28C) == 0x24884CBA
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]])
    assert numeric.convex_hull(square).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]
    pts = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, [(0.0, 0.0)])], "k int, p array<struct<x: double, y: double>>")
    assert [r[0] for r in pts.orderBy("k").select(numeric.polygon_area(F.col("p"))).collect()] == [4.0, 0.0]
    sparse = numeric.sparse_vectors(spark.createDataFrame([(1, i, 1.0) for i in (4, 0, 4, 3, 8, 8, 8, 8)], "k int, i int, v double"), "k", "i", "v")
    assert sparse.first().vector == {0: 1.0, 3: 1.0, 4: 2.0, 8: 4.0}


def test_scalar_queries(spark):
    from tessera.plans import sql

    assert sql.scalar(spark, "SELECT :a + 1", int, a=2) == 3
    for bad in ("SELECT 1, 2", "SELECT id FROM range(2)", "SELECT id FROM range(0)"):
        with pytest.raises(ValueError):
            sql.scalar(spark, bad)


def test_grid_tasks(spark, tmp_path):
    from tessera.sources import tasks

    (tmp_path / "t1.json").write_text('{"train": [{"input": [[1, 2]], "output": [[3]]}, {"input": [[0]], "output": [[9]]}],\n "test": [{"input": [[5]], "output": [[6]]}]}')
    rows = tasks.grid_tasks(spark, str(tmp_path))
    assert sorted((r.task, r.split, r.pos, r.input, r.output) for r in rows.collect()) == [("t1", "test", 0, [[5]], [[6]]), ("t1", "train", 0, [[1, 2]], [[3]]), ("t1", "train", 1, [[0]], [[9]])]
    assert tasks.task_context(rows).first().tokens == [11, 1, 2, 10, 12, 3, 10, 11, 0, 10, 12, 9, 10, 13]


def test_augmentation_and_steadiness(spark):
    from tessera.operators import datasets

    df = spark.createDataFrame([(i, [0, 0] + list(range(5, 25))) for i in range(200)] + [(999, [0, 0])], "k long, seq array<int>")
    out = datasets.augmented(df, "k", "seq", 1.5, 1).collect()
    copies = [r for r in out if r._copy]
    assert len(out) - len(copies) == 201 and 260 <= len(copies) <= 340 and all(r.k != 999 for r in copies)
    assert all(r.seq[:2] == [0, 0] and sum(x == 1 for x in r.seq) <= 16 for r in copies) and any(1 in r.seq for r in copies)
    assert sorted(map(str, out)) == sorted(map(str, datasets.augmented(df, "k", "seq", 1.5, 1).collect()))
    assert datasets.steps_without(np.array([9, 8, 7, 1, 2, 3, 4, 5.0])) >= 5 and datasets.steps_without(np.array([5, 4, 3, 2, 1.0])) == 0
    assert datasets.steps_without(np.array([5, 4, 3, 2, 1.0]), falling=False) == 5


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 50 = 0")
    exact = {(r.src, r.dst) for r in graphs.nearest(queries, rows, 5).collect()}
    close = {(r.src, r.dst) for r in graphs.nearest_by_code(queries, rows, 5).collect()}
    assert len(exact) == 40 and len(exact & close) >= 30
    assert graphs.nearest(queries, rows, 5, block=3).count() == 40


def test_scratch_tables_are_released(spark):
    from tessera.plans import shared

    df = shared.materialize(spark.range(5), "kept")
    assert df.count() == 5 and df.inputFiles()
    shared.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_chat_markup(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (2, 0, "system", "Be kind."), (2, 1, "user", "q")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.text for r in sequences.rendered(turns, "chatml").collect()}
    assert got[1] == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[2] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert {r.conv_id: r.text for r in sequences.rendered(turns, "guanaco").collect()} == {1: "### Human: hi\n### Assistant:yo</s>\n### Human: more\n", 2: "Be kind.\n\n### Human: q\n"}
    one = spark.createDataFrame([("", "u", "a<think>x</think> b <think>open"), ("s", "v", " y ### Human: z")], "s string, u string, a string")
    assert [r[0] for r in one.select(sequences.first_turn("zephyr", F.col("s"), F.col("u"))).collect()][0] == "<|system|>\n</s>\n<|user|>\nu</s>\n<|assistant|>\n"
    assert [r[0] for r in one.select(sequences.next_turn("granite", F.col("u"))).collect()][1] == "\n<|start_of_role|>user<|end_of_role|>v<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>"
    assert [r[0] for r in one.select(sequences.clean_answer("chatml", F.col("a"))).collect()][0] == "a b"
    assert [r[0] for r in one.select(sequences.clean_answer("guanaco", F.col("a"))).collect()][1] == "y"


def test_spectra_and_windows(spark):
    from tessera.functions import signals

    assert np.allclose(signals.window("hann", 8), np.hanning(8)) and np.allclose(signals.window("blackman", 9), np.blackman(9))
    t = np.arange(256)
    wave = np.cos(2 * np.pi * 8 * t / 64)
    df = spark.createDataFrame([(1, [float(v) for v in wave]), (2, []), (3, None), (4, [1.0] * 10)], "k long, v array<double>")
    got = signals.spectra(df, "k", "v", 64, 32).collect()
    assert len(got) == 7 and all(r.k == 1 and int(np.argmax(r.power)) == 8 for r in got)


def test_tensor_blocks():
    from tessera.functions import signals

    def half(x):
        return np.array([x], "<f2").tobytes()

    q = np.arange(16, dtype=np.uint8) | (15 - np.arange(16, dtype=np.uint8)) << 4
    want = np.concatenate([np.arange(16), 15 - np.arange(16)]).astype(float)
    assert signals.decode(half(0.5) + q.tobytes(), 2).tolist() == (0.5 * (want - 8)).tolist()
    assert signals.decode(half(0.5) + half(1.0) + q.tobytes(), 3).tolist() == (0.5 * want + 1).tolist()
    high = np.array([0xFFFF0000], "<u4").tobytes()
    assert signals.decode(half(2.0) + high + q.tobytes(), 6).tolist() == (2 * (want + np.repeat([0, 16], 16) - 16)).tolist()
    assert signals.decode(half(2.0) + half(-1.0) + high + q.tobytes(), 7).tolist() == (2 * (want + np.repeat([0, 16], 16)) - 1).tolist()
    signed = np.arange(-16, 16, dtype=np.int8)
    assert signals.decode(half(0.25) + signed.tobytes(), 8).tolist() == (0.25 * signed).tolist()
    assert signals.decode(np.array([1.5, -2], "<f4").tobytes(), 0).tolist() == [1.5, -2] and signals.decode(half(3.0), 1).tolist() == [3.0]
    assert signals.decode(np.array([0x3FC0], "<u2").tobytes(), 30).tolist() == [1.5]
    with pytest.raises(ValueError):
        signals.decode(b"", 99)
