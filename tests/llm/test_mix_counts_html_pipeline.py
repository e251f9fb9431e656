import collections
import hashlib
import math
import random
import re
import time

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from tessera.llm import counts, html, mixing, quality, tokens
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm import cases


def goals(spark, sizes, weights, share, most):
    parts = spark.createDataFrame([(i % 2, f"s{k:03}", n // 2 if i < 2 else n - n // 2) for k, n in enumerate(sizes) for i in (0, 3)], f"{mixing._PART} long, {mixing._SOURCE} string, n long")
    return [(r.source_size, r.target) for r in mixing._goals(parts, weights, share, most).orderBy("_mix_rank").collect()]


def test_targets_fill_by_weight_and_stop_at_caps(spark):
    t = goals(spark, [100, 1000, 0, 10], [5, 2, 1, 5], 1.5, 2)
    assert t == [(100, 200.0), (1000, 1445.0), (0, 0.0), (10, 20.0)] and sum(x for _, x in t) == 1.5 * 1110
    assert goals(spark, [], [5], 1.5, 2) == [] and goals(spark, [7], [5], 3.0, 2) == [(7, 14.0)] and goals(spark, [0], [5], 1.5, 2) == [(0, 0.0)]


def test_mix_of_many_sources(spark):
    """As many sources as documents: targets by the plain loop over all sources."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), f"host{i % 700:04}") for i in range(1400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = brute_mix(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].copies == taken[i] for i in range(len(rows)))


def test_mix_edge_cases(spark):
    docs = cases.documents(spark)
    rows = mixing.mix(docs).collect()
    sizes = {len((r[1] or "").encode().split()) for r in cases.rows()}
    assert len(rows) == len(cases.rows()) and all(r["size"] in sizes and r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert 0 <= 1.5 * total - sum(r.taken for r in rows) <= max(r["size"] for r in rows)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len((r.text or "").encode().split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mix_near_targets_with_a_hot_source(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 40), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["source"]).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 80 for s in target)


def test_counts_equal_the_library():
    import public_tokenizers

    vocab, has_bytes = counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert has_bytes and not {"<s>", "</s>", "<unk>", "<0x41>"} & {p for p, _ in vocab}
    in_bytes = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    rng = random.Random(0)
    texts = [cases.prose(1, 300), "", " ", "  a  b ", "日本語 テキスト 🙂🙂 x", "\n\n a\tb", "▁▁a b▁c"]
    texts += ["".join(rng.choice("abe 🙂ñ\nth<0x>▁日é") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    small = [("▁", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("▁a", -4.0), ("ba", -1.5), ("aba", -3.0)]
    for v, fallback in ((vocab, True), (vocab, False), (small, False)):
        tk = Tokenizer(models.Unigram((in_bytes if fallback else in_bytes[:1]) + v, unk_id=0, byte_fallback=fallback))
        tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement=counts.MARK, prepend_scheme="always")
        c = counts.Counter(v, fallback)
        for t in texts:
            assert c.count(t) == len(tk.encode(t, add_special_tokens=False).ids), t
    c = counts.Counter(vocab, has_bytes)
    assert c.count("a<s>") > 2 and c.count("<0x41>") > 2  # markup of the file is plain text here


def test_count_edge_cases(spark):
    got = counts.count_tokens(cases.documents(spark)).collect()
    assert len(got) == len(cases.rows()) and all(r.n_tokens == 0 for r in got if not r.text)
    assert counts.count_tokens(cases.empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site, name.</h2></header><nav><ul><li><a href="/a">Menu, one.</a></li></ul></nav><div class="ad">Buy, now. Really, do.</div>
<div id="cookie-notice"><p>We use cookies, you know. Accept, please.</p></div>
<article><h1>The &amp; title</h1><p><b>First   paragraph, with
 words. And more, too.<br><p>Second&nbsp;one &lt;here&gt;, long enough. Yes.</p><form><p>Sign up, now. Do it.</p></form>
<ul><li>point one,<li>point two.</ul><div class="comments"><p>I disagree, strongly. With all of this, at length. Truly, I do.</p></div></article>
<aside><p>Other, articles. To read, maybe.</p></aside><footer>&copy; All, rights. Reserved.</footer></body></html>"""


def test_page_parts():
    assert html.extract(PAGE) == "The & title\nFirst paragraph, with words. And more, too.\nSecond one <here>, long enough. Yes.\npoint one,\npoint two."
    assert html.extract(PAGE.replace("article>", "section>")) == html.extract(PAGE)
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("plain words") == "plain words" and html.extract("<p>cut of<") == "cut of<"


def test_pages_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<p>" + "word, " * 50_000 + "</p>", "z")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(len(r.text) for r in got) == sorted([0, 0, len(html.extract(PAGE)), len(html.extract(PAGE)), 300_000 - 1])
    assert html.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = cases.documents(spark)
    first = corpus_pipeline.quality_rules(spark, docs, "")
    verdict = quality.judge(docs.select("doc_id", "text", "lang")).filter("kept").count()
    assert first.columns == docs.columns and first.count() == verdict
    second = corpus_pipeline.near_duplicates(spark, first, "")
    assert sorted(str(r.doc_id) for r in second.collect()) == sorted(map(str, [1, 6, 7, 9, None]))
    third = corpus_pipeline.secret_scan(spark, second, "")
    assert third.columns == docs.columns and third.count() == second.count()
    fourth = corpus_pipeline.source_mix(spark, third, "").collect()
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(fourth, docs.schema), "").collect()
    assert {str(r.doc_id) for r in packed} == {str(r.doc_id) for r in fourth}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), "").count() == 0, name


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_kept(text, lang):
    """The quality verdict from its definition."""
    ws = words_of(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = collections.Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    if len(ws) < 50 or 100 * len(again) > 50 * len(ws):
        return False

    def distance(p, q):
        total = 0.0
        for a, b in zip(p, q, strict=True):
            m = (a + b) / 2
            total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
        return math.sqrt(max(0.0, total / 2))

    def kind(c):
        if c in quality.SENTENCE:
            return "sentence"
        if c in quality.SYMBOLS:
            return "symbol"
        return "capital" if c.isupper() or c.istitle() else "letter" if c.isalpha() else "digit" if c.isnumeric() else "space" if c.isspace() else "other"

    chars = collections.Counter(map(kind, text))
    lines = [v for k, v in quality.CLASS_SHARES.items() if lang in (None, k)]
    if len(text) >= 200 and lines and min(distance([chars[k] / len(text) for k in quality.CLASSES], v) for v in lines) > quality.MAX_CLASS_DISTANCE:
        return False
    if len(ws) >= 150 and (lang is None or lang in quality.COMMON):
        plain = collections.Counter(w.strip(".,;:!?'\"()[]").lower() for w in ws if len(w.encode()) < 12)
        found = []
        for line in quality.COMMON.values():
            share = [0.06 / (j + 1) ** 0.85 for j in range(len(line.split()))]
            p = [plain[w] / len(ws) for w in line.split()]
            found.append(distance([*p, 1 - sum(p)], [*share, 1 - sum(share)]))
        return min(found) <= quality.MAX_COMMON_DISTANCE
    return True


def brute_mix(rows):
    """[(row, copies)] by a straight queue; rows are (doc_id, text, source)."""
    size = [len(words_of(r[1])) for r in rows]
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(size), {s: 0.0 for s in order if not total[s]}
    while True:
        open_ = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * total[s]
            left -= capped[s]
    target = {s: capped.get(s, level * weight[s]) for s in order}
    queue = []
    for rank, s in enumerate(order):
        own = [i for i, r in enumerate(rows) if r[2] == s]
        own.sort(key=lambda i: (int(hashlib.md5(f"mix:{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:15], 16), rows[i][0] is not None, rows[i][0] or 0, size[i]))
        for copy in range(2):
            upto = 0
            for i in own:
                upto += size[i]
                if size[i] and target[s]:
                    queue.append(((copy * total[s] + upto) / target[s], rank, i))
    taken, budget = collections.Counter(), 1.5 * sum(size)
    for _, _, i in sorted(queue):
        if size[i] > budget:
            break
        budget -= size[i]
        taken[i] += 1
    return taken


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    from tests.llm.test_joins import brute_links, closure, near_docs, shingles
    from tests.llm.test_quality_secrets import plain_spans

    rng = random.Random(7)
    rows = [(i, t + (" password=hunter2hunter2 " if i % 5 == 0 else ""), rng.choice(["en", None, "xx"]), rng.choice(["a", "b", "b", "b", None])) for i, t in near_docs()]
    rows += [(1000 + k, cases.prose(300 + k, 120).replace(" ", "### "), "en", "a") for k in range(5)]
    rows += [(2000, "", "en", "a"), (2001, None, "en", "b"), (2002, "short", None, None), (2003, cases.prose(400, 9000), "en", "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()

    kept = [r for r in rows if brute_kept(r[1], r[2])]
    sets = [shingles(r[1]) for r in kept]
    root = closure(len(kept), brute_links(sets))
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    clean = []
    for r in kept:
        text, spans = r[1], []
        for _, a, b in plain_spans(text):
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        for a, b in reversed(spans):
            text = text[:a] + "[secret]" + text[b:]
        clean.append((r[0], text, r[3]))
    taken = brute_mix(clean)
    enc = tokens.encoder(tokens.default_path())
    want, made = collections.Counter(), collections.Counter()
    for i, n in taken.items():
        want[(clean[i][0], tuple(enc.tokenizer.encode(clean[i][1], add_special_tokens=False).ids + [0]))] += n
    assert len(want) > 20 and max(taken.values()) == 2
    pieces = collections.defaultdict(list)
    fill = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, enc.dtype)
        assert len(ids) == r.length
        pieces[(r.doc_id, r.piece)].append((r.start, tuple(ids.tolist())))
        fill[r.sequence_id].append((r.offset, r.length))
    for doc_id in {d for d, _ in pieces}:
        parts = [pieces[(doc_id, k)] for k in range(sum(d == doc_id for d, _ in pieces))]
        assert len({len(p) for p in parts}) == 1 and all(len(set(p)) == 1 for p in parts)
        whole = ()
        for p in parts:
            assert p[0][0] == len(whole)
            whole += p[0][1]
        made[(doc_id, whole)] += len(parts[0])
    assert made == want
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_page_layouts():
    p = "The quick brown fox, having jumped over the dog, went home. It was late, and the moon was up."
    unmarked = f"<body><table><tr><td><a>m1</a><br><a>m2</a></td><td><div><h2>T</h2><div><p>{p}</p><p>{p}</p></div><p>Last, words here. Done.</p></div></td></tr></table><div>small foot</div>"
    assert html.extract(unmarked) == f"T\n{p}\n{p}\nLast, words here. Done."
    by_names = (
        f'<div id="header"><p>Best site, ever.</p></div><div class="nav"><ul><li><a>Home</a><li><a>News</a></ul></div><div id="content"><h1>My title</h1><p>By A. Writer, today.</p><p>{p * 3}</p><ul><li>First.</li><li>Second.</li></ul></div>'
        f'<div id="sidebar"><p>{p * 2}</p></div><div id="comments"><div class="comment"><p>{p * 5}</p></div></div><div id="footer">Copyright, all rights.</div>'
    )
    assert html.extract(by_names) == f"My title\nBy A. Writer, today.\n{p * 3}\nFirst.\nSecond."
    inside = f'<main><article class="post has-sidebar"><header class="entry-header"><h1>T</h1></header><p>{p}</p><div class="advertisement"><p>Buy, now.</p></div><table><tr><td>a</td><td>b</td></tr></table><form><label>Mail</label></form><pre>code  here</pre></article><section class="comments"><p>{p * 9}</p></section></main>'
    assert html.extract(inside) == f"T\n{p}\na b\ncode here"
    short = "<nav><a>Menu one</a></nav><article><h1>Hi</h1><p>Ok</p></article><footer>All rights, reserved. More, text here, longer than the article.</footer>"
    assert html.extract(short) == "Hi\nOk"


def test_wrapped_articles_and_cut_tags_are_whole():
    p = "Words of a sentence, with marks. And one more of them, here."
    body = f"<h1>T</h1><p>{p}</p><p>{p}</p>"
    want = f"T\n{p}\n{p}"
    for wrapped in (f"<form><article>{body}</article></form>", f"<form><div>{body}</div></form>", f"<div class='layout-sidebar-right'><main>{body}</main></div>", f"<div class='elementor-widget-container'>{body}</div>"):
        assert html.extract(f"<body><nav>Home</nav>{wrapped}<footer>Foot</footer></body>") == want, wrapped
    for tag in ("<svg class='i'/>", "<math/>", "<svg-icon name='a'></svg-icon>", "<title-bar></title-bar>"):
        assert html.extract(f"<body><article><h1>T</h1><p>{p}</p>{tag}<p>{p}</p></article></body>") == want, tag
    assert html.extract(f"<body><article>{body}<svg><text>in it</text></svg></article></body>") == want
    assert html.extract(f"<body><article>{body}</article><form><p>{p}</p></form><div class='comments'><article>{p * 9}</article></div></body>") == want
    parts = f"<div><div>{f'<p>{p}</p>' * 8}</div>{"<div class='by'>x</div>" * 9}<p>{p}</p></div>"
    assert html.extract(f"<body>{parts}</body>") == "\n".join([p] * 9)


def test_pages_keep_all_of_the_article():
    p = "The quick brown fox, having jumped over the dog, went home. It was late, and the moon was up."
    pages = [
        (f"<main><header><h1>Title</h1></header><p>{p}</p></main>", f"Title\n{p}"),
        (f"<body><form><h1>T</h1><p>{p}</p><p>{p}</p></form></body>", f"T\n{p}\n{p}"),
        (f"<main><article><h2>A</h2><p>{p}</p></article><article><h2>B</h2><p>{p*4}</p></article></main>", f"A\n{p}\nB\n{p*4}"),
        (f"<body><article><h2>A</h2><p>{p}</p></article><article><h2>B</h2><p>{p*4}</p></article></body>", f"A\n{p}\nB\n{p*4}"),
        (f"<article><p>{p}</p><p title='hidden gems'>{p}</p></article>", f"{p}\n{p}"),
        (f"<article><p>{p}</p><section class='related-work'><h2>Related work</h2><p>{p}</p></section><section id='share-price'><p>{p}</p></section><section class='search-trees'><h3>Trees</h3><p>{p}</p></section></article>", "\n".join([p,"Related work",p,p,"Trees",p])),
        (f"<article><h1>T</h1><p>{p}</p><ul><li>One</li><li>Two</li></ul><p><a href='x'>Linked paragraph</a></p><h2><a href='#s'>Section</a></h2><p>{p}</p><div class='share'><a href='f'>Facebook</a></div><ul class='related-posts'><li><a href='1'>Another one</a></li></ul></article>", f"T\n{p}\nOne\nTwo\nLinked paragraph\nSection\n{p}"),
        (f"<div class='comments'><p>{p*9}</p></div><div><p>{p}</p><p>{p}</p></div>", f"{p}\n{p}"),
        (f"<body><div id=page><div class=content><p>{p}</p><p>{p}</p></div><div class='sidebar'><p>{p*1}</p></div></div></body>", f"{p}\n{p}"),
        ("<ul><li><a href=x>One</a></li><li><a>Two</a></li></ul>", "One\nTwo"),
        (f"<article><figure><img src=x><figcaption>A caption</figcaption></figure><blockquote>Quote here</blockquote><dl><dt>Term</dt><dd>Meaning</dd></dl><p>{p}</p><table><tr><td>a</td><td>1</td></tr></table></article>", f"A caption\nQuote here\nTerm\nMeaning\n{p}\na 1"),
        (f"<article><p>AT&amp;T <b>and</b> AT&<i>amp;</i></p><p>{p}</p><div hidden>secret</div><div style='display: none'><p>{p}</p></div></article>", f"AT&T and AT&amp;\n{p}"),
        (f"<header class='site-header'><h1>Site</h1></header><article><p>{p}</p></article><div class=disclaimer>{p}</div>", p),
        (f"<article><p>{p}</p><h2>One</h2><div class='cookie-banner'>{p}</div><p>Yes</p></article>", f"{p}\nOne\nYes"),
        (f"<article><h1>T</h1><p>{p}</p><pre>a\n b</pre><section class='comments'><h2>Comments</h2><article><p>{p*30}</p></article></section></article>", f"T\n{p}\na b"),
    ]
    for page, want in pages:
        assert html.extract(page) == want, page


def test_paths_decide(monkeypatch):
    """Ratios choose: flat ones let menus and notes in, a share of 0 lets every unnamed block in."""
    p = "The quick brown fox, having jumped over the dog, went home. It was late, and the moon was up."
    page = f"<nav><a>Menu</a></nav><div>Small talk.</div><article><h1>T</h1><p>{p}</p><ul><li>One</li></ul></article><footer>Foot.</footer>"
    assert html.extract(page) == f"T\n{p}\nOne"
    monkeypatch.setattr(html, "STRONG", 0.0)
    assert html.extract(page) == f"Small talk.\nT\n{p}\nOne"
    monkeypatch.setattr(html, "STRONG", 0.5)
    monkeypatch.setattr(html, "ratios", lambda found: {n.path: 1.0 for n, _, _ in found})
    assert html.extract(page) == f"Menu\nSmall talk.\nT\n{p}\nOne"


def test_ablations_over_whole_pages(monkeypatch):
    """On all given pages ratios alone keep the article on most, and flat ratios lose it on most, with names and without."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.dropna().tolist()
    whole = [html.extract(h) for h in pages]
    articles = ["\n".join(html.extract(part) for part in re.findall(r"<article>.*?</article>", h, re.S)) for h in pages]
    assert whole == articles
    unnamed = [re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", h) for h in pages]
    bare = [re.sub(r"<(/?)(?:nav|footer|aside|header|article|main|form|menu)\b[^>]*>", r"<\1div>", h) for h in unnamed]
    kept = [sum(a == html.extract(h) for a, h in zip(whole, some, strict=True)) / len(pages) for some in (unnamed, bare)]
    assert kept[0] > 0.95 and kept[1] > 0.9
    monkeypatch.setattr(html, "ratios", lambda found: {n.path: 1.0 for n, _, _ in found})
    assert sum(a == html.extract(h) for a, h in zip(whole, pages, strict=True)) < 0.2 * len(pages)
    assert not any(a == html.extract(h) for a, h in zip(whole, bare, strict=True))


def test_ratios_against_plain_sums():
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html.dropna().tolist()
    for page in pages:
        _, found = html.blocks(page)
        own = [x for _, _, x in found]
        marks = [sum(c in ".,;:!?…" and (k + 1 == len(x) or x[k + 1].isspace()) for k, c in enumerate(x)) for x in own]
        paths = [n.path for n, _, _ in found]
        mean = {p: [sum(v[i] for i in range(len(v)) if paths[i] == p) / paths.count(p) for v in (list(map(len, own)), marks)] for p in set(paths)}
        for p, got in html.ratios(found).items():
            sums = [0.0, 0.0]
            for i in (i for i, q in enumerate(paths) if q == p):
                for k in (0, 1):
                    sums[k] += mean[paths[max(i - 1, 0)]][k] / 4 + mean[p][k] / 2 + mean[paths[min(i + 1, len(paths) - 1)]][k] / 4
            assert got == pytest.approx(sums[0] * (1 + sums[1]) ** 0.5 if mean[p][0] else 0)


SHAPES = (
    "<a", "<a ", "<script ", "<svg a", "<svg a/", "<!--", "</", "<!", "<", "<a b='", '<a b="', "<a b='\">", "<a 'b", "<p title=\"x>", "<div><p>", "<li>", "<ul><li>a", "&amp", "&#x", "<a href=x>y",
    "<p>a</div>", "<script>", "</script ", "<a =", "<a b= ", "<table><tr><td>", "<h1>", "<style a=", "x<br>", "<div class='nav'>a ", "<math/>", "<a b c d e>", "<a b='<c' '",
)


@pytest.mark.parametrize("shape", SHAPES)
def test_every_shape_takes_linear_time(shape):
    def seconds(n):
        page = shape * (n // len(shape))
        began = time.process_time()
        html.extract(page)
        return time.process_time() - began

    assert seconds(400_000) < 10 * max(seconds(100_000), 0.1)


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<div class='a b'>" * n + "<p>Hello, world.</p>" + "</x><li>" * n
        began = time.process_time()
        assert html.extract(page) == "Hello, world."
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)
