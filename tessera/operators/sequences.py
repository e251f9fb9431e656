"""Token windows, labels, chat rendering and text similarity over arrays of tokens.

Tokens here are space-separated words unless a tokenizer gives ids; every operator
takes an array column, so either will do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.batches import small
from tessera.plans.prefix import running
from tessera.plans.session import table

PAD, IGNORE = 0, -100


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+"), lambda w: w != "")


def ids(text: Column) -> Column:
    """Word ids: the first four bytes of a digest, within 30 bits, so that arrays of integers can be built in any engine."""
    return F.transform(tokens(text), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int")))


def causal_windows(df: DataFrame, key: str, seq: Column, width: int, stride: int) -> DataFrame:
    """(key, start, window, labels) of each document: starts at every stride until a window reaches the end; labels are the next tokens."""
    x = df.select(key, seq.alias("_s")).filter(F.size("_s") >= 2)
    x = x.withColumn("_last", F.ceil(F.greatest(F.size("_s") - width, F.lit(0)) / stride).cast("int"))

    def cut(i: Column) -> Column:
        return F.struct((i * stride).alias("start"), F.slice("_s", i * stride + 1, width).alias("own"), F.slice("_s", i * stride + 2, width).alias("after"))

    # the slices are cut in the row of their sequence, so no row carries the whole of it
    y = x.select(key, F.size("_s").alias("_n"), F.explode(F.transform(F.sequence(F.lit(0), "_last"), cut)).alias("e")).filter(F.col("e.start") + 1 < F.col("_n"))
    return y.select(key, "e.start", padded(F.col("e.own"), width, PAD).alias("window"), padded(F.col("e.after"), width, IGNORE).alias("labels"))


def padded(a: Column, width: int, pad: int) -> Column:
    """a filled to width at its right."""
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(a), F.lit(0))))


def next_token_windows(df: DataFrame, key: str, seq: Column, width: int) -> DataFrame:
    """(key, t, window, target): every place of a sequence at least as long as the window, the window filled at its left."""
    x = df.select(key, seq.alias("_s")).filter((F.size("_s") >= width) & (F.size("_s") > 1))

    def cut(t: Column) -> Column:
        own = F.slice("_s", F.greatest(t - width, F.lit(0)) + 1, F.least(t, F.lit(width)))
        return F.struct(t.alias("t"), own.alias("own"), F.element_at("_s", t + 1).alias("target"))

    y = x.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("_s") - 1), cut)).alias("e")).select(key, "e.*")
    return y.select(key, "t", F.concat(F.array_repeat(F.lit(PAD), F.greatest(F.lit(width) - F.col("t"), F.lit(0))), "own").alias("window"), "target")


def finetuning_windows(df: DataFrame, key: str, prompt: Column, response: Column, width: int, policy: str) -> DataFrame:
    """(key, window, labels) of prompt and response: only response tokens are labels.

    Longer than width + 1: policy skip drops the pair, prompt_head cuts the prompt's front, response_tail the response's end.
    """
    x = df.select(key, prompt.alias("_p"), response.alias("_q")).filter(F.size("_q") > 0)
    over = F.size("_p") + F.size("_q") - (width + 1)
    if policy == "skip":
        x = x.filter(over <= 0)
    elif policy == "prompt_head":
        cut = F.greatest(over, F.lit(0))
        x = x.filter(F.size("_p") >= cut).withColumn("_p", F.slice("_p", cut + 1, F.size("_p")))
    else:
        left = F.size("_q") - F.greatest(over, F.lit(0))
        x = x.filter(left > 0).withColumn("_q", F.slice("_q", F.lit(1), left))
    full = F.concat("_p", "_q")
    labels = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda t: F.when((t >= F.size("_p") - 1) & (t + 1 < F.size("_p") + F.size("_q")), F.try_element_at(full, t + 2)).otherwise(F.lit(IGNORE)))
    return x.select(key, padded(F.slice(full, 1, width), width, PAD).alias("window"), labels.alias("labels"))


def packed_starts(df: DataFrame, key: str, length: Column) -> DataFrame:
    """(key, start, length): each document's place in the stream of all documents in key order, by distributed running sums."""
    x = df.select(key, length.cast("long").alias("length"))
    return running(x, [F.asc(key)], {"upto": F.col("length")}).select(key, (F.col("upto") - F.col("length")).alias("start"), "length")


def packed_windows(df: DataFrame, key: str, length: Column, width: int) -> DataFrame:
    """(window, key, from, to): which part of which document fills each window of the packed stream; documents are cut into windows where they lie."""
    x = packed_starts(df, key, length).filter("length > 0")
    y = x.withColumn("window", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width))))
    begin = F.greatest(F.col("window") * width - F.col("start"), F.lit(0))
    end = F.least((F.col("window") + 1) * width - F.col("start"), F.col("length"))
    return y.select("window", key, begin.alias("begin"), end.alias("end"))


def overlap(df: DataFrame, keys: list[str], reference: Column, made: Column) -> DataFrame:
    """keys and multiset precision, recall and f1 of two token arrays; 0 if either is empty. Tokens of a row are counted in its time and memory."""

    def compare(a: list, b: list) -> tuple[float, float, float]:
        k = (Counter(a) & Counter(b)).total()
        p, q = k / len(b) if b else 0.0, k / len(a) if a else 0.0
        return p, q, 2 * p * q / (p + q) if k else 0.0

    return _compared(df, keys, reference, made, compare, ["precision", "recall", "f1"])


def _compared(df: DataFrame, keys: list[str], reference: Column, made: Column, compare: Callable[[list, list], tuple[float, ...]], names: list[str]) -> DataFrame:
    """keys and the numbers of each pair of token arrays (null: empty), found where the row lies; a task holds few rows at a time."""
    x = df.select(*keys, reference.alias("_a"), made.alias("_b"))
    schema = T.StructType([*[x.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [compare(p or [], q or []) for p, q in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *[pa.array(c, pa.float64()) for c in zip(*found, strict=True)]], names=[*keys, *names])

    return x.mapInArrow(run, schema)


def ngram_overlap(df: DataFrame, keys: list[str], reference: Column, made: Column, most: int = 4) -> DataFrame:
    """keys and score: mean over n of clipped n-gram precision, n up to the shorter length; n-grams of a row are counted in its time and memory."""

    def compare(a: list, b: list) -> tuple[float]:
        top, total = min(len(a), len(b), most), 0.0
        for n in range(1, top + 1):
            grams = [Counter(zip(*[s[i:] for i in range(n)], strict=False)) for s in (a, b)]
            total += (grams[0] & grams[1]).total() / (len(b) - n + 1)
        return (total / top if top else 0.0,)

    return _compared(df, keys, reference, made, compare, ["score"]).withColumn("score", F.round("score", 6))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of two strings; 1 for two empty ones."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


#: The public chat markup of each family: system block, system block without a prompt, user turn, assistant header, end of an answer.
TEMPLATES = {
    "raw": ("", "", "{}", "", ""),
    "zephyr": ("<|system|>\n{}</s>\n", "<|system|>\n</s>\n", "<|user|>\n{}</s>\n", "<|assistant|>\n", "</s>"),
    "chatml": ("<|im_start|>system\n{}<|im_end|>\n", "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n", "<|im_start|>user\n{}<|im_end|>\n", "<|im_start|>assistant\n", "<|im_end|>"),
    "guanaco": ("{}\n\n", "", "### Human: {}\n", "### Assistant:", "</s>"),
    "granite": (
        "<|start_of_role|>system<|end_of_role|>{}<|end_of_text|>\n", "", "<|start_of_role|>user<|end_of_role|>{}<|end_of_text|>\n", "<|start_of_role|>assistant<|end_of_role|>", "<|end_of_text|>",
    ),
}


def _filled(form: str, value: Column) -> Column:
    head, _, tail = form.partition("{}")
    return F.concat(F.lit(head), value, F.lit(tail)) if "{}" in form else F.lit(form)


def system_prefix(kind: str, prompt: Column) -> Column:
    """The block that opens a conversation; families differ on an empty prompt."""
    system, without, *_ = TEMPLATES[kind]
    return F.when(F.coalesce(prompt, F.lit("")) == "", F.lit(without)).otherwise(_filled(system, prompt))


def first_turn(kind: str, prompt: Column, user: Column) -> Column:
    """System block, first user text and assistant header."""
    return user if kind == "raw" else F.concat(system_prefix(kind, prompt), _filled(TEMPLATES[kind][2], user), F.lit(TEMPLATES[kind][3]))


def next_turn(kind: str, user: Column) -> Column:
    """A later user text and assistant header, after the line end that follows an answer."""
    return user if kind == "raw" else F.concat(F.lit("\n"), _filled(TEMPLATES[kind][2], user), F.lit(TEMPLATES[kind][3]))


def clean_answer(kind: str, text: Column) -> Column:
    """An answer without reasoning spans (chatml) or a leaked next section (guanaco), trimmed; other families stay as they are."""
    if kind not in ("chatml", "guanaco"):
        return text
    cut = F.regexp_replace(text, "(?s)<think>.*?(</think>|$)", "") if kind == "chatml" else F.regexp_replace(text, "(?s)###.*", "")
    return F.regexp_replace(cut, "^[ \t\r\n]+|[ \t\r\n]+$", "")


def rendered(turns: DataFrame, kind: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, text, n_turns): a conversation in one family's markup; answers close with the family's end, later user turns open a line.

    The first system text is the prompt. raw joins the texts as they are.
    """
    _, _, user, header, end = TEMPLATES[kind]
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", F.coalesce("text", F.lit("")).alias("t")))).alias("_all"))
    prompt = F.try_element_at(F.filter("_all", lambda x: x["role"] == "system"), F.lit(1))["t"]
    split_ = listed.withColumn("_prompt", prompt).withColumn("_turns", F.filter("_all", lambda x: x["role"] != "system"))
    lead = "" if kind == "raw" else "\n"

    def one(x: Column, i: Column) -> Column:
        asked = F.concat(F.when(i > 0, F.lit(lead)).otherwise(F.lit("")), _filled(user, x["t"]))
        return F.when(x["role"] == "user", asked).otherwise(F.concat(F.lit(header), x["t"], F.lit(end)))

    text = F.concat(F.lit("") if kind == "raw" else system_prefix(kind, F.col("_prompt")), F.array_join(F.transform("_turns", one), ""))
    return split_.select(key, text.alias("text"), F.size("_all").cast("long").alias("n_turns"))


def dialogue_pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, turn, question, answer): each user turn with the assistant turn right after it; empty ones drop."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    x = turns.select(key, order, "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return x.filter("role = 'user' AND r2 = 'assistant' AND text <> '' AND t2 <> ''").select(key, order, F.col("text").alias("question"), F.col("t2").alias("answer"))


def _docs(s, d):
    return table(s, d, "documents")


def _pairs(s, d):
    return dialogue_pairs(table(s, d, "conversations"))


def _w(name: str) -> Column:
    return tokens(F.col(name))


_TOK = "list_filter(regexp_split_to_array(coalesce({}, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_IDS = f"list_transform({_TOK}, lambda w: ('0x' || substr(md5(w), 1, 7))::INT)"
_PAIRS = """p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, text AS question, t2 AS answer FROM p WHERE role = 'user' AND r2 = 'assistant' AND text <> '' AND t2 <> '')"""
_SHARED = "coalesce(list_sum(list_transform(list_distinct({a}), lambda v: least(len(list_filter({a}, lambda x: x = v)), len(list_filter({b}, lambda x: x = v))))), 0)"
_GRAMS = "list_transform(range(1, len({a}) - {n} + 2), lambda i: array_to_string({a}[i : i + {m}], ' '))"


def _gram(a: str, n: int) -> str:
    return _GRAMS.format(a=a, n=n, m=n - 1)


_NGRAM = " + ".join(f"CASE WHEN {n} <= top THEN {_SHARED.format(a=_gram('a', n), b=_gram('b', n))} / greatest(len(b) - {n} + 1, 1) ELSE 0.0 END" for n in range(1, 5))

QUERIES = {
    "causal_windows": lambda s, d: causal_windows(_docs(s, d), "doc_id", ids(F.col("text")), 64, 64).select("doc_id", "start", F.array_join("window", " ").alias("window"), F.array_join("labels", " ").alias("labels")),
    "next_token_windows": lambda s, d: next_token_windows(table(s, d, "benchmark"), "item_id", ids(F.col("text")), 8).select("item_id", "t", F.array_join("window", " ").alias("window"), "target"),
    "finetuning_skip": lambda s, d: _sft(s, d, "skip"),
    "finetuning_prompt_head": lambda s, d: _sft(s, d, "prompt_head"),
    "finetuning_response_tail": lambda s, d: _sft(s, d, "response_tail"),
    "packed_starts": lambda s, d: packed_starts(_docs(s, d), "doc_id", F.length("text")),
    "packed_windows": lambda s, d: packed_windows(_docs(s, d), "doc_id", F.length("text"), 4096),
    "token_overlap": lambda s, d: overlap(_pairs(s, d), ["conv_id", "turn"], _w("question"), _w("answer")).select("conv_id", "turn", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")]),
    "ngram_overlap": lambda s, d: ngram_overlap(_pairs(s, d), ["conv_id", "turn"], _w("question"), _w("answer")),
    "edit_similarity": lambda s, d: _pairs(s, d).select("conv_id", "turn", F.round(edit_similarity(F.col("question"), F.col("answer")), 6).alias("similarity")),
    "chat_chatml": lambda s, d: _chat(s, d, "chatml"),
    "chat_zephyr": lambda s, d: _chat(s, d, "zephyr"),
    "chat_guanaco": lambda s, d: _chat(s, d, "guanaco"),
    "chat_granite": lambda s, d: _chat(s, d, "granite"),
    "chat_raw": lambda s, d: _chat(s, d, "raw"),
    "clean_answer": lambda s, d: _docs(s, d).select("doc_id", F.sha1(clean_answer("guanaco", F.concat(F.lit("  "), F.col("text"), F.lit("\n###Human: x"))).cast("binary")).alias("digest")),
    "dialogue_pairs": lambda s, d: _pairs(s, d),
}


def _sft(s, d, policy):
    x = finetuning_windows(_pairs(s, d).withColumn("k", F.concat_ws(":", "conv_id", "turn")), "k", ids(F.col("question")), ids(F.col("answer")), 48, policy)
    return x.select("k", F.array_join("window", " ").alias("window"), F.array_join("labels", " ").alias("labels"))


def _chat(s, d, kind):
    return rendered(table(s, d, "conversations"), kind).select("conv_id", F.sha1(F.col("text").cast("binary")).alias("digest"), "n_turns")


_SFT = {
    "skip": ("p", "q", "len(p) + len(q) <= 49"),
    "prompt_head": ("p[greatest(len(p) + len(q) - 49, 0) + 1 :]", "q", "len(p) >= greatest(len(p) + len(q) - 49, 0)"),
    "response_tail": ("p", "q[: len(q) - greatest(len(p) + len(q) - 49, 0)]", "len(q) - greatest(len(p) + len(q) - 49, 0) > 0"),
}


def _sft_sql(policy: str) -> str:
    p, q, keep = _SFT[policy]
    return f"""WITH {_PAIRS}, a AS (SELECT conv_id || ':' || turn AS k, {_IDS.format('question')} AS p, {_IDS.format('answer')} AS q FROM q), b AS (SELECT k, {p} AS p, {q} AS q FROM a WHERE len(q) > 0 AND {keep}),
c AS (SELECT k, len(p) AS np, len(p) + len(q) AS n, list_concat(p, q) AS f FROM b)
SELECT k, array_to_string(list_transform(range(48), lambda t: CASE WHEN t < n THEN f[t + 1] ELSE 0 END), ' ') AS window,
  array_to_string(list_transform(range(48), lambda t: CASE WHEN t >= np - 1 AND t + 1 < n AND t + 2 > 0 THEN f[t + 2] ELSE -100 END), ' ') AS labels FROM c"""


def _chat_sql(kind: str) -> str:
    system, without, user, header, end = ("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in TEMPLATES[kind])

    def fill(form: str, value: str) -> str:
        return form.replace("{}", f"' || {value} || '")

    lead = "''" if kind == "raw" else "chr(10)"
    turn = f"CASE role WHEN 'user' THEN CASE WHEN i > 1 THEN {lead} ELSE '' END || {fill(user, 't')} ELSE {header} || t || {end} END"
    head = "''" if kind == "raw" else f"CASE WHEN coalesce(p, '') = '' THEN {without} ELSE {fill(system, 'p')} END"
    return f"""WITH a AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), s AS (SELECT conv_id, arg_min(t, turn) AS p FROM a WHERE role = 'system' GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS i FROM a WHERE role <> 'system'), j AS (SELECT conv_id, string_agg({turn}, '' ORDER BY i) AS x FROM o GROUP BY 1),
n AS (SELECT conv_id, count(*) AS n_turns FROM a GROUP BY 1)
SELECT conv_id, sha1({head} || coalesce(x, '')) AS digest, n_turns FROM n LEFT JOIN s USING (conv_id) LEFT JOIN j USING (conv_id)"""


ORACLES = {
    "causal_windows": f"""WITH d AS (SELECT doc_id, {_IDS.format('text')} AS s FROM documents), w AS (SELECT doc_id, s, unnest(range(0, ceil(greatest(len(s) - 64, 0) / 64)::BIGINT + 1)) * 64 AS b FROM d WHERE len(s) >= 2)
SELECT doc_id, b::INT AS start, array_to_string(list_transform(range(64), lambda t: CASE WHEN b + t < len(s) THEN s[b + t + 1] ELSE 0 END), ' ') AS window,
  array_to_string(list_transform(range(64), lambda t: CASE WHEN b + t + 1 < len(s) THEN s[b + t + 2] ELSE -100 END), ' ') AS labels FROM w WHERE b + 1 < len(s)""",
    "next_token_windows": f"""WITH d AS (SELECT item_id, {_IDS.format('text')} AS s FROM benchmark), w AS (SELECT item_id, s, unnest(range(1, len(s))) AS t FROM d WHERE len(s) >= 8)
SELECT item_id, t::INT AS t, array_to_string(list_transform(range(8), lambda k: CASE WHEN t - 8 + k < 0 THEN 0 ELSE s[t - 8 + k + 1] END), ' ') AS window, s[t + 1] AS target FROM w""",
    **{f"finetuning_{k}": _sft_sql(k) for k in _SFT},
    "packed_starts": "SELECT doc_id, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS start, length(text) AS length FROM documents",
    "packed_windows": """WITH s AS (SELECT doc_id, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS b, length(text) AS n FROM documents),
w AS (SELECT *, unnest(range(b // 4096, (b + n - 1) // 4096 + 1)) AS "window" FROM s WHERE n > 0)
SELECT "window", doc_id, greatest("window" * 4096 - b, 0) AS begin, least(("window" + 1) * 4096 - b, n) AS "end" FROM w""",
    "token_overlap": f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, {_TOK.format('question')} AS a, {_TOK.format('answer')} AS b FROM q), k AS (SELECT *, {_SHARED.format(a='a', b='b')} AS k FROM t),
r AS (SELECT conv_id, turn, coalesce(k / nullif(len(b), 0), 0) AS p, coalesce(k / nullif(len(a), 0), 0) AS q FROM k)
SELECT conv_id, turn, round(p, 6) AS "precision", round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""",
    "ngram_overlap": f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, {_TOK.format('question')} AS a, {_TOK.format('answer')} AS b FROM q), u AS (SELECT *, least(len(a), len(b), 4) AS top FROM t)
SELECT conv_id, turn, round(coalesce(({_NGRAM}) / nullif(top, 0), 0), 6) AS score FROM u""",
    "chat_chatml": _chat_sql("chatml"),
    "chat_zephyr": _chat_sql("zephyr"),
    "chat_guanaco": _chat_sql("guanaco"),
    "chat_granite": _chat_sql("granite"),
    "chat_raw": _chat_sql("raw"),
    "clean_answer": "SELECT doc_id, sha1(trim(split_part('  ' || text || chr(10) || '###Human: x', '###', 1), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents",
    "dialogue_pairs": f"WITH {_PAIRS} SELECT * FROM q",
}
