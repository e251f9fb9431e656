"""DuckDB SQL for the operators that it can express: same rules, other engine."""

from __future__ import annotations

from tessera.llm import quality as q

#: Exact Jaccard links of five-word shingle sets and their components.
SHINGLE_LINKS = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) ELSE [array_to_string(w, ' ') || ' '] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 5 * k >= 4 * (x.n + y.n - k)),
r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1), m AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT doc_id, coalesce(m.n, 0)::BIGINT AS n_links, coalesce(root, doc_id) AS class_id, coalesce(root, doc_id) = doc_id AS keep FROM d LEFT JOIN m ON doc_id = a LEFT JOIN c ON doc_id = node"""
#: Exact cosine links and their components.
COSINE_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1), m AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(m.n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN m ON vec_id = a LEFT JOIN c ON vec_id = node"""


def quality() -> str:
    """Measures, both distances and the verdict, from the same constants as the operator."""
    patterns = {"capital": r"[\p{Lu}\p{Lt}]", "letter": r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]", "digit": r"\p{N}", "space": r"[\p{Z}\x09-\x0D]", "sentence": r"[.,;:!?''\"()-]", "symbol": r"[#*$%&|<>]"}
    cols = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS c_{k}" for k, p in patterns.items())
    shares = ", ".join(f"('{k}', {', '.join(f'{x!r}::DOUBLE' for x in v)})" for k, v in q.CLASS_SHARES.items())

    def part(x: str, m: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"

    terms = []
    for k in q.CLASSES:
        p, r = f"(c_{k} / chars)", f"r_{k}"
        m = f"({p} + {r}) / 2"
        terms.append(f"{part(p, m)} + {part(r, m)}")
    refs = []
    for i, (lang, ws) in enumerate(q.COMMON.items()):
        for j, w in enumerate(ws.split()):
            refs.append(f"('{lang}', '{w}', {q.FIRST_SHARE / (j + 1) ** q.ZIPF!r}::DOUBLE)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, lang, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d), dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM li WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
tr AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3), tw AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM tr),
tc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tw), rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tc WHERE n > 1) GROUP BY 1),
cc AS (SELECT doc_id, lang, t, length(t) AS chars, {cols} FROM d), cl AS (SELECT *, chars - c_capital - c_letter - c_digit - c_space - c_sentence - c_symbol AS c_other FROM cc WHERE chars > 0),
cref(ref_lang, {', '.join('r_' + k for k in q.CLASSES)}) AS (VALUES {shares}),
jc AS (SELECT doc_id, chars, min(sqrt(greatest(0, ({' + '.join(terms)}) / 2))) AS j FROM cl JOIN cref ON lang IS NULL OR lang = ref_lang GROUP BY 1, 2),
ref(lang, word, share) AS (VALUES {', '.join(refs)}), ws AS (SELECT doc_id, unnest(w) AS w FROM d),
wc AS (SELECT doc_id, translate(trim(w, '.,;:!?''"()[]'), '{upper}', '{lower}') AS word, count(*) AS n FROM ws WHERE strlen(w) < 12 GROUP BY 1, 2),
al AS (SELECT DISTINCT doc_id, lang FROM wc, (SELECT DISTINCT lang FROM ref)),
hw AS (SELECT a.doc_id, a.lang, r.share AS r, coalesce(wc.n, 0) / b.n_words AS p, coalesce(wc.n, 0) AS n FROM al a JOIN ref r ON a.lang = r.lang JOIN b ON a.doc_id = b.doc_id LEFT JOIN wc ON wc.doc_id = a.doc_id AND wc.word = r.word),
ho AS (SELECT doc_id, lang, 1 - sum(r) AS r, 1 - sum(p) AS p FROM hw GROUP BY 1, 2), hh AS (SELECT doc_id, lang, r, p FROM hw UNION ALL SELECT doc_id, lang, r, p FROM ho),
jl AS (SELECT doc_id, lang, sqrt(greatest(0, sum({part('p', '(p + r) / 2')} + {part('r', '(p + r) / 2')}) / 2)) AS j FROM hh GROUP BY 1, 2), jw AS (SELECT doc_id, min(j) AS j FROM jl GROUP BY 1),
f AS (SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words, CASE WHEN chars >= {q.MIN_CHARS_CLASS} THEN jc.j END AS a,
  CASE WHEN n_words >= {q.MIN_WORDS_COMMON} AND (lang IS NULL OR lang IN ({', '.join(repr(k) for k in q.COMMON)})) THEN jw.j END AS z
  FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN jc USING (doc_id) LEFT JOIN jw USING (doc_id)),
g AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(a, 0) <= {q.MAX_CLASS_DISTANCE} AND coalesce(z, 0) <= {q.MAX_COMMON_DISTANCE} AS kept,
  round(a, 6) AS js_classes, round(z, 6) AS js_words FROM g"""
