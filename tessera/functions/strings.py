"""String functions on columns; sets of characters are given as one string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.session import table


def _set(chars: str) -> str:
    return "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", chars) + "]"


def trim(s: Column, chars: str = " \t\r\n") -> Column:
    """s without any of chars at either end."""
    return rtrim(ltrim(s, chars), chars)


def ltrim(s: Column, chars: str = " \t\r\n") -> Column:
    return F.regexp_replace(s, f"^{_set(chars)}+", "")


def rtrim(s: Column, chars: str = " \t\r\n") -> Column:
    return F.regexp_replace(s, f"{_set(chars)}+$", "")


def lpad(s: Column, n: int, fill: str = " ") -> Column:
    """s with fill in front up to n code points; longer strings stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def rpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def pad(s: Column, n: int, fill: str = " ") -> Column:
    """s in the middle of n code points, the odd one in front."""
    gap = F.greatest(F.lit(n) - F.length(s), F.lit(0))
    half = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(fill), gap - half), s, F.repeat(F.lit(fill), half))


def pad_int(n: Column, width: int = 6) -> Column:
    return lpad(n.cast("string"), width, "0")


def split(s: Column, chars: str = " \t\r\n") -> Column:
    """Parts between any of chars, empty ones dropped."""
    return F.filter(F.split(s, f"{_set(chars)}+"), lambda x: x != "")


def left_substr(s: Column, chars: str) -> Column:
    """What stands before the first of chars; all of s without one."""
    return F.regexp_extract(s, f"(?s)^[^{_set(chars)[1:-1]}]*", 0)


def right_substr(s: Column, chars: str) -> Column:
    """What stands after the last of chars; empty without one."""
    return F.regexp_extract(s, f"(?s){_set(chars)}([^{_set(chars)[1:-1]}]*)$", 1)


def split_on_first(s: Column, chars: str) -> Column:
    """(head, tail) at the first of chars; (s, '') without one."""
    head = left_substr(s, chars)
    return F.struct(head.alias("head"), F.substr(s, F.length(head) + 2).alias("tail"))


def split_on_last(s: Column, chars: str) -> Column:
    """(head, tail) at the last of chars; (s, '') without one."""
    tail = right_substr(s, chars)
    has = F.regexp_like(s, F.lit(_set(chars)))
    return F.struct(F.when(has, F.substr(s, F.lit(1), F.length(s) - F.length(tail) - 1)).otherwise(s).alias("head"), tail.alias("tail"))


def equal_ignore_case(a: Column, b: Column, n: int | None = None) -> Column:
    """Whether two strings, or their first n code points, agree but for case."""
    return F.lower(a if n is None else F.left(a, F.lit(n))) == F.lower(b if n is None else F.left(b, F.lit(n)))


def identifier(s: Column) -> Column:
    """s as a name: runs of other characters become one underscore, a leading digit gets one."""
    t = trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "_")
    return F.when(F.regexp_like(t, F.lit("^[0-9]")), F.concat(F.lit("_"), t)).otherwise(t)


def entropy(s: Column) -> Column:
    """Shannon entropy of the bytes of a string, in bits: of the counts of its distinct bytes."""
    bytes_ = F.filter(F.split(F.regexp_replace(F.hex(F.encode(s, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != "")
    ordered = F.array_sort(bytes_)
    runs = F.transform(F.array_distinct(ordered), lambda v: (F.size(ordered) - F.size(F.array_remove(ordered, v))).cast("double") / F.size(ordered))
    return -F.aggregate(runs, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def _docs(s, d):
    return table(s, d, "documents")


def _part(s, d):
    return table(s, d, "part")


QUERIES = {
    "string_trim": lambda s, d: _part(s, d).select("p_partkey", trim(F.col("p_name"), "aesr").alias("t"), ltrim(F.col("p_name"), "aesr").alias("l"), rtrim(F.col("p_name"), "aesr").alias("r")),
    "string_pad": lambda s, d: _part(s, d).select("p_partkey", lpad(F.col("p_type"), 8, "*").alias("l"), rpad(F.col("p_type"), 8, "*").alias("r"), pad(F.col("p_type"), 12, "-").alias("m"), pad_int(F.col("p_size"), 4).alias("n")),
    "string_split": lambda s, d: _docs(s, d).select("doc_id", F.size(split(F.col("text"), " ,.\n")).alias("n"), F.element_at(split(F.col("text"), " ,.\n"), 1).alias("first_word")),
    "string_parts": lambda s, d: _docs(s, d).select(
        "doc_id", left_substr(F.col("text"), " ,").alias("head"), right_substr(F.col("text"), " ,").alias("last"), F.length(split_on_first(F.col("text"), " ,")["tail"]).alias("n_tail"),
        F.length(split_on_last(F.col("text"), " ,")["head"]).alias("n_head"),
    ),
    "equal_ignore_case": lambda s, d: table(s, d, "orders").select("o_orderkey", equal_ignore_case(F.col("o_orderpriority"), F.lit("1-urgent")).alias("same"), equal_ignore_case(F.col("o_orderpriority"), F.lit("1-u"), 3).alias("prefix")),
    "identifier": lambda s, d: _part(s, d).select("p_partkey", identifier(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name", "p_brand")).alias("name")),
    "byte_entropy": lambda s, d: table(s, d, "benchmark").select("item_id", F.round(entropy(F.col("text")), 6).alias("bits")),
    "hash_functions": lambda s, d: _docs(s, d).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("m"), F.sha1(F.encode("text", "UTF-8")).alias("s"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("b")),
}

ORACLES = {
    "string_trim": "SELECT p_partkey, trim(p_name, 'aesr') AS t, ltrim(p_name, 'aesr') AS l, rtrim(p_name, 'aesr') AS r FROM part",
    "string_pad": """SELECT p_partkey, CASE WHEN length(p_type) >= 8 THEN p_type ELSE lpad(p_type, 8, '*') END AS l, CASE WHEN length(p_type) >= 8 THEN p_type ELSE rpad(p_type, 8, '*') END AS r,
  repeat('-', (g - g // 2)::BIGINT) || p_type || repeat('-', (g // 2)::BIGINT) AS m, CASE WHEN length(p_size::VARCHAR) >= 4 THEN p_size::VARCHAR ELSE lpad(p_size::VARCHAR, 4, '0') END AS n
FROM (SELECT *, greatest(12 - length(p_type), 0) AS g FROM part)""",
    "string_split": "SELECT doc_id, len(ws)::INT AS n, ws[1] AS first_word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ ,.\\n]+'), lambda w: w <> '') AS ws FROM documents)",
    "string_parts": """SELECT doc_id, regexp_extract(text, '^[^ ,]*') AS head, regexp_extract(text, '[ ,]([^ ,]*)$', 1) AS last, length(substr(text, length(regexp_extract(text, '^[^ ,]*')) + 2))::INT AS n_tail,
  CASE WHEN regexp_matches(text, '[ ,]') THEN length(text) - length(regexp_extract(text, '[ ,]([^ ,]*)$', 1)) - 1 ELSE length(text) END::INT AS n_head FROM documents""",
    "equal_ignore_case": "SELECT o_orderkey, lower(o_orderpriority) = '1-urgent' AS same, lower(left(o_orderpriority, 3)) = '1-u' AS prefix FROM orders",
    "identifier": """SELECT p_partkey, CASE WHEN regexp_matches(t, '^[0-9]') THEN '_' || t ELSE t END AS name FROM (SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' ', p_size, p_name, p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM part)""",
    "byte_entropy": """WITH b AS (SELECT item_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM benchmark), c AS (SELECT item_id, x, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT item_id, n / sum(n) OVER (PARTITION BY item_id) AS p FROM c)
SELECT item_id, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY 1""",
    "hash_functions": "SELECT doc_id, md5(text) AS m, sha1(text) AS s, sha256(text) AS h, to_base64(encode(text)) AS b FROM documents",
}
