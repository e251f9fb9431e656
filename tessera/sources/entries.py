"""Queries over sources and sinks: what a sink writes to the shared scratch folder, its source reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bpe, sequences
from tessera.plans.session import table
from tessera.plans.shared import scratch_path
from tessera.sources import corpora, files


def _documents(s, d):
    """Sentinel files of all texts, read back: digests and how often each came."""
    path = scratch_path(s, "corpus")
    corpora.write_documents(table(s, d, "documents"), path)
    return corpora.documents(s, path).groupBy(F.sha1(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"))


def _records(s, d):
    path = scratch_path(s, "records")
    pairs = sequences.dialogue_pairs(table(s, d, "conversations"))
    corpora.write_records(pairs.select(F.lit("Be brief.").alias("system"), F.col("question").alias("user"), F.col("answer").alias("assistant")), path)
    return corpora.records(s, path).groupBy("system", F.sha1(F.col("user").cast("binary")).alias("user"), F.sha1(F.col("assistant").cast("binary")).alias("assistant")).agg(F.count("*").alias("n"))


def _messages(s, d):
    """Conversations as JSON lines, and the first assistant text of each."""
    path = scratch_path(s, "chats")
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    turns.select(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).write.json(path)
    return corpora.messages(s, path).groupBy(F.sha1(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"))


def _libsvm(s, d):
    """Lines of each order as 'label index:value' rows, read back with the smallest index at 0."""
    path = scratch_path(s, "libsvm")
    x = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    x = x.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("k"), "v")))).alias("features"))
    corpora.write_libsvm(x.select(F.col("l_orderkey").cast("double").alias("label"), "features"), path)
    return corpora.from_zero(corpora.libsvm(s, path)).select("label", F.explode("features").alias("place", "v"))


def _sniffed(s, d):
    """Kinds of all pages by their content alone."""
    heads = table(s, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.encode(F.col("html"), "UTF-8").alias("head"))
    return files.classify(heads).select("path", "is_text", "kind")


def _bpe(s, d):
    """Digests of all texts after encoding under 64 learned merges and decoding."""
    docs = table(s, d, "documents").select("doc_id", "text")
    merges = bpe.train(docs, 256 + 64)
    return bpe.decoded(bpe.encode(docs, merges), merges).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))


QUERIES = {"sentinel_documents": _documents, "sentinel_records": _records, "chat_messages": _messages, "libsvm_rows": _libsvm, "sniffed_pages": _sniffed, "bpe_round_trip": _bpe}
_TRIM = "regexp_replace(replace({}, chr(13) || chr(10), chr(10)), '[ \\t\\r\\n]+$', '')"
ORACLES = {
    "sentinel_documents": f"SELECT sha1(t) AS digest, count(*) AS n FROM (SELECT {_TRIM.format('text')} AS t FROM documents) WHERE t <> '' GROUP BY 1",
    "sentinel_records": f"""WITH {sequences._PAIRS}, x AS (SELECT {_TRIM.format('question')} AS u, {_TRIM.format('answer')} AS a FROM q)
SELECT 'Be brief.' AS system, sha1(u) AS "user", sha1(a) AS assistant, count(*) AS n FROM x WHERE u <> '' AND a <> '' GROUP BY 2, 3""",
    "chat_messages": """WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS turn FROM conversations GROUP BY 1)
SELECT sha1(nullif(text, '')) AS digest, count(*) AS n FROM f LEFT JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn GROUP BY 1""",
    "libsvm_rows": "SELECT l_orderkey::DOUBLE AS label, (l_linenumber - (SELECT min(l_linenumber) FROM lineitem))::INT AS place, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "bpe_round_trip": "SELECT doc_id, sha1(coalesce(text, '')) AS digest FROM documents",
}
