"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, bytepairs, counts, cpsjoin, embeddings, html, infill, mixing, oracles, packing, quality, records, secrets, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_divergence": quality.op1,
        "op2_token_records": records.op2,
        "op3_chosen_path_join": cpsjoin.op3,
        "op4_best_fit_packing": packing.op4,
        "op5_sign_hash_dedup": embeddings.op5,
        "op6_seed_extend": substrings.op6,
        "op7_unigram_counts": counts.op7,
        "op8_secret_scan": secrets.op8,
        "op9_source_mix": mixing.op9,
        "op10_tag_path_text": html.op10,
        "op11_forced_boundary_bpe": bytepairs.op11,
        "op12_rope_infill": infill.op12,
        "op13_interval_alignment": alignment.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_divergence": oracles.quality(),
        "op3_chosen_path_join": oracles.SHINGLE_LINKS,
        "op5_sign_hash_dedup": oracles.COSINE_LINKS,
        "op6_seed_extend": substrings.ORACLE,
        "op9_source_mix": mixing.ORACLE,
        "op12_rope_infill": infill.ORACLE,
    }
