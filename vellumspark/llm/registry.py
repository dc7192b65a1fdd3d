"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumspark.llm import chat, licenses, minhash, mixing, packing, periodic, quality, rules, search, spelling, toxicity, treebpe, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole intended table."""
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_near_duplicates": minhash.op3_near_duplicates,
        "op4_pack": packing.op4_pack,
        "op5_quality": quality.op5_quality,
        "op6_chat_format": chat.op6_chat_format,
        "op7_url_filter": urls.op7_url_filter,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_top_k": search.op9_top_k,
        "op10_quality_rules": rules.op10_quality_rules,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_encode_decode": treebpe.op12_encode_decode,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {**mixing.ORACLE, **minhash.ORACLE, **chat.ORACLE, **urls.ORACLE, **search.ORACLE, **rules.ORACLE}
