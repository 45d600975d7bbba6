"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from funcframe.llm import cotrain, langid, media, mixing, neardup, packing, pii, quality_rules, toolcalls, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quality_rules.op1_quality_lines,
        pii.op2_personal_data,
        cotrain.op3_quality_cotraining,
        toolcalls.op4_tool_calls,
        urls.op5_url_rules,
        mixing.op6_mixing,
        media.op7_media,
        langid.op8_language,
        packing.op9_packing,
        neardup.op10_minhash,
    )
}

ORACLES: dict[str, str] = {
    "op4_tool_calls": toolcalls.OP4_SQL,
    "op5_url_rules": urls.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op10_minhash": neardup.OP10_SQL,
}
