"""The engine's functions for SQL: ``register(spark)`` makes them temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cuespark.functions import text as T

_WORDS = f"'({T.NOT_SPACE}+)'".replace("\\", "\\\\")
_CJK = f"'{T.NO_SPACE_SCRIPT}'".replace("\\", "\\\\")

#: Functions that are SQL expressions: signature and body.
SQL = {
    "cue_tokens": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_WORDS}, 1)"),
    "cue_count_words": ("t STRING", "INT", f"coalesce(regexp_count(t, {_CJK}) + regexp_count(regexp_replace(t, {_CJK}, ' '), {_WORDS}), 0)"),
    "cue_srt_timestamp": (
        "ms BIGINT",
        "STRING",
        "format_string('%02d:%02d:%02d,%03d', greatest(0, ms) div 3600000, greatest(0, ms) div 60000 % 60, greatest(0, ms) div 1000 % 60, greatest(0, ms) % 1000)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions that SQL can call from now on; ``cue_parse_...`` are table functions."""
    from cuespark.operators import align
    from cuespark.sources import cues

    for name, (arguments, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    python = {"cue_similarity": align.similarity_udf, "cue_inline_diff": align.inline_diff_udf, "cue_change_log": align.change_log_udf}
    for name, function in python.items():
        spark.udf.register(name, function)
    tables = {f"cue_parse_{name}": parse("content") for name, parse in cues.FORMATS.items()}
    for name, parsed in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(content STRING) RETURNS TABLE({cues.CUES}) RETURN SELECT c.ord, c.text, c.start_ms, c.end_ms FROM (SELECT explode({parsed}) AS c)")
    return [*SQL, *python, *tables]
