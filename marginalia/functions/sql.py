"""The text functions for Spark SQL: temporary functions that the optimizer inlines like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Each is the expression of the function of the same name in `text` or `places`.
FUNCTIONS = {
    "comment_tokens": ("t STRING", "ARRAY<STRING>", r"filter(split(lower(t), r'[^\p{L}\p{N}]+'), x -> x <> '')"),
    "content_hash": ("t STRING", "STRING", "sha2(encode(t, 'UTF-8'), 256)"),
    "utf16_length": ("t STRING", "BIGINT", "cast(octet_length(encode(t, 'UTF-16BE')) / 2 AS BIGINT)"),
    "qualified_rule": ("origin STRING, rule STRING", "STRING", "concat_ws(':', origin, rule)"),
    "spans_overlap": ("a_start BIGINT, a_end BIGINT, b_start BIGINT, b_end BIGINT", "BOOLEAN", "a_start < b_end AND b_start < a_end"),
    "severity_rank": ("severity STRING", "INT", "nullif(array_position(array('info', 'warning', 'error', 'critical'), severity), 0) - 1"),
}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS known to SQL in this session; returns their names."""
    for name, (arguments, result, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {expression}")
    return list(FUNCTIONS)
