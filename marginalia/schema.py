"""Types, vocabularies and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RANGE = "STRUCT<start_byte: BIGINT, end_byte: BIGINT, start_line: INT, end_line: INT>"
COMMENTS = (
    f"id BIGINT, path STRING, content_hash STRING, language STRING, kind STRING, span {RANGE}, raw_text STRING, bound_symbol STRING, "
    f"bound_node_range {RANGE}, markers ARRAY<STRING>, git STRUCT<author: STRING, email: STRING, commit_id: STRING, committed_unix: BIGINT>, "
    "is_rot_candidate BOOLEAN, cosmetic_fingerprint STRING"
)
FINDINGS = (
    f"finding_id BIGINT, comment_id BIGINT, file_path STRING, target_hash STRING, target_symbol STRING, span {RANGE}, origin STRING, "
    "provider_rule_id STRING, canonical_rule_id STRING, category STRING, severity STRING, severity_rank INT, severity_native STRING, "
    "message STRING, fix STRING, url STRING, also_from ARRAY<STRING>"
)

# Fixed values.
SEVERITIES = ("info", "warning", "error", "critical")
KINDS = ("line", "block", "docstring", "shebang", "license", "encoding-decl", "directive")
SUPPRESSED_KINDS = ("shebang", "license")
BEHAVING_KINDS = ("directive", "shebang", "encoding-decl")
LANGUAGES = ("python", "typescript", "javascript", "shell")
CATEGORY_SEVERITY = {
    "doc_missing": "warning", "doc_drift": "error", "doc_style": "info", "commented_code": "warning", "secret": "critical",
    "todo_format": "info", "marker_stale": "warning", "comment_style": "info", "shebang": "warning", "directive": "error",
    "rot_candidate": "info", "reference_stale": "warning", "path_missing": "warning",
}
RUN_STATES = ("SUCCESS", "EMPTY", "PARTIAL", "SKIPPED")
NATIVE = "native"
MODULE = "<module>"


def categories(spark: SparkSession) -> DataFrame:
    """category, ordinal, severity, severity_rank: thirteen rows, in their order of declaration."""
    rows = [(c, i, s, SEVERITIES.index(s)) for i, (c, s) in enumerate(CATEGORY_SEVERITY.items())]
    return spark.createDataFrame(rows, "category STRING, ordinal INT, severity STRING, severity_rank INT")
