"""Findings that need no detector: markers in comments, and comments that are older than their code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.rot import flagged

RULE = "marker:"
CANDIDATE = "comment blame predates its bound code — may be stale"


def markers(comments: DataFrame, severities: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """comment_id, rule, message, start, length, severity: one row for each marker of each comment.

    Its place is the first place of its word in the comment; a marker whose word isn't there takes the whole comment.
    severities: by marker; the others have that of their category.
    """
    m = F.col("marker")
    at = F.instr(F.col("raw_text"), m)
    chosen = F.try_element_at(F.create_map(*[F.lit(x) for kv in severities.items() for x in kv]), m) if severities else F.lit(None).cast("string")
    rows = comments.select(F.col("id").alias("comment_id"), "raw_text", F.explode("markers").alias("marker"))
    return rows.select(
        "comment_id", F.concat(F.lit(RULE), m).alias("rule"), F.concat(m, F.lit(" marker")).alias("message"),
        F.when(at > 0, F.octet_length(F.substring(F.col("raw_text"), F.lit(1), at - 1)).cast("bigint")).alias("start"), F.octet_length(m).cast("bigint").alias("length"),
        chosen.alias("severity"),
    )


def older_than_code(comments: DataFrame, blame: DataFrame) -> DataFrame:
    """The same for comments whose code has a later commit than they have."""
    late = flagged(comments, blame).where("is_rot_candidate")
    none: Column = F.lit(None)
    return late.select(F.col("id").alias("comment_id"), F.lit("rot_candidate").alias("rule"), F.lit(CANDIDATE).alias("message"), none.cast("bigint").alias("start"), none.cast("bigint").alias("length"), none.cast("string").alias("severity"))
