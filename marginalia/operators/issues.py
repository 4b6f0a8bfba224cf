"""Markers and the issues that track them: what to file, what is done. Nothing is sent; a backend does that."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import identity_token


class IssueBackend(Protocol):
    """Where issues live; `file` and `close` are the caller's."""

    def create(self, title: str, body: str) -> str: ...

    def get(self, issue_id: str) -> dict: ...


def marker_tokens(comments: DataFrame) -> DataFrame:
    """comment_id, path, start_byte, marker, token of every marker of every comment."""
    rows = comments.select("id", "path", "span", "bound_symbol", "kind", F.explode("markers").alias("marker"))
    return rows.select(
        F.col("id").alias("comment_id"), "path", F.col("span.start_byte").alias("start_byte"), "marker",
        identity_token(F.col("bound_symbol"), F.col("kind"), F.col("marker")).alias("token"),
    )


def split_by_ledger(tokens: DataFrame, ledger: DataFrame) -> DataFrame:
    """tokens with issue id, closed and state: tracked or new."""
    known = ledger.select("token", F.col("id").alias("issue_id"), "closed")
    return tokens.join(known, "token", "left").withColumn("state", F.when(F.col("issue_id").isNull(), "new").otherwise("tracked"))


def to_file(tokens: DataFrame, ledger: DataFrame) -> DataFrame:
    """token, comment_id, mentions: each new token once, at its first comment."""
    new = tokens.join(ledger.select("token"), "token", "left_anti")
    return new.groupBy("token").agg(F.min_by("comment_id", F.struct("path", "start_byte", "comment_id")).alias("comment_id"), F.count("*").alias("mentions"))


def resolved(tokens: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, start_byte, issues of comments whose every marker has a closed issue; an unknown one is not closed."""
    both = tokens.join(ledger.select("token", F.col("id").alias("issue_id"), "closed"), "token", "left")
    return (
        both.groupBy("path", "start_byte")
        .agg(F.bool_and(F.coalesce("closed", F.lit(False))).alias("done"), F.array_sort(F.collect_set("issue_id")).alias("issues"))
        .where("done")
        .drop("done")
    )
