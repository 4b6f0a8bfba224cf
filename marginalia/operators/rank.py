"""Total orders, pages and fused rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Canonical order of findings.
CANONICAL = ("file_path", "span.start_line", "span.start_byte", "provider_rule_id", "finding_id")


def canonical(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*CANONICAL)


def actionable(findings: DataFrame, comments: DataFrame, limit: int | None = None, age_mode: str = "newest") -> DataFrame:
    """findings with rank: severest first, then by the time of the comment's commit, then by its number of markers.

    age_mode: newest or oldest commits first. With a limit only that many rows are kept, and none is sorted in full.
    """
    c = comments.select(
        F.col("id").alias("comment_id"),
        F.greatest(F.coalesce("git.committed_unix", F.lit(0)), F.lit(0)).alias("committed"),
        F.coalesce(F.size("markers"), F.lit(0)).alias("weight"),
    )
    time = F.coalesce("committed", F.lit(0))
    order = [F.desc("severity_rank"), time.desc() if age_mode == "newest" else time.asc(), F.coalesce("weight", F.lit(0)).desc(), *map(F.asc, CANONICAL)]
    ranked = findings.join(c, "comment_id", "left").orderBy(*order)
    if limit is not None:
        ranked = ranked.limit(limit)
        return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked


def by_score(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Highest score first, NaN and null last, then by key."""
    value = F.when(F.isnan(score), None).otherwise(F.col(score))
    return rows.orderBy(value.desc_nulls_last(), F.asc(key))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, cost: str | None = None, budget: int | None = None) -> DataFrame:
    """A page of rows in a total order: position (from 1), total, and cursor (null if nothing follows).

    With a cost and a budget the page ends before the sum of costs exceeds the budget; its first row is always shown.
    Only the first offset + limit rows leave the tasks; the running sum is over these.
    """
    counted = rows.agg(F.count("*").cast("int").alias("total")).withColumn("_one", F.lit(1))
    head = rows.orderBy(*order).limit(offset + limit)
    w = Window.orderBy(*order)
    out = head.withColumn("position", F.row_number().over(w)).where(F.col("position") > offset)
    if cost is not None and budget is not None:
        running = F.sum(cost).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("running", running).where((F.col("position") == offset + 1) | (F.col("running") <= budget)).drop("running")
    last = F.max("position").over(Window.partitionBy())
    # The total is one row, joined when the page is read.
    paged = out.withColumn("_last", last).withColumn("_one", F.lit(1)).join(F.broadcast(counted), "_one").drop("_one")
    return paged.withColumn("cursor", F.when(F.col("_last") < F.col("total"), F.col("_last"))).drop("_last")


def fuse(lists: list[DataFrame], limit: int, constant: int = 60) -> DataFrame:
    """id, score: reciprocal rank fusion of lists with columns id and rank (from 1)."""
    parts = [x.select("id", (F.lit(1.0) / (F.col("rank") + constant)).alias("part")) for x in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)
