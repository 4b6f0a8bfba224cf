"""Findings: severity, attachment to comments, overlap merging, and aggregates.

Tables: comments as in `schema.COMMENTS` and findings as in `schema.FINDINGS`; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.places import contains_byte, overlaps
from marginalia.schema import SEVERITIES


def severity_rank(severity: Column) -> Column:
    """0 for info to 3 for critical; null for anything else."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(place > 0, (place - 1).cast("int"))


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key) if pairs else F.lit(None).cast("string")


def resolve_severity(findings: DataFrame, categories: DataFrame, overrides: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """severity and severity_rank: the override of the rule, its canonical rule, its category or its origin, else the
    anchor of its category (a broadcast table of thirteen rows)."""
    anchor = F.broadcast(categories.select("category", F.col("severity").alias("anchor")))
    out = findings.drop("severity", "severity_rank").join(anchor, "category", "left")
    keys = ("provider_rule_id", "canonical_rule_id", "category", "origin")
    severity = F.coalesce(*[_lookup(overrides, F.col(k)) for k in keys], F.col("anchor"))
    return out.withColumn("severity", severity).withColumn("severity_rank", severity_rank(F.col("severity"))).drop("anchor")


def attach(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """findings with comment_id: the first comment, in scan order, of the same file that the finding names or touches.

    The join is on the file, with the place as residual condition; the first match is taken by an aggregate, so that
    a file with many comments is combined before the shuffle. Findings that touch no comment keep a null id.
    """
    c = comments.select(
        F.col("path").alias("file_path"), F.col("id").alias("c_id"), F.col("span").alias("c_span"), F.col("bound_symbol").alias("c_symbol")
    )
    f = findings.select("finding_id", "file_path", F.col("span").alias("f_span"), F.col("target_symbol").alias("f_symbol"))
    touches = (
        F.coalesce(F.col("f_symbol") == F.col("c_symbol"), F.lit(False))
        | contains_byte(F.col("c_span"), F.col("f_span.start_byte"))
        | overlaps(F.col("c_span"), F.col("f_span"))
    )
    first = (
        f.join(c, "file_path")
        .where(touches)
        .groupBy("finding_id")
        .agg(F.min_by("c_id", F.struct("c_span.start_byte", "c_id")).alias("comment_id"))
    )
    return findings.drop("comment_id").join(first, "finding_id", "left")


def unattached(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Findings that no comment holds."""
    return attach(findings, comments).where(F.col("comment_id").isNull()).drop("comment_id")


def in_comments(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Findings inside a comment's span, for providers that only judge comments."""
    c = comments.select(F.col("path").alias("c_path"), F.col("span").alias("c_span"))
    return findings.join(
        c, (F.col("file_path") == F.col("c_path")) & contains_byte(F.col("c_span"), F.col("span.start_byte")), "left_semi"
    )


def in_scope(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of files that are there."""
    return findings.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def provider_files(files: DataFrame, providers: DataFrame) -> DataFrame:
    """provider, path: what each provider is run on, the files of its languages, or all if it names none.

    providers: provider, languages; a few rows, broadcast.
    """
    named = F.broadcast(providers.select("provider", F.explode("languages").alias("language")))
    every = F.broadcast(providers.where(F.coalesce(F.size("languages"), F.lit(0)) == 0).select(F.collect_list("provider").alias("_p")).withColumn("_one", F.lit(1)))
    paths = files.select("path", "language")
    rest = paths.select("path").withColumn("_one", F.lit(1)).join(every, "_one").select(F.explode("_p").alias("provider"), "path")
    return paths.join(named, "language").select("provider", "path").unionByName(rest)


def scoped_states(runs: DataFrame, kept: DataFrame, scoped: DataFrame) -> DataFrame:
    """runs (provider, run_state) with the states of comment-scoped providers recomputed from the findings that are left.

    SUCCESS if any is left, else EMPTY; PARTIAL and SKIPPED stay. scoped: provider; a few rows, broadcast.
    """
    left = kept.select(F.col("origin").alias("provider")).distinct().withColumn("_left", F.lit(True))
    marked = runs.join(F.broadcast(scoped.select("provider").withColumn("_scoped", F.lit(True))), "provider", "left").join(left, "provider", "left")
    redone = F.col("_scoped") & F.col("run_state").isin("SUCCESS", "EMPTY")
    state = F.when(redone, F.when(F.col("_left"), "SUCCESS").otherwise("EMPTY")).otherwise(F.col("run_state"))
    return marked.withColumn("run_state", state).drop("_scoped", "_left")


def for_languages(files: DataFrame, languages: list[str]) -> DataFrame:
    """Files a provider is run on: those of its languages, or all if it names none."""
    return files.where(F.col("language").isin(*languages)) if languages else files


def merge_overlaps(findings: DataFrame, keys: tuple[str, ...] = ("file_path", "category")) -> DataFrame:
    """Overlapping findings of one file and category as one: the severest (then first in canonical order) stands for
    all, also_from names the other origins. Touching and zero-width spans at one byte stay apart.

    A cluster starts where a finding begins at or behind the greatest end so far: a running maximum per key.
    """
    order = Window.partitionBy(*keys).orderBy("span.start_byte", "span.end_byte", "finding_id")
    reach = F.max("span.end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("span.start_byte") < reach, 0).otherwise(1)
    marked = findings.withColumn("starts", starts)
    clustered = marked.withColumn("cluster", F.sum("starts").over(order)).withColumn("next_starts", F.coalesce(F.lead("starts").over(order), F.lit(1)))
    kept = [c for c in findings.columns if c != "also_from"]
    own = F.coalesce("also_from", F.array().cast("array<string>"))

    def others(origins: Column, best: str) -> Column:
        return F.array_sort(F.filter(origins, lambda x: ~x.eqNullSafe(F.col(best)))).alias("also_from")

    # Most findings overlap none; these pass by, and only the others are aggregated.
    alone = (F.col("starts") == 1) & (F.col("next_starts") == 1)
    single = clustered.where(alone).select(*kept, others(F.array_distinct(F.filter(own, lambda x: x.isNotNull())), "origin"), F.lit(1).cast("bigint").alias("merged"))
    rank = F.coalesce(severity_rank(F.col("severity")), F.lit(-1))
    canonical = F.struct(
        (-rank).alias("r"), F.col("file_path").alias("f"), F.col("span.start_line").alias("l"), F.col("span.start_byte").alias("b"),
        F.col("provider_rule_id").alias("p"), F.col("finding_id").alias("i"),
    )
    origins = F.array_union(F.collect_set("origin"), F.array_distinct(F.flatten(F.collect_set(own))))
    merged = clustered.where(~alone).groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], "cluster").agg(
        F.min_by(F.struct(*kept), canonical).alias("best"), F.filter(origins, lambda x: x.isNotNull()).alias("origins"), F.count("*").alias("merged")
    )
    return single.unionByName(merged.select("best.*", others(F.col("origins"), "best.origin"), "merged"))


def merge_per_comment(findings: DataFrame) -> DataFrame:
    """merge_overlaps within each comment."""
    return merge_overlaps(findings, ("comment_id", "file_path", "category"))


def severity_histogram(findings: DataFrame) -> DataFrame:
    """One row with the number of findings of each severity, zeros included."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def rule_counts(findings: DataFrame, limit: int = 12) -> DataFrame:
    """The first `limit` canonical rules in key order, with their numbers of findings."""
    return findings.groupBy("canonical_rule_id").agg(F.count("*").alias("n")).orderBy("canonical_rule_id").limit(limit)


def by_file(findings: DataFrame) -> DataFrame:
    """Findings, the severest and the distinct rules of each file."""
    return findings.groupBy("file_path").agg(
        F.count("*").alias("findings"),
        F.max(severity_rank(F.col("severity"))).alias("worst"),
        F.array_join(F.array_sort(F.collect_set("canonical_rule_id")), ",").alias("rules"),
    )


def fold_run_states(runs: DataFrame, key: str) -> DataFrame:
    """The state of several runs: PARTIAL if any is, SKIPPED if all are, SUCCESS if any is, else EMPTY."""
    s = F.col("run_state")
    return runs.groupBy(key).agg(
        F.when(F.bool_or(s == "PARTIAL"), "PARTIAL")
        .when(F.bool_and(s == "SKIPPED"), "SKIPPED")
        .when(F.bool_or(s == "SUCCESS"), "SUCCESS")
        .otherwise("EMPTY")
        .alias("run_state")
    )


def fails(severity: Column, fail_on: str) -> Column:
    return severity_rank(severity) >= SEVERITIES.index(fail_on)


def verdict(findings: DataFrame, runs: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row: degraded if a run was partial, fail if a finding is severe enough, else pass; and its exit code."""
    partial = runs.agg(F.coalesce(F.bool_or(F.col("run_state") == "PARTIAL"), F.lit(False)).alias("partial"))
    failed = findings.agg(F.coalesce(F.bool_or(fails(F.col("severity"), fail_on)), F.lit(False)).alias("failed"))
    word = F.when(F.col("partial"), "degraded").when(F.col("failed"), "fail").otherwise("pass")
    # Both sides are single rows.
    both = partial.withColumn("one", F.lit(1)).join(failed.withColumn("one", F.lit(1)), "one")
    return both.select(word.alias("verdict"), F.when(F.col("partial"), 2).when(F.col("failed"), 1).otherwise(0).alias("code"))


def exit_code(findings: DataFrame, comments: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row: 1 if a finding is severe enough or a comment leads with DO_NOT_MERGE, else 0."""
    severe = findings.select(fails(F.col("severity"), fail_on).alias("bad"))
    marked = comments.select(F.array_contains("markers", "DO_NOT_MERGE").alias("bad"))
    return severe.union(marked).agg(F.coalesce(F.max(F.when(F.col("bad"), 1).otherwise(0)), F.lit(0)).alias("code"))


def cache_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if("cached").alias("hits"), F.count("*").alias("runs"))
