"""The verbs: check, candidates, query, context, apply_edit, remove, strip, baseline, suppressions, issues.

Each is a lazy plan over tables; sinks run it. `Session` holds the tables of one repository or many.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.vectors import hash_embedding
from marginalia.operators import edit, extract, findings, issues, providers, rank, rot, search, suppress, triage
from marginalia.schema import NATIVE, SUPPRESSED_KINDS, categories
from marginalia.sources import sinks


@dataclass(frozen=True)
class Session:
    """Tables: files (path, language, text), their comments, and what else is known."""

    files: DataFrame
    comments: DataFrame
    paths: DataFrame
    blame: DataFrame | None = None
    baseline: DataFrame | None = None
    external: DataFrame | None = None
    vectors: DataFrame | None = None


def scan(files: DataFrame, paths: DataFrame | None = None, blame: DataFrame | None = None, **more: DataFrame) -> Session:
    """A session from source files: comments extracted, bound and dated."""
    found = extract.comments(files)
    found = rot.enrich(found, blame) if blame is not None else found.withColumn("git", F.lit(None).cast("struct<author:string,email:string,commit_id:string,committed_unix:bigint>"))
    return Session(files, found, paths if paths is not None else files.select("path"), blame, **more)


def native(session: Session, off: Collection[str] = (), severities: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """Findings of the engine's own detectors, and of markers. off: detectors, or `markers`, that are switched off."""
    rows = []
    if set(rot.DETECTORS) - set(off):
        defined = extract.definitions(session.files)
        known = rot.symbols(session.comments, defined)
        signatures = defined.where(F.col("params").isNotNull())
        rows.append(rot.detect(session.comments, session.paths, known, session.blame, signatures, session.vectors, off).withColumn("severity", F.lit(None).cast("string")))
    if "markers" not in off:
        rows.append(triage.markers(session.comments, severities))
    if session.blame is not None and "candidates" not in off:
        rows.append(triage.older_than_code(session.comments, session.blame))
    none = "comment_id BIGINT, rule STRING, message STRING, start BIGINT, length BIGINT, severity STRING"
    return rot.as_findings(reduce(DataFrame.unionByName, rows) if rows else session.files.sparkSession.createDataFrame([], none), session.comments)


def external(session: Session, documents: DataFrame, manifest: providers.Manifest) -> DataFrame:
    """Findings of a tool's documents, placed in the files and attached to comments; those outside the scope are dropped."""
    rows = providers.locate(providers.normalise(documents, manifest), session.files, manifest.coordinate_system)
    rows = rows.select(
        F.xxhash64("provider_rule_id", "file_path", "line", "column", "message", "nth").alias("finding_id"), F.lit(None).cast("bigint").alias("comment_id"), "file_path",
        F.lit(None).cast("string").alias("target_hash"), F.col("file_path").alias("target_symbol"), "span", "origin", "provider_rule_id", "canonical_rule_id", "category",
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("int").alias("severity_rank"), "severity_native", "message",
        F.lit("provider_autofix" if manifest.supports_fix else "none").alias("fix"), F.lit(None).cast("string").alias("url"), F.array().cast("array<string>").alias("also_from"),
    )
    rows = findings.in_scope(rows, session.files)
    rows = findings.in_comments(rows, session.comments) if manifest.comment_scoped else rows
    return findings.attach(rows, session.comments)


def check(session: Session, overrides: dict[str, str] | None = None, off: Collection[str] = (), severities: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """All findings: native and external, with severities, overlaps of a comment merged, suppression flagged.

    overrides: severities by rule, category or origin; severities: by marker. off: as in `native`.
    """
    spark = session.files.sparkSession
    by_marker = {f"{NATIVE}:{triage.RULE}{m}": s for m, s in severities.items()}
    rows = native(session, off, severities)
    if session.external is not None:
        rows = rows.unionByName(session.external, allowMissingColumns=True)
    rows = findings.resolve_severity(rows, categories(spark), by_marker | (overrides or {}))
    merged = findings.merge_per_comment(rows).drop("merged")
    empty = spark.createDataFrame([], "bound_symbol STRING, fingerprint STRING, rule STRING")
    return suppress.suppress(merged, session.comments, session.baseline if session.baseline is not None else empty)


def summary(checked: DataFrame, comments: DataFrame) -> DataFrame:
    """One row: comments, findings, unattached, suppressed."""
    n = comments.agg(F.count("*").alias("comments")).withColumn("one", F.lit(1))
    f = checked.agg(
        F.count_if(F.col("suppressed_by").isNull()).alias("findings"), F.count_if(F.col("comment_id").isNull()).alias("unattached"),
        F.count_if(F.col("suppressed_by").isNotNull()).alias("suppressed"),
    ).withColumn("one", F.lit(1))
    return n.join(f, "one").drop("one")


def candidates(session: Session, limit: int = 20, off: Collection[str] = ()) -> DataFrame:
    """The engine's own findings, ranked."""
    return rank.actionable(native(session, off), session.comments, limit)


def query(session: Session, text: str, limit: int = 20) -> DataFrame:
    """id, score, path, line, kind, summary of the comments that answer a query, by words and by vectors."""
    shown = session.comments.where(~F.col("kind").isin(*SUPPRESSED_KINDS))
    distinct = shown.groupBy("content_hash").agg(F.first("raw_text").alias("raw_text"))
    vectors = shown.select("id", "content_hash").join(hash_embedding(distinct, "content_hash", "raw_text"), "content_hash")
    top = search.hybrid(shown, vectors.select("id", "vector"), text, search.embed(text), limit)
    return top.join(shown.select("id", "path", F.col("span.start_line").alias("line"), "kind", F.trim(F.substring_index("raw_text", "\n", 1)).alias("summary")), "id").orderBy(F.desc("score"), "id")


def context(session: Session, comment_id: int | None, checked: DataFrame, with_code: bool = False) -> DataFrame:
    """One comment, or each if none is named, with its findings and, if asked, the code that it is about."""
    this = F.lit(True) if comment_id is None else F.col("id") == comment_id
    one = session.comments.where(this)
    found = checked.where(F.lit(True) if comment_id is None else F.col("comment_id") == comment_id).groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("provider_rule_id", "category", "severity", "message"))).alias("findings"))
    out = one.join(found.withColumnRenamed("comment_id", "id"), "id", "left")
    if with_code:
        code = F.decode(F.substring(F.encode("text", "UTF-8"), (F.col("bound_node_range.start_byte") + 1).cast("int"), (F.col("bound_node_range.end_byte") - F.col("bound_node_range.start_byte")).cast("int")), "UTF-8")
        out = out.join(session.files.select("path", "text"), "path", "left").withColumn("code", code).drop("text")
    return out


def apply_edit(session: Session, comment_id: int, new_text: str, allow_significant: bool = False) -> DataFrame:
    """The file with a comment's text replaced, or the reason why not."""
    one = session.comments.where(F.col("id") == comment_id)
    allowed = one.where(~edit.protected(F.col("kind"), F.lit(allow_significant)))
    return edit.apply_edits(session.files, allowed.select("path", "span", F.lit(new_text).alias("new_text")))


def remove(session: Session, comment_id: int, allow_significant: bool = False) -> DataFrame:
    return apply_edit(session, comment_id, "", allow_significant)


def recheck(edited: DataFrame, files: DataFrame, anchor: int) -> DataFrame:
    """Native findings, in the edited file, of the comment that covers a byte."""
    again = files.select("path", "language").join(edited.where("ok").select("path", F.col("new_text").alias("text")), "path")
    session = scan(again, files.select("path"))
    # What is known of other files isn't there: only markers are looked for.
    here = session.comments.where((F.col("span.start_byte") <= anchor) & (F.lit(anchor) < F.col("span.end_byte"))).select(F.col("id").alias("comment_id"))
    return native(session, rot.DETECTORS).join(here, "comment_id", "left_semi")


def strip(session: Session, keep_kinds: Sequence[str] = (), allow_significant: bool = False, strip_license: bool = False, apply: bool = False) -> DataFrame:
    """What stripping comments would do to each file; with apply, the new texts."""
    plan = edit.removal_plan(session.comments, keep_kinds, allow_significant, strip_license)
    return edit.strip(session.files, plan) if apply else edit.strip_files(plan)


def baseline_accept(checked: DataFrame, comments: DataFrame) -> DataFrame:
    return suppress.accept(checked, comments)


def baseline_prune(baseline: DataFrame, checked: DataFrame, comments: DataFrame) -> DataFrame:
    return suppress.prune(baseline, checked, comments)


def suppressions_export(checked: DataFrame) -> DataFrame:
    return suppress.export_directives(checked)


def suppressions_place(session: Session, checked: DataFrame) -> DataFrame:
    """The files with directives for all findings put behind their lines, where that leaves the code alone."""
    return edit.apply_edits(session.files, suppress.placements(suppress.export_directives(checked), session.files))


def known_providers(spark: SparkSession) -> DataFrame:
    """provider, languages, categories, comment_scoped, supports_fix of the built-in manifests."""
    rows = [(m.id, list(m.languages), sorted({*m.category_map.values(), *([m.default_category] if m.default_category else [])}), m.comment_scoped, m.supports_fix) for m in providers.BUILT_IN]
    return spark.createDataFrame(rows, "provider STRING, languages ARRAY<STRING>, categories ARRAY<STRING>, comment_scoped BOOLEAN, supports_fix BOOLEAN")


def report(checked: DataFrame, comments: DataFrame, runs: DataFrame, folder: str, fail_on: str = "error") -> DataFrame:
    """Writes SARIF, Markdown rows and JSON lines of a check below a folder; gives its verdict."""
    shown = suppress.live(checked)
    sinks.write_sarif(shown, f"{folder}/sarif")
    sinks.markdown_rows(shown).select("value").write.mode("overwrite").text(f"{folder}/markdown")
    sinks.write_jsonl(comments, f"{folder}/jsonl")
    return findings.verdict(shown, runs, fail_on)


def issues_sync(session: Session, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to file, and which comments are done."""
    tokens = issues.marker_tokens(session.comments)
    return issues.to_file(tokens, ledger), issues.resolved(tokens, ledger)
