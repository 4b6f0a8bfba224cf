"""Suppression by directives in comments and by a baseline; findings are flagged, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import directive
from marginalia.operators.classify import DIRECTIVE_WORD

KEY = ("bound_symbol", "fingerprint", "rule")
#: The name of what a directive without targets names.
ALL = ""


def directives(comments: DataFrame, word: str = DIRECTIVE_WORD) -> DataFrame:
    """directive_id, path, line, verb, targets of every comment that holds a directive, whatever its kind."""
    found = comments.where(F.col("raw_text").contains(f"{word}:")).select(
        F.col("id").alias("directive_id"), "path", F.col("span.start_line").alias("line"), directive(F.col("raw_text"), word).alias("d")
    )
    return found.where(F.col("d").isNotNull()).select("directive_id", "path", "line", "d.verb", "d.targets")


def _names() -> Column:
    """What directives may name a finding by, ALL among them."""
    names = F.array("provider_rule_id", "canonical_rule_id", "category", "origin", F.lit(ALL))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def suppressed_by_directive(findings: DataFrame, found: DataFrame, everywhere: bool = False) -> DataFrame:
    """finding_id, directive_id: the first directive that covers each finding.

    A directive covers its file, its line, the next line, or the region from its line on unless an enabling directive
    stands between it and the finding. Directives are exploded to what they name (a rule, category or origin; all, if they
    name nothing), and findings to their names, so that file and line scopes are equality joins with one row for each
    place and name. Regions are one window over each file and name, in order of lines, over findings and directives
    together: the earliest disabling directive since the last enabling one. everywhere: as if all rows were of one file, for
    repositories whose directives are pooled; names and lines still split the work.
    """
    place = F.lit("").alias("path") if everywhere else F.col("file_path").alias("path")
    f = findings.select("finding_id", place, F.col("span.start_line").cast("int").alias("line"), F.explode(_names()).alias("name"))
    d = found.withColumn("path", F.lit("")) if everywhere else found
    targets = F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.array(F.lit(ALL)))
    one = F.struct(F.col("path").alias("p"), F.col("line").alias("l"), F.col("directive_id").alias("d"))
    d = d.select("path", "verb", F.col("line").cast("int").alias("line"), F.explode(targets).alias("name"), one.alias("one"))

    def first(verb: str, *keys: str, shift: int = 0) -> DataFrame:
        rows = d.where(F.col("verb") == verb).withColumn("line", F.col("line") + shift)
        return f.join(rows.groupBy(*keys).agg(F.min("one").alias("one")), list(keys)).select("finding_id", "one")

    by_place = first("disable-file", "path", "name").unionByName(first("disable-line", "path", "line", "name"))
    by_place = by_place.unionByName(first("disable-next-line", "path", "line", "name", shift=1))
    return by_place.unionByName(_in_regions(f, d)).groupBy("finding_id").agg(F.min("one").alias("one")).select("finding_id", F.col("one.d").alias("directive_id"))


def _in_regions(f: DataFrame, d: DataFrame) -> DataFrame:
    """finding_id, one: the first region that holds each finding, for each of its names.

    A directive that names nothing opens a region of all names, and an enabling one that names nothing ends all regions,
    so that those of a file are repeated for each name that the file's regions have; an enabling directive that names
    something ends the regions of that name, and those of all names.
    """
    region = d.where(F.col("verb").isin("disable", "enable"))
    names = region.where(F.col("name") != ALL).select("path", "name").distinct().withColumnRenamed("name", "_name")
    enabling, disabling = region.where("verb = 'enable'"), region.where("verb = 'disable'")
    plain = region.where(F.col("name") != ALL)
    ends_all = enabling.where(F.col("name") == ALL).join(names, "path").withColumn("name", F.col("_name")).drop("_name")
    # Regions of all names end at every enabling directive of the file.
    ends_any = enabling.withColumn("name", F.lit(ALL))
    marks = plain.unionByName(ends_all).unionByName(ends_any).unionByName(disabling.where(F.col("name") == ALL))
    marks = marks.select("path", "name", "line", F.when(F.col("verb") == "enable", 0).otherwise(1).alias("what"), F.lit(None).cast("bigint").alias("finding_id"), "one")
    empty = F.lit(None).cast(marks.schema["one"].dataType)
    asked = f.select("path", "name", "line", F.lit(2).alias("what"), "finding_id", empty.alias("one"))
    # On one line a region that ends comes before one that begins, and both before the findings.
    order = Window.partitionBy("path", "name").orderBy("line", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(asked).withColumn("run", F.sum(F.when(F.col("what") == 0, 1).otherwise(0)).over(order))
    within = Window.partitionBy("path", "name", "run").orderBy("line", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("one", F.min(F.when(F.col("what") == 1, F.col("one"))).over(within))
    return held.where((F.col("what") == 2) & F.col("one").isNotNull()).select("finding_id", "one")


def unused_directives(findings: DataFrame, found: DataFrame, everywhere: bool = False) -> DataFrame:
    """Directives, other than enabling ones, that suppress nothing."""
    used = suppressed_by_directive(findings, found, everywhere).select("directive_id")
    return found.where(F.col("verb") != "enable").join(used, "directive_id", "left_anti")


def keyed_findings(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """finding_id and its baseline keys: symbol and fingerprint of its comment, with either rule id."""
    c = comments.select(F.col("id").alias("comment_id"), "bound_symbol", F.col("cosmetic_fingerprint").alias("fingerprint"))
    return (
        findings.join(c, "comment_id")
        .select("finding_id", "bound_symbol", "fingerprint", F.explode(F.array_distinct(F.array("provider_rule_id", "canonical_rule_id"))).alias("rule"))
        .where(F.col("fingerprint").isNotNull())
    )


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    out = F.lit(True)
    for k in KEY:
        out = out & left[k].eqNullSafe(right[k])
    return out


def in_baseline(findings: DataFrame, comments: DataFrame, baseline: DataFrame) -> DataFrame:
    """finding_id of findings whose key, under either rule id, stands in the baseline."""
    keys, known = keyed_findings(findings, comments), baseline.select(*KEY)
    return keys.join(known, _same_key(keys, known), "left_semi").select("finding_id").distinct()


def new_findings(findings: DataFrame, comments: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(in_baseline(findings, comments, baseline), "finding_id", "left_anti")


def accept(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """A baseline of all findings, suppressed ones included: distinct keys in order, null symbols first."""
    c = comments.select(F.col("id").alias("comment_id"), "bound_symbol", F.col("cosmetic_fingerprint").alias("fingerprint"))
    rows = findings.join(c, "comment_id").where(F.col("fingerprint").isNotNull())
    return rows.select("bound_symbol", "fingerprint", F.col("provider_rule_id").alias("rule")).distinct().orderBy(F.asc_nulls_first("bound_symbol"), "fingerprint", "rule")


def prune(baseline: DataFrame, findings: DataFrame, comments: DataFrame) -> DataFrame:
    """The entries of a baseline that a finding still has, with their reasons and dates."""
    live = keyed_findings(findings, comments).select(*KEY).distinct()
    return baseline.join(live, _same_key(baseline, live), "left_semi")


def suppress(findings: DataFrame, comments: DataFrame, baseline: DataFrame, word: str = DIRECTIVE_WORD) -> DataFrame:
    """findings with suppressed_by: 'directive' or 'baseline' (directives first), else null."""
    by_directive = suppressed_by_directive(findings, directives(comments, word)).select("finding_id", F.lit("directive").alias("d"))
    by_baseline = in_baseline(findings, comments, baseline).select("finding_id", F.lit("baseline").alias("b"))
    out = findings.join(by_directive, "finding_id", "left").join(by_baseline, "finding_id", "left")
    return out.withColumn("suppressed_by", F.coalesce("d", "b")).drop("d", "b")


def live(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("suppressed_by").isNull()).drop("suppressed_by")


def export_directives(findings: DataFrame, word: str = DIRECTIVE_WORD) -> DataFrame:
    """path, line, origin, directive: one directive for each line and origin, naming its rules in order."""
    rules = F.array_join(F.array_sort(F.collect_set("provider_rule_id")), ",")
    rows = findings.groupBy(F.col("file_path").alias("path"), F.col("span.start_line").alias("line"), "origin")
    return rows.agg(F.concat(F.lit(f"{word}:disable-line="), rules).alias("directive"))


def placements(exported: DataFrame, files: DataFrame, word: str = DIRECTIVE_WORD) -> DataFrame:
    """path, span, new_text: edits that put exported directives behind their lines; `edit.apply_edits` checks them.

    Several origins on one line share a comment. Lines that hold a directive already stay as they are, so that
    placing twice changes nothing.
    """
    lines = exported.groupBy("path", "line").agg(F.array_join(F.array_sort(F.collect_set("directive")), " ").alias("directive"))
    texts = files.select("path", "language", F.split("text", "\n").alias("rows"))
    row = F.try_element_at("rows", F.col("line"))
    before = F.when(F.col("line") > 1, F.octet_length(F.array_join(F.slice("rows", F.lit(1), F.col("line") - 1), "\n")) + 1).otherwise(F.lit(0))
    end = (before + F.octet_length(F.regexp_replace(row, r"\s+$", ""))).cast("bigint")
    mark = F.when(F.col("language").isin("python", "shell"), "  # ").otherwise("  // ")
    placed = lines.join(texts, "path").where(row.isNotNull() & ~row.contains(f"{word}:"))
    span = F.struct(end.alias("start_byte"), end.alias("end_byte"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return placed.select("path", span.alias("span"), F.concat(mark, "directive").alias("new_text"))
