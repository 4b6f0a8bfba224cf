"""Results as files: JSON lines, SARIF, Markdown, CSV, terminal text, TOML, and the index tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import csv_field, markdown_cell, sarif_level, tokens
from marginalia.operators.findings import severity_rank
from marginalia.operators.identity import ordinals
from marginalia.operators.rank import CANONICAL
from marginalia.sources.records import JSONL_VERSION

CSV_COLUMNS = ("file_path", "line", "severity", "category", "provider_rule_id", "origin", "message")


def jsonl_rows(comments: DataFrame, version: int = JSONL_VERSION) -> DataFrame:
    """path, start, value: one JSON text for each comment; empty lists are left out, as nulls are. The header has a null path."""
    columns = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in comments.dtypes]
    rows = comments.select("path", F.col("span.start_byte").alias("start"), F.to_json(F.struct(*columns)).alias("value"))
    spark = comments.sparkSession
    header = spark.createDataFrame([(None, None, json.dumps({"schema_version": version}))], "path STRING, start BIGINT, value STRING")
    return header.unionByName(rows)


def write_jsonl(comments: DataFrame, path: str) -> None:
    """JSON lines in scan order. Files are ranges of the order, so that no task sorts everything."""
    jsonl_rows(comments).sort(F.asc_nulls_first("path"), "start").select("value").write.mode("overwrite").text(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    """finding_id, value: RFC 4180 rows of findings."""
    cells = [csv_field(F.coalesce((F.col("span.start_line") if c == "line" else F.col(c)).cast("string"), F.lit(""))) for c in CSV_COLUMNS]
    return findings.select("finding_id", F.concat_ws(",", *cells).alias("value"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """finding_id, value: rows of a Markdown table of findings."""
    cells = [markdown_cell(F.coalesce((F.col("span.start_line") if c == "line" else F.col(c)).cast("string"), F.lit(""))) for c in CSV_COLUMNS]
    return findings.select("finding_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def sarif_result() -> Column:
    """The SARIF result of a finding as JSON."""
    region = F.struct(F.col("span.start_line").alias("startLine"), F.col("span.end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("provider_rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
    )
    return F.to_json(result)


def sarif_results(findings: DataFrame) -> DataFrame:
    """finding_id, value: the SARIF result of each finding as JSON."""
    return findings.select("finding_id", sarif_result().alias("value"))


def rule_descriptors(findings: DataFrame) -> DataFrame:
    """provider_rule_id, first: the rules in the order in which findings first name them."""
    first = findings.groupBy("provider_rule_id").agg(F.min(F.struct("file_path", F.col("span.start_line").alias("line"), F.col("span.start_byte").alias("byte"), "finding_id")).alias("first"))
    return first.orderBy("first").select("provider_rule_id", F.col("first.finding_id").alias("first"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A SARIF 2.1.0 log as text parts: head, results in canonical order, tail. Rules are few and go into the head."""
    rules = [{"id": r.provider_rule_id} for r in rule_descriptors(findings).collect()]
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"marginalia","rules":' + json.dumps(rules) + '}},"results":['
    spark = findings.sparkSession
    order = F.struct("file_path", F.col("span.start_line").alias("l"), F.col("span.start_byte").alias("b"), "provider_rule_id", "finding_id")
    rows = findings.select(F.lit(1).alias("part"), order.alias("o"), sarif_result().alias("value"))
    first = rows.agg(F.min("o")).first()[0]
    comma = F.when(F.col("o") == F.lit(None) if first is None else F.col("o.finding_id") == F.lit(first["finding_id"]), "").otherwise(",")
    body = rows.select("part", "o", F.concat(comma, "value").alias("value"))
    ends = spark.createDataFrame([(0, head), (2, "]}]}")], "part INT, value STRING")
    ends = ends.select("part", F.lit(None).cast(body.schema["o"].dataType).alias("o"), "value")
    ends.unionByName(body).sort("part", "o").select("value").write.mode("overwrite").text(path)


def terminal(findings: DataFrame) -> DataFrame:
    """file_path, value: the lines of each file's findings, severest marked, under its name."""
    line = F.format_string("  %5d  %-8s %-14s %s", F.col("span.start_line"), F.col("severity"), F.col("category"), F.coalesce("message", F.lit("")))
    rows = findings.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct(F.col("span.start_line").alias("l"), F.col("finding_id").alias("i"), line.alias("t")))).alias("rows"))
    return rows.select("file_path", F.concat(F.col("file_path"), F.lit("\n"), F.array_join("rows.t", "\n")).alias("value")).orderBy("file_path")


def report_totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), F.countDistinct("file_path").alias("files"), F.max(severity_rank(F.col("severity"))).alias("worst"))


def _entry(head: Column, fields: list[tuple[str, Column]]) -> Column:
    """A TOML table: its head, and a line for each field that isn't null."""
    lines = [F.concat(F.lit(f"{name} = "), value) for name, value in fields]
    return F.concat(F.lit("\n"), head, F.lit("\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"))


def _quoted(column: str) -> Column:
    """A string as TOML has it, which JSON has as well; null stays null."""
    return F.when(F.col(column).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(column).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def _write_toml(rows: DataFrame, order: list[Column], path: str) -> None:
    """`value` of rows in order, as text parts that make one TOML file together; ranges of the order, so that no task sorts all."""
    spark = rows.sparkSession
    placed = rows.select(F.lit(1).alias("part"), F.struct(*order).alias("o"), "value")
    head = spark.createDataFrame([(0, "version = 1")], "part INT, value STRING").select("part", F.lit(None).cast(placed.schema["o"].dataType).alias("o"), "value")
    head.unionByName(placed).sort("part", "o").select("value").write.mode("overwrite").text(path)


def write_baseline(baseline: DataFrame, path: str) -> None:
    """A baseline as TOML below the folder `path`, in canonical order, null symbols first."""
    names = [c for c in ("bound_symbol", "fingerprint", "rule", "reason", "date") if c in baseline.columns]
    rows = baseline.distinct().withColumn("value", _entry(F.lit("[[entries]]"), [(c, _quoted(c)) for c in names]))
    _write_toml(rows, [F.col(c) for c in ("bound_symbol", "fingerprint", "rule")], path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """An issue ledger as TOML below the folder `path`, in order of tokens."""
    fields = [("id", _quoted("id")), ("url", _quoted("url")), ("closed", F.when(F.col("closed"), "true").otherwise("false"))]
    rows = ledger.withColumn("value", _entry(F.concat(F.lit("[issues."), _quoted("token"), F.lit("]")), fields))
    _write_toml(rows, [F.col("token")], path)


def persist_index(comments: DataFrame, findings: DataFrame, vectors: DataFrame, folder: str) -> None:
    """The index as Parquet tables: comments, findings, identity, words with positions' counts, vectors. Rebuilt as a whole."""
    identity = ordinals(comments).select("id", "bound_symbol", "kind", "cosmetic_fingerprint", "ordinal")
    words = comments.select("id", F.explode(tokens(F.col("raw_text"))).alias("word")).groupBy("word", "id").agg(F.count("*").alias("times"))
    for name, df in (("comments", comments), ("findings", findings), ("identity", identity), ("words", words), ("vectors", vectors)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")



def open_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("comments", "findings", "identity", "words", "vectors")}


def store_results(results: DataFrame, cache: str) -> None:
    """Complete results of providers appended to the cache; partial and skipped runs are not kept."""
    results.where(F.col("run_state").isin("SUCCESS", "EMPTY")).write.mode("append").parquet(cache)


def first_in_order(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings in canonical order with their position."""
    head = findings.orderBy(*CANONICAL).limit(limit)
    return head.withColumn("position", F.row_number().over(Window.orderBy(*CANONICAL)))
