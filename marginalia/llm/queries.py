"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import copies, credentials, docpairs, leaks, machine, neighbours, packing, residue
from marginalia.sources.tables import table

COMPARED_KINDS = ("line", "block", "docstring")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a tool wrote, a machine bundled, a third party wrote, or that are data."""
    return machine.machine_paths(
        table(spark, folder, "walked_files", "path", "text", spread=True), table(spark, folder, "upstream_files", "text")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Comments that hold a credential."""
    return credentials.found_ids(table(spark, folder, "comments", "id", "raw_text", spread=True))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose documentation is a comment of the same file and says something."""
    return docpairs.documented(
        table(spark, folder, "walked_files", "path", "language", "text", spread=True),
        table(spark, folder, "comments", "path", "content_hash"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Comments that are copies of an earlier one, whatever their layout."""
    comments = table(spark, folder, "comments", "id", "kind", "raw_text", "scanned_at")
    return copies.copies(comments.where(comments.kind.isin(*COMPARED_KINDS)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of comments whose vectors are among the most similar of each other."""
    return neighbours.similar_pairs(table(spark, folder, "comment_vectors", "content_hash", "model_version", "vector"))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents", "doc_id", "text", spread=True))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of p6_packed are."""
    return packing.fill(p6_packed(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of a benchmark item."""
    return leaks.leaks(
        table(spark, folder, "benchmark_items", "item_id", "text"), table(spark, folder, "documents", "doc_id", "text", spread=True)
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue, filler, error-page or script notices."""
    return residue.residue(table(spark, folder, "documents", "doc_id", "text", spread=True)).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

_P4 = r"""
WITH t AS (
  SELECT DISTINCT id, raw_text FROM comments
  WHERE kind IN ('line', 'block', 'docstring') AND id IS NOT NULL AND raw_text IS NOT NULL
), p AS (
  SELECT id, replace(regexp_replace(lower(raw_text), '[^\p{L}\p{N}]+', '', 'g'), 'ß', 'ss') AS plain,
    list_filter(
      list_transform(regexp_split_to_array(raw_text, '[;,|\r\n]+'),
        lambda x: regexp_replace(x, '^[\s#/*"''!<>-]+|[\s*/"''!<>.-]+$', '', 'g')),
      lambda x: x <> '') AS parts
  FROM t
), f AS (
  SELECT id, plain, CASE WHEN len(parts) >= 2
    AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[\p{L}\p{N}_.-]+\s*[=:]\s*\S.*$')
      OR regexp_replace(regexp_extract(x, '^[\p{L}\p{N}_.-]+\s*[=:]\s*(\S.*)$', 1), '[^\p{L}\p{N}]+', '', 'g') = '')) = 0
    THEN '=' || array_to_string(list_sort(list_transform(parts, lambda x:
      replace(regexp_replace(lower(regexp_extract(x, '^([\p{L}\p{N}_.-]+)\s*[=:]', 1)), '[^\p{L}\p{N}]+', '', 'g'), 'ß', 'ss') || '=' ||
      replace(regexp_replace(lower(regexp_extract(x, '^[\p{L}\p{N}_.-]+\s*[=:]\s*(\S.*)$', 1)), '[^\p{L}\p{N}]+', '', 'g'), 'ß', 'ss'))), ';')
    ELSE plain END AS canonical
  FROM p
), g AS (
  SELECT id, min(id) OVER (PARTITION BY canonical) AS keep_id FROM f WHERE length(plain) >= 24
)
SELECT keep_id, id AS copy_id FROM g WHERE id > keep_id
"""

_P7 = r"""
WITH w AS (
  SELECT 'i' AS side, item_id AS owner, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM benchmark_items
  UNION ALL SELECT 'd', doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM documents
), g AS (
  SELECT DISTINCT side, owner, array_to_string(words[n:n + 11], ' ') AS gram
  FROM (SELECT side, owner, words, unnest(range(1, len(words) - 10)) AS n FROM w WHERE len(words) >= 12)
)
SELECT DISTINCT i.owner AS item_id, d.owner AS doc_id
FROM g i JOIN g d ON i.gram = d.gram AND i.side = 'i' AND d.side = 'd'
"""

ORACLES: dict[str, str] = {"p4_found": _P4, "p7_found": _P7}
