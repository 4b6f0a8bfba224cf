"""Edits of comments that leave the code alone: every edit is checked by comparing code tokens before and after."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.parse import code_tokens
from marginalia.schema import BEHAVING_KINDS

EDITED = "path STRING, new_text STRING, ok BOOLEAN, reason STRING, applied INT"
STRIPPED = "path STRING, new_text STRING, removed INT, failed INT, lines ARRAY<INT>"


def protected(kind: Column, allow_significant: Column) -> Column:
    """Whether an edit of a comment of this kind is refused."""
    return kind.isin(*BEHAVING_KINDS) & ~allow_significant


def splice(data: bytes, edits: Sequence[tuple[int, int, str]]) -> bytes:
    """`data` with byte ranges replaced; ranges don't overlap."""
    for start, end, new in sorted(edits, reverse=True):
        data = data[:start] + new.encode("utf-8") + data[end:]
    return data


def is_string(text: str) -> bool:
    """Whether a text is one string literal of Python."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return isinstance(tree.body, ast.Constant) and isinstance(tree.body.value, str)


def parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def code_unchanged(before: str, after: str, language: str, removed: Sequence[tuple[int, int]] = (), added: Sequence[tuple[int, int]] = ()) -> bool:
    """Whether two texts have the same code. removed, added: byte ranges of documentation strings that may differ."""

    def chars(text: str, ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
        data = text.encode("utf-8")
        return [(len(data[:a].decode("utf-8", "ignore")), len(data[:b].decode("utf-8", "ignore"))) for a, b in ranges]

    if language == "python" and parses(before) and not parses(after):
        return False
    try:
        return code_tokens(before, language, chars(before, removed)) == code_tokens(after, language, chars(after, added))
    except RecursionError:
        return False


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """EDITED: files with the edits (path, span, new_text) of each spliced in, or the reason why not.

    Edits are grouped by path and joined with the files once; a file whose code would change stays as it is.
    """
    grouped = edits.groupBy("path").agg(F.collect_list(F.struct("span.start_byte", "span.end_byte", "new_text")).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text, todo in zip(batch["path"], batch["language"], batch["text"], batch["edits"], strict=True):
                wanted = [(int(e["start_byte"]), int(e["end_byte"]), e["new_text"] or "") for e in todo]
                data = text.encode("utf-8")
                if any(not 0 <= a <= b <= len(data) for a, b, _ in wanted):
                    rows.append((path, text, False, "outside the file", 0))
                    continue
                new = splice(data, wanted).decode("utf-8", "replace")
                # Documentation strings of Python are code to the lexer: an exchange of one for another is left out.
                shift, removed, added = 0, [], []
                for a, b, piece in sorted(wanted):
                    size = len(piece.encode("utf-8"))
                    if language == "python" and is_string(data[a:b].decode("utf-8", "replace")) and (not piece or is_string(piece)):
                        removed.append((a, b))
                        added.append((a + shift, a + shift + size))
                    shift += size - (b - a)
                same = code_unchanged(text, new, language, removed, added)
                rows.append((path, new if same else text, same, None if same else "the code would change", len(wanted) if same else 0))
            yield pd.DataFrame(rows, columns=["path", "new_text", "ok", "reason", "applied"])

    return files.select("path", "language", "text").join(grouped, "path").mapInPandas(run, EDITED)


def removal_plan(comments: DataFrame, keep_kinds: Sequence[str] = (), allow_significant: bool = False, strip_license: bool = False) -> DataFrame:
    """comments with action: remove, kept_by_kind, kept_license or kept_significant, in this order of precedence."""
    kind = F.col("kind")
    action = (
        F.when(kind.isin(*keep_kinds) if keep_kinds else F.lit(False), "kept_by_kind")
        .when((kind == "license") & F.lit(not strip_license), "kept_license")
        .when(kind.isin(*BEHAVING_KINDS) & F.lit(not allow_significant), "kept_significant")
        .otherwise("remove")
    )
    return comments.withColumn("action", action)


def tidy(text: str, touched: set[int]) -> str:
    """The touched lines (from 0) without trailing blanks, and without those that are empty now."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if i not in touched:
            out.append(line)
        elif line.strip():
            out.append(line.rstrip())
    return "\n".join(out)


def strip_text(text: str, language: str, spans: Sequence[tuple[int, int]], tidy_up: bool = True) -> tuple[str, int, int, list[int]]:
    """(new text, removed, failed, lines) with the comments at byte ranges taken out.

    All are taken out at once and checked once; only if the code would change they are tried one by one, from the end.
    Multi-line comments leave their first line as the touched one.
    """
    data = text.encode("utf-8")
    lines = {data.count(b"\n", 0, a) for a, _ in spans}

    def attempt(ranges: Sequence[tuple[int, int]]) -> str | None:
        new = splice(data, [(a, b, "") for a, b in ranges]).decode("utf-8", "replace")
        return new if code_unchanged(text, new, language, ranges) else None

    done = list(spans)
    new = attempt(done)
    if new is None:
        done = []
        for span in sorted(spans, reverse=True):
            if (one := attempt([*done, span])) is not None:
                done.append(span)
                new = one
    new = text if new is None else new
    touched = set()
    for a, _ in done:
        gone = sum(data.count(b"\n", x, y) for x, y in done if y <= a)
        touched.add(data.count(b"\n", 0, a) - gone)
    if tidy_up and done:
        neat = tidy(new, touched)
        new = neat if code_unchanged(new, neat, language) else new
    lines = {data.count(b"\n", 0, a) + 1 for a, _ in done}
    return new, len(done), len(spans) - len(done), sorted(lines)


def strip(files: DataFrame, plan: DataFrame, tidy_up: bool = True) -> DataFrame:
    """STRIPPED: files without the comments that a removal plan takes out."""
    spans = plan.where(F.col("action") == "remove").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("span.start_byte", "span.end_byte"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text, todo in zip(batch["path"], batch["language"], batch["text"], batch["spans"], strict=True):
                rows.append((path, *strip_text(text, language, [(int(s["start_byte"]), int(s["end_byte"])) for s in todo], tidy_up)))
            yield pd.DataFrame(rows, columns=["path", "new_text", "removed", "failed", "lines"])

    return files.select("path", "language", "text").join(spans, "path").mapInPandas(run, STRIPPED)


def strip_report(plan: DataFrame) -> DataFrame:
    """One row: files and comments scanned, removed, and kept for each reason."""
    count = lambda action: F.count_if(F.col("action") == action).alias("removed" if action == "remove" else action)
    return plan.agg(F.countDistinct("path").alias("files"), F.count("*").alias("comments"), *map(count, ("remove", "kept_by_kind", "kept_license", "kept_significant")))


def strip_files(plan: DataFrame) -> DataFrame:
    """path, removed, lines of the files that lose comments; most first."""
    rows = plan.where(F.col("action") == "remove").groupBy("path").agg(F.count("*").alias("removed"), F.array_sort(F.collect_list("span.start_line")).alias("lines"))
    return rows.orderBy(F.desc("removed"), "path")
