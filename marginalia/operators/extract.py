"""Source files to comments: extraction, merging of neighbouring lines, kinds, markers and binding to code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash, fingerprint
from marginalia.operators.classify import kind, markers
from marginalia.operators.parse import Node, enclosing, parse
from marginalia.schema import MODULE, RANGE

PIECES = (
    f"path STRING, language STRING, span {RANGE}, raw_text STRING, is_docstring BOOLEAN, own_line BOOLEAN, joint STRING, "
    f"bound_symbol STRING, bound_node_range {RANGE}"
)
DEFINITIONS = f"path STRING, symbol STRING, span {RANGE}, params ARRAY<STRING>, has_return BOOLEAN, raises ARRAY<STRING>"


class _Places:
    """Characters of a text to bytes and lines."""

    def __init__(self, text: str) -> None:
        self.text, self.ascii = text, text.isascii()
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode("utf-8", "surrogatepass"))

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, at) + 1

    def span(self, start: int, end: int) -> dict:
        return {"start_byte": self.byte(start), "end_byte": self.byte(end), "start_line": self.line(start), "end_line": self.line(max(start, end - 1))}


def _bind(text: str, places: _Places, nodes: list[Node], start: int, end: int, doc: bool, own_line: bool, language: str) -> tuple[str, dict | None]:
    """The symbol and the code that a comment is about.

    Documentation in Python belongs to the definition around it; a comment on its own line to what begins on the next
    line; a comment behind code to that code. A comment that a blank line follows is about nothing in particular.
    """
    around = enclosing(nodes, start)
    if doc and language == "python":
        node = max((n for n in nodes if n.start <= start < n.end), key=lambda n: n.start, default=None)
        return (node.symbol, places.span(node.start, node.end)) if node else (MODULE, places.span(0, len(text)))
    if not own_line:
        head = text.rfind("\n", 0, start) + 1
        code = text[head:start].rstrip()
        begin = head + len(code) - len(code.lstrip())
        return enclosing(nodes, begin), places.span(begin, head + len(code))
    following = re.compile(r"[ \t]*\r?\n([ \t]*)(?=[^\s])").match(text, end)
    if not following:
        return around, None
    begin = following.end()
    # Decorators and `export` stand before the definition that they belong to.
    ahead = begin
    while language == "python" and text.startswith("@", ahead):
        ahead = re.compile(r"[^\n]*\n[ \t]*").match(text, ahead).end()
    exported = re.compile(r"export\s+(?:default\s+)?").match(text, begin)
    for node in nodes:
        if node.start in (begin, ahead) or exported and exported.end() == node.start:
            return node.symbol, places.span(node.start, node.end)
    stop = text.find("\n", begin)
    return around, places.span(begin, len(text) if stop < 0 else stop)


def _pieces(path: str, language: str, text: str) -> Iterator[tuple]:
    found, nodes = parse(text, language)
    places = _Places(text)
    before = 0
    for piece in found:
        head = text.rfind("\n", 0, piece.start) + 1
        own_line = not text[head : piece.start].strip()
        symbol, node = _bind(text, places, nodes, piece.start, piece.end, piece.doc, own_line, language)
        joint = text[before : piece.start]
        before = piece.end
        yield (
            path, language, places.span(piece.start, piece.end), text[piece.start : piece.end], piece.doc and language == "python",
            own_line, joint if not joint.strip() else None, symbol, node,
        )


def extract(files: DataFrame) -> DataFrame:
    """PIECES: every comment of files (path, language, text), by place; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "language", "span", "raw_text", "is_docstring", "own_line", "joint", "bound_symbol", "bound_node_range"]
        for batch in batches:
            rows = [r for p, la, t in zip(batch["path"], batch["language"], batch["text"], strict=True) for r in _pieces(p, la, t)]
            yield pd.DataFrame(rows, columns=columns)

    usable = files.where(F.col("path").isNotNull() & F.col("language").isNotNull() & F.col("text").isNotNull())
    return usable.select("path", "language", "text").mapInPandas(run, PIECES)


def definitions(files: DataFrame) -> DataFrame:
    """DEFINITIONS of files; params is null for classes and constants."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text in zip(batch["path"], batch["language"], batch["text"], strict=True):
                places = _Places(text)
                for n in parse(text, language)[1]:
                    rows.append((path, n.symbol, places.span(n.start, n.end), None if n.params is None else list(n.params), n.has_return, list(n.raises)))
            yield pd.DataFrame(rows, columns=["path", "symbol", "span", "params", "has_return", "raises"])

    usable = files.where(F.col("path").isNotNull() & F.col("language").isNotNull() & F.col("text").isNotNull())
    return usable.select("path", "language", "text").mapInPandas(run, DEFINITIONS)


def coalesce_lines(pieces: DataFrame) -> DataFrame:
    """Line comments on lines of their own, one right below the other, as one block; everything else unchanged.

    A run ends at any other kind, at code, and at an empty line: islands over each file, by a running sum of breaks.
    Needs `kind`, `own_line` and `joint`, the text between a comment and the one before it.
    """
    order = Window.partitionBy("path").orderBy("span.start_byte")
    merges = (F.col("kind") == "line") & F.col("own_line")
    follows = (
        merges
        & F.coalesce(F.lag(merges).over(order), F.lit(False))
        & (F.col("span.start_line") == F.lag("span.end_line").over(order) + 1)
        & F.col("joint").isNotNull()
    )
    islands = pieces.withColumn("starts", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("starts").over(order))
    row = F.struct("span", "raw_text", "joint", *[c for c in pieces.columns if c not in ("path", "span", "raw_text", "joint")])
    runs = islands.groupBy("path", "island").agg(F.sort_array(F.collect_list(row)).alias("run"))
    first, last = F.element_at("run", 1), F.element_at("run", -1)
    rest = F.transform(F.slice("run", F.lit(2), F.size("run")), lambda r: F.concat(r["joint"], r["raw_text"]))
    many = F.size("run") > 1
    span = F.struct(
        first["span"]["start_byte"].alias("start_byte"), last["span"]["end_byte"].alias("end_byte"),
        first["span"]["start_line"].alias("start_line"), last["span"]["end_line"].alias("end_line"),
    )
    kept = [c for c in pieces.columns if c not in ("path", "span", "raw_text", "joint", "kind", "bound_symbol", "bound_node_range")]
    return runs.select(
        "path", span.alias("span"), F.when(many, F.concat(first["raw_text"], F.array_join(rest, ""))).otherwise(first["raw_text"]).alias("raw_text"),
        F.when(many, F.lit("block")).otherwise(first["kind"]).alias("kind"), last["bound_symbol"].alias("bound_symbol"),
        last["bound_node_range"].alias("bound_node_range"), *[first[c].alias(c) for c in kept],
    )


def comments(files: DataFrame, custom_markers: tuple[str, ...] = ()) -> DataFrame:
    """The comments of files (path, language, text) as in `schema.COMMENTS`, without git.

    The id is a hash of path and place, so that it needs no global order.
    """
    pieces = extract(files)
    raw = F.col("raw_text")
    pieces = pieces.withColumn("kind", kind(raw, F.col("language"), F.col("span.start_line"), F.col("is_docstring")))
    merged = coalesce_lines(pieces)
    return merged.select(
        F.xxhash64("path", "span.start_byte").alias("id"), "path", content_hash(raw).alias("content_hash"), "language", "kind", "span", "raw_text",
        "bound_symbol", "bound_node_range", markers(raw, custom_markers).alias("markers"), F.lit(False).alias("is_rot_candidate"), fingerprint(raw).alias("cosmetic_fingerprint"),
    )


def scan_order(comments: DataFrame) -> DataFrame:
    """comments with seq: 1, 2, ... within each file."""
    return comments.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("span.start_byte", "id")))
