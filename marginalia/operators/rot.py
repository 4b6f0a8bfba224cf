"""Comments that no longer match the code: stale references, missing paths, age, signatures, meaning.

Detectors give rows comment_id, rule, category, message, start (byte of the piece in the comment, or null). They are
joins and set expressions; only doc contracts are parsed line by line, in Python.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.places import sub_span
from marginalia.functions.vectors import cosine
from marginalia.operators.classify import intent
from marginalia.schema import CATEGORY_SEVERITY, MODULE, NATIVE, SEVERITIES

# Fixed values.
NO_SYMBOLS = (
    "true", "false", "none", "null", "nil", "self", "cls", "this", "super", "new", "void", "async", "await", "return", "yield",
    "todo", "fixme", "hack", "xxx", "bug", "note", "warning", "error", "info", "debug", "trace", "critical", "fatal", "notice", "deprecated",
)
PATH_EXTENSIONS = (
    "py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "sh", "bash", "html", "css", "scss", "json", "toml", "yaml", "yml", "md",
    "sql", "txt", "cfg", "ini", "env", "rs", "go", "rb", "vue",
)
DRIFT_DAYS = 30
#: Lines of a block whose latest commit is kept.
BLOCK_LINES = 64
LEAST_MEANING = 35

_NAME = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"
#: A span in back ticks ends with as many as it began with; what it holds is a name, perhaps called.
_TICKED = r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)"
_HELD = rf"^\s*({_NAME})\s*(\(.*\))?\s*$"
_CALLED = rf"(?<![\w`.$])({_NAME})\(([^()`\n]*)\)"
#: Detectors that can be switched off.
DETECTORS = ("references", "paths", "drift", "signatures", "meaning")
RULES = {"rot_candidate": "rot_candidate", "rot_ref": "reference_stale", "rot_path": "path_missing", "rot_drift": "rot_candidate", "rot_signature": "doc_drift", "rot_semantic": "rot_candidate"}


def with_intent(comments: DataFrame) -> DataFrame:
    return comments.withColumn("intent", intent(F.col("raw_text"), F.col("kind"), F.col("markers"), F.col("bound_symbol")))


def _byte(text: Column, piece: Column) -> Column:
    return F.octet_length(F.call_function("substring_index", text, piece, F.lit(1))).cast("bigint")


def references(comments: DataFrame) -> DataFrame:
    """comment_id, name, ticked, called: names in back ticks and calls in plain text, each once per comment.

    Plain calls count if they are structured: at least four letters with a dot, underscore or mixed case, and empty
    arguments or a dotted name. Names in back ticks are taken without their call.
    """
    text = F.col("raw_text")
    held = F.filter(F.regexp_extract_all(text, F.lit(_TICKED), F.lit(2)), lambda m: m.rlike(_HELD))
    ticked = F.transform(
        held, lambda m: F.struct(F.regexp_extract(m, _HELD, 1).alias("name"), F.lit(True).alias("ticked"), m.contains("(").alias("called"))
    )
    called = F.transform(
        F.regexp_extract_all(text, F.lit(_CALLED), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, rf"^({_NAME})", 1).alias("name"), F.lit(False).alias("ticked"), m.endswith("()").alias("called")
        ),
    )
    structured = F.filter(
        called,
        lambda r: (F.length(r["name"]) >= 4)
        & (r["name"].contains(".") | r["name"].contains("_") | r["name"].rlike("[a-z][A-Z]"))
        & (r["called"] | r["name"].contains(".")),
    )
    rows = comments.where(text.contains("`") | text.contains("(")).select(
        F.col("id").alias("comment_id"), "path", "raw_text", "intent", F.explode(F.array_distinct(F.concat(ticked, structured))).alias("r")
    )
    return rows.select("comment_id", "path", "intent", "r.*", _byte(F.col("raw_text"), F.col("r.name")).alias("start")).where(
        # A bare name in a contract is most often a parameter or a value.
        ~((F.col("intent") == "doc_contract") & F.col("ticked") & ~F.col("called") & ~F.col("name").contains("."))
    )


def symbols(comments: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """name: qualified and leaf names of bound symbols and definitions, each once."""
    names = comments.where(F.col("bound_symbol").isNotNull() & (F.col("bound_symbol") != MODULE)).select(F.col("bound_symbol").alias("q"))
    if definitions is not None:
        names = names.unionByName(definitions.select(F.col("symbol").alias("q")))
    return names.distinct().select(F.explode(F.array_distinct(F.array("q", F.substring_index("q", ".", -1)))).alias("name")).distinct()


def stale_references(comments: DataFrame, known: DataFrame) -> DataFrame:
    """References whose name and leaf are no symbol: two anti-joins on equality."""
    found = references(comments).where(F.col("intent") != "log_level_reference")
    found = found.withColumn("leaf", F.substring_index("name", ".", -1))
    checkable = found.where((F.length("name") >= 2) & ~F.lower("leaf").isin(*NO_SYMBOLS))
    left = checkable.join(known, "name", "left_anti")
    left = left.join(known.withColumnRenamed("name", "leaf"), "leaf", "left_anti")
    return left.select("comment_id", F.lit("rot_ref").alias("rule"), F.concat(F.lit("reference to missing "), F.col("name")).alias("message"), "start", F.octet_length("name").cast("bigint").alias("length"))


def path_tokens(comments: DataFrame) -> DataFrame:
    """comment_id, candidate: path-like words with a known extension, without `./`; absolute and parent paths are left out."""
    words = F.array_distinct(
        F.transform(F.regexp_extract_all("raw_text", F.lit(r"[A-Za-z0-9_./-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"[.,;:)]+$", ""))
    )
    likely = F.filter(words, lambda w: F.lower(F.regexp_extract(w, r"[^/.]\.([^./]+)$", 1)).isin(*PATH_EXTENSIONS))
    rows = comments.where(F.col("raw_text").contains(".")).select(F.col("id").alias("comment_id"), "raw_text", "intent", F.explode(likely).alias("word"))
    bare = F.regexp_replace("word", r"^(?:\./)+", "")
    return rows.select("comment_id", "intent", "word", bare.alias("candidate"), _byte(F.col("raw_text"), F.col("word")).alias("start")).where(
        ~F.col("candidate").startswith("/") & ~F.col("candidate").rlike(r"(^|/)\.\.(/|$)")
    )


def path_suffixes(paths: DataFrame) -> DataFrame:
    """suffix: every path and every tail of it that begins behind a slash; a suffix test becomes an equality."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return paths.where(F.col("path").isNotNull()).select(F.explode(tails).alias("candidate")).distinct()


def missing_paths(comments: DataFrame, paths: DataFrame) -> DataFrame:
    found = path_tokens(comments).where(F.col("intent") != "log_level_reference")
    left = found.join(path_suffixes(paths), "candidate", "left_anti")
    return left.select("comment_id", F.lit("rot_path").alias("rule"), F.concat(F.lit("no such file: "), F.col("candidate")).alias("message"), "start", F.octet_length("word").cast("bigint").alias("length"))


def latest_in_lines(rows: DataFrame, blame: DataFrame, span: str, key: str = "id") -> DataFrame:
    """key, commit: the latest commit among each row's lines (of equal times that of the lower line).

    Rows are exploded to whole blocks of lines, of which blame holds the latest commit, and to the lines at both ends, so
    that the join is an equality, and a range of many lines costs a few rows.
    """
    first, last = F.col(f"{span}.start_line"), F.greatest(f"{span}.start_line", f"{span}.end_line")
    block, none = F.lit(BLOCK_LINES), F.array().cast("array<struct<whole:boolean,n:int>>")
    # Blocks from `low` up to but not with `high` lie within the range.
    low, high = F.ceil(first / block).cast("int"), F.floor((last + 1) / block).cast("int")
    single = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda n: F.struct(F.lit(False).alias("whole"), n.cast("int").alias("n")))).otherwise(none)
    blocks = F.transform(F.sequence(low, high - 1), lambda n: F.struct(F.lit(True).alias("whole"), n.cast("int").alias("n")))
    parts = F.when(low < high, F.concat(blocks, single(first, low * block - 1), single(high * block, last))).otherwise(single(first, last))
    asked = rows.where(first.isNotNull()).select(key, "path", F.explode(parts).alias("at")).select(key, "path", "at.*")
    commit = F.struct("committed_unix", (-F.col("line")).alias("line"), "author", "email", "commit_id")
    lines = blame.select("path", F.lit(False).alias("whole"), F.col("line").cast("int").alias("n"), commit.alias("c"))
    whole = blame.groupBy("path", F.floor(F.col("line") / block).cast("int").alias("n")).agg(F.max(commit).alias("c"))
    known = lines.unionByName(whole.withColumn("whole", F.lit(True)))
    latest = asked.join(known, ["path", "whole", "n"]).groupBy(key).agg(F.max("c").alias("c"))
    return latest.select(key, F.struct("c.author", "c.email", "c.commit_id", "c.committed_unix").alias("commit"))


def enrich(comments: DataFrame, blame: DataFrame) -> DataFrame:
    """comments with git: the latest commit of their lines; null for files without history."""
    found = latest_in_lines(comments, blame, "span")
    return comments.drop("git").join(found.withColumnRenamed("commit", "git"), "id", "left")


def drift(comments: DataFrame, blame: DataFrame, days: int = DRIFT_DAYS) -> DataFrame:
    """Comments whose code changed more than `days` after them."""
    code = latest_in_lines(comments, blame, "bound_node_range").select("id", F.col("commit.committed_unix").alias("code_unix"))
    skew = F.col("code_unix") - F.col("git.committed_unix")
    late = comments.join(code, "id").where(skew > days * 86400)
    message = F.concat(F.lit("code changed "), F.expr("(code_unix - git.committed_unix) div 86400").cast("string"), F.lit(" days after the comment"))
    return late.select(F.col("id").alias("comment_id"), F.lit("rot_drift").alias("rule"), message.alias("message"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("length"))


def flagged(comments: DataFrame, blame: DataFrame) -> DataFrame:
    """comments with is_rot_candidate: whether their code has a later commit than they have; false without history."""
    code = latest_in_lines(comments, blame, "bound_node_range").select("id", F.col("commit.committed_unix").alias("_code"))
    late = is_rot_candidate(F.col("git.committed_unix"), F.col("_code"))
    return comments.drop("is_rot_candidate").join(code, "id", "left").withColumn("is_rot_candidate", late).drop("_code")


def is_rot_candidate(comment_unix: Column, code_unix: Column) -> Column:
    return F.coalesce(comment_unix < code_unix, F.lit(False))


_JSDOC = re.compile(r"@(param|arg|argument)\s+(?:\{[^}]*\}\s*)?\[?([\w$]+)|@(returns?)\b|@(throws|exception)\s+(?:\{([^}]*)\}|([\w.]+))")
_REST = re.compile(r":param\s+(?:[\w\[\], ]+\s)?(\w+)\s*:|:(returns?)\s*:|:raises?\s+([\w.]+)\s*:")
_HEADER = re.compile(r"(Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws)\s*:\s*$")
_ITEM = re.compile(r"\*{0,2}(\w[\w.]*)\s*(?:\([^)]*\))?\s*:")


def doc_contract(text: str) -> tuple[list[str], bool, list[str]]:
    """Parameters, whether a return value is documented, and exceptions, that a documentation comment claims."""
    params: list[str] = []
    raises: list[str] = []
    returns = False
    section, depth, item_depth = "", 0, -1
    body = re.sub(r"^\s*[rRuUbB]*(?:\"\"\"|''')|(?:\"\"\"|''')\s*$", "", text)
    for raw in body.split("\n"):
        line = re.sub(r"^(\s*)(?:/\*\*?|\*+/?|#+|//+)", r"\1", raw.rstrip())
        stripped = line.strip().removesuffix("*/").strip()
        indent = len(line) - len(line.lstrip())
        for m in _JSDOC.finditer(stripped):
            if m[2]:
                params.append(m[2])
            returns |= bool(m[3])
            if m[4]:
                raises.append((m[5] or m[6]).strip())
        for m in _REST.finditer(stripped):
            if m[1]:
                params.append(m[1])
            returns |= bool(m[2])
            if m[3]:
                raises.append(m[3])
        if header := _HEADER.match(stripped):
            section, depth, item_depth = header[1].lower(), indent, -1
            returns |= section.startswith(("return", "yield"))
        elif stripped and section:
            if indent <= depth:
                section = ""
            elif item_depth in (-1, indent) and (item := _ITEM.match(stripped)):
                item_depth = indent
                if section in ("args", "arguments", "parameters", "params"):
                    params.append(item[1])
                elif section in ("raises", "throws"):
                    raises.append(item[1])
    return list(dict.fromkeys(params)), returns, list(dict.fromkeys(raises))


def contracts(comments: DataFrame) -> DataFrame:
    """comment_id, path, symbol, params, has_return, raises: what documentation comments claim."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [doc_contract(t) for t in batch["raw_text"]]
            yield pd.DataFrame(
                {"comment_id": batch["id"], "path": batch["path"], "symbol": batch["bound_symbol"], "params": [x[0] for x in found], "has_return": [x[1] for x in found], "raises": [x[2] for x in found]}
            )

    rows = comments.where((F.col("intent") == "doc_contract") & F.col("raw_text").isNotNull()).select("id", "path", "bound_symbol", "raw_text")
    return rows.mapInPandas(run, "comment_id BIGINT, path STRING, symbol STRING, params ARRAY<STRING>, has_return BOOLEAN, raises ARRAY<STRING>")


def signature_findings(claims: DataFrame, signatures: DataFrame) -> DataFrame:
    """Claims that the signature (path, symbol, params, has_return, raises) of the same symbol doesn't hold.

    One row for each documented parameter that is not there, for a documented return of a function that returns
    nothing, and for each documented exception of a function that raises none.
    """
    s = signatures.select("path", "symbol", F.col("params").alias("s_params"), F.col("has_return").alias("s_return"), F.col("raises").alias("s_raises"))
    both = claims.join(s, ["path", "symbol"])
    absent = F.transform(F.array_except("params", "s_params"), lambda p: F.concat(F.lit("documents absent parameter "), p))
    no_return = F.when(F.col("has_return") & ~F.col("s_return"), F.array(F.lit("documents a return value, returns none"))).otherwise(F.array().cast("array<string>"))
    no_raise = F.when(F.size("s_raises") == 0, F.transform("raises", lambda r: F.concat(F.lit("documents "), r, F.lit(", raises nothing")))).otherwise(F.array().cast("array<string>"))
    return both.select("comment_id", F.lit("rot_signature").alias("rule"), F.explode(F.concat(absent, no_return, no_raise)).alias("message"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("length"))


def misaligned(comments: DataFrame, vectors: DataFrame, structural: DataFrame, least: int = LEAST_MEANING) -> DataFrame:
    """Comments without structural findings whose meaning (vector `text_vector`) is far from their code's (`code_vector`)."""
    open_ = comments.where(F.col("intent").isin("doc_contract", "explanatory_note")).join(
        structural.select(F.col("comment_id").alias("id")), "id", "left_anti"
    )
    score = F.round(F.lit(100) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("text_vector"), F.col("code_vector"), strict=True)))).cast("int")
    scored = open_.join(vectors, "id").withColumn("score", score).where(F.col("score") < least)
    return scored.select(F.col("id").alias("comment_id"), F.lit("rot_semantic").alias("rule"), F.concat(F.lit("meaning score "), F.col("score").cast("string")).alias("message"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("length"))


def detect(
    comments: DataFrame,
    paths: DataFrame,
    known: DataFrame,
    blame: DataFrame | None = None,
    signatures: DataFrame | None = None,
    vectors: DataFrame | None = None,
    off: Collection[str] = (),
) -> DataFrame:
    """comment_id, rule, message, start, length of all detectors that have their inputs and aren't switched off.

    off: names among DETECTORS.
    """
    c = with_intent(comments)
    parts = {
        "references": lambda: stale_references(c, known),
        "paths": lambda: missing_paths(c, paths),
        "drift": lambda: drift(c, blame) if blame is not None else None,
        "signatures": lambda: signature_findings(contracts(c), signatures) if signatures is not None else None,
    }
    made = [part for name, make in parts.items() if name not in off and (part := make()) is not None]
    none = "comment_id BIGINT, rule STRING, message STRING, start BIGINT, length BIGINT"
    out = reduce(DataFrame.unionByName, made) if made else comments.sparkSession.createDataFrame([], none)
    return out.unionByName(misaligned(c, vectors, out)) if vectors is not None and "meaning" not in off else out


def as_findings(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Native findings of detector rows: their target is the comment's text, their place the piece or the comment."""
    pairs = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    category = F.when(F.col("rule").startswith("marker:"), "marker_stale").otherwise(F.try_element_at(pairs, F.col("rule")))
    anchor = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_SEVERITY.items() for x in kv]), category)
    anchor = F.coalesce("severity", anchor) if "severity" in rows.columns else anchor
    c = comments.select(F.col("id").alias("comment_id"), F.col("path").alias("file_path"), F.col("content_hash").alias("target_hash"), F.col("bound_symbol").alias("target_symbol"), F.col("span").alias("c_span"))
    span = F.when(F.col("start").isNull(), F.col("c_span")).otherwise(sub_span(F.col("c_span"), F.col("start"), F.col("length")))
    return rows.join(c, "comment_id").select(
        F.xxhash64("comment_id", "rule", "message", "start").alias("finding_id"), "comment_id", "file_path", "target_hash", "target_symbol", span.alias("span"),
        F.lit(NATIVE).alias("origin"), F.concat(F.lit(f"{NATIVE}:"), F.col("rule")).alias("provider_rule_id"), F.col("rule").alias("canonical_rule_id"),
        category.alias("category"), anchor.alias("severity"), (F.array_position(F.array(*map(F.lit, SEVERITIES)), anchor) - 1).cast("int").alias("severity_rank"),
        F.lit(None).cast("string").alias("severity_native"), "message", F.lit("agent_only").alias("fix"), F.lit(None).cast("string").alias("url"), F.array().cast("array<string>").alias("also_from"),
    )
