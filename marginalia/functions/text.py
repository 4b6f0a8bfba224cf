"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF
ESLINT_CATEGORY = {
    "jsdoc/check-param-names": "doc_drift", "jsdoc/check-types": "doc_drift", "jsdoc/check-property-names": "doc_drift",
    "jsdoc/require-jsdoc": "doc_missing", "require-jsdoc": "doc_missing", "jsdoc/require-param": "doc_missing",
    "jsdoc/require-returns": "doc_missing", "jsdoc/require-description": "doc_missing", "no-warning-comments": "todo_format",
    "tsdoc/syntax": "doc_style", "jsdoc/check-alignment": "doc_style", "jsdoc/check-indentation": "doc_style",
    "jsdoc/no-multi-asterisks": "doc_style", "jsdoc/multiline-blocks": "doc_style",
}
VERBS = ("disable", "enable", "disable-line", "disable-next-line", "disable-file")


def content_hash(text: Column) -> Column:
    """SHA-256 of the exact UTF-8 bytes, as lower-case hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def lines(text: Column) -> Column:
    """Lines without their ends; a line end at the end of the text starts no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def normalize(text: Column) -> Column:
    """A comment's words: marks, quotes, case, spacing and closing punctuation removed."""

    def one(line: Column) -> Column:
        line = F.regexp_replace(F.trim(line), r"^(?:/\*\*|/\*|///|//|#)", "")
        line = F.regexp_replace(F.regexp_replace(line, r"\*/$", ""), r"^[\s\"']+|[\s\"']+$", "")
        return F.regexp_replace(line, r"^\*+\s*", "")

    joined = F.array_join(F.transform(F.split(text, r"\r?\n"), one), " ")
    flat = F.trim(F.lower(F.regexp_replace(joined, r"\s+", " ")))
    return F.trim(F.regexp_replace(flat, r"[.,;:!? ]+$", ""))


def fingerprint(text: Column) -> Column:
    """SHA-256 of `normalize`: equal for cosmetic variants of a comment."""
    return F.sha2(F.encode(normalize(text), "UTF-8"), 256)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as BIGINT."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda acc, i: (acc.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(
            F.lit(FNV_MASK)
        ),
    )


def first_line(text: Column, blank: bool = True) -> Column:
    """The first line, trimmed; blank=False: the first line that isn't blank."""
    trimmed = F.transform(lines(text), lambda x: F.trim(x))
    return F.try_element_at(trimmed if blank else F.filter(trimmed, lambda x: x != ""), F.lit(1))


def identity_token(symbol: Column, kind: Column, marker: Column) -> Column:
    return F.concat_ws("|", F.coalesce(symbol, F.lit("<none>")), kind, marker)


def rule_id(origin: Column, rule: Column) -> Column:
    return F.concat_ws(":", origin, rule)


def csv_field(value: Column) -> Column:
    """RFC 4180: quoted only where needed."""
    return F.when(value.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "error"), "error").when(severity == "warning", "warning").when(severity == "info", "note")


def native_severity(origin: Column, native: Column) -> Column:
    """The severity that a tool's own level stands for; null where the tool says nothing."""
    low = F.lower(native)
    return (
        F.when((origin == "eslint") & low.isin("2", "error"), "error")
        .when((origin == "eslint") & low.isin("1", "warn", "warning"), "warning")
        .when((origin == "shellcheck") & low.isin("error", "warning"), low)
        .when((origin == "shellcheck") & low.isin("info", "style"), "info")
        .when(origin == "gitleaks", "critical")
    )


def eslint_category(rule: Column) -> Column:
    """The category of an eslint rule; null (to be dropped) for rules that don't concern comments."""
    pairs = F.create_map(*[F.lit(x) for kv in ESLINT_CATEGORY.items() for x in kv])
    return F.try_element_at(pairs, rule)


def search_terms(query: Column) -> Column:
    """The distinct words of a keyword query; null if it has none."""
    found = F.array_distinct(tokens(query))
    return F.when(F.size(found) > 0, found)


def fix_route(fix: Column, supports_autofix: Column) -> Column:
    return F.when((fix == "provider_autofix") & ~supports_autofix, "agent_only").otherwise(fix)


def directive(text: Column, word: str) -> Column:
    """The first directive `word:verb[=target,...]` of a comment as struct<verb, targets>, else null."""
    body = F.regexp_replace(F.regexp_extract(text, rf"{word}:(\S+)", 1), r"\*/$", "")
    verb = F.substring_index(body, "=", 1)
    targets = F.filter(F.split(F.when(body.contains("="), F.regexp_replace(body, "^[^=]*=", "")).otherwise(""), ","), lambda x: x != "")
    return F.when(verb.isin(*VERBS), F.struct(verb.alias("verb"), targets.alias("targets")))


def any_contains(text: Column, pieces: Sequence[str]) -> Column:
    out = F.lit(False)
    for piece in pieces:
        out = out | text.contains(piece)
    return out
