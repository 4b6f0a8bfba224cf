"""Kinds, markers and intents of comments, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import any_contains

# Fixed values.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE", "DEPRECATED", "WARNING", "REVIEW")
DIRECTIVES = (
    "noqa", "type: ignore", "type:ignore", "eslint-disable", "eslint-enable", "@ts-expect-error", "@ts-ignore", "@ts-nocheck",
    "shellcheck disable", "shellcheck source", "pylint:", "pyright:", "prettier-ignore",
)
LICENSE_WORDS = ("copyright", "spdx-license-identifier", "all rights reserved", "licensed under", "permission is hereby granted")
CONTRACT_MARKS = (
    "Args:", "Arguments:", "Parameters:", "Returns:", "Return:", "Yields:", "Raises:", "@param", "@returns", "@return", "@throws",
    ":param", ":returns:", ":raises:",
)
LEVELS = ("error", "warn", "warning", "info", "debug", "trace", "critical", "fatal", "notice")
LOG_WORDS = ("log", "logs", "logged", "logging", "logger", "emit", "emits", "level")
#: The word of this engine's own directives, as in `marginalia:disable-line=D417`.
DIRECTIVE_WORD = "marginalia"
FURNITURE = r"#/*<>!\-;%\"'"


def inner_text(raw: Column) -> Column:
    """A comment without its marks."""
    text = F.trim(raw)
    return F.trim(
        F.when(text.startswith("/**"), F.regexp_replace(F.regexp_replace(text, r"^/\*\*", ""), r"\*/$", ""))
        .when(text.startswith("/*"), F.regexp_replace(F.regexp_replace(text, r"^/\*", ""), r"\*/$", ""))
        .when(text.startswith("//"), F.regexp_replace(text, "^//", ""))
        .when(text.startswith("#"), F.regexp_replace(text, "^#", ""))
        .otherwise(text)
    )


def kind(raw: Column, language: Column, start_line: Column, is_docstring: Column) -> Column:
    """The kind of a comment: the first rule that holds."""
    words = "|".join(map(re.escape, (f"{DIRECTIVE_WORD}:", *DIRECTIVES)))
    # One pattern for mark, blanks and word: the text behind the mark begins with a directive.
    is_directive = raw.rlike(rf"^ *(?:/\*\*|/\*|//|#)? *(?:{words})")
    is_license = any_contains(F.lower(raw), LICENSE_WORDS)
    return (
        F.when(is_docstring, "docstring")
        .when((start_line == 1) & raw.startswith("#!"), "shebang")
        .when((language == "python") & (start_line <= 2) & raw.rlike(r"coding[:=]\s*[-\w.]+"), "encoding-decl")
        .when(is_directive, "directive")
        .when(language.isin("typescript", "javascript") & raw.startswith("/**"), "docstring")
        .when((start_line <= 15) & is_license, "license")
        .when(raw.startswith("/*") | raw.contains("\n"), "block")
        .otherwise("line")
    )


def _marker_pattern(words: Sequence[str]) -> str:
    longest_first = sorted(set(words), key=lambda w: (-len(w), w))
    return rf"(?m)^[\s{FURNITURE}]*({'|'.join(map(re.escape, longest_first))})(?:[^\p{{L}}\p{{N}}_]|$)"


def markers(raw: Column, custom: Sequence[str] = ()) -> Column:
    """The markers that lead a line of a comment, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit(_marker_pattern([*MARKERS, *custom])), F.lit(1))))


def leads_with_marker(raw: Column) -> Column:
    return raw.rlike(_marker_pattern(MARKERS))


def intent(raw: Column, kind: Column, markers: Column, bound_symbol: Column) -> Column:
    """doc_contract, directive, log_level_reference or explanatory_note: the first that holds."""
    words = F.split(F.lower(raw), r"[^\p{L}\p{N}]+")
    return (
        F.when(bound_symbol.isNotNull() & ((kind == "docstring") | any_contains(raw, CONTRACT_MARKS)), "doc_contract")
        .when((F.coalesce(F.size(markers), F.lit(0)) > 0) | leads_with_marker(raw), "directive")
        .when(
            F.arrays_overlap(words, F.array(*map(F.lit, LEVELS))) & F.arrays_overlap(words, F.array(*map(F.lit, LOG_WORDS))),
            "log_level_reference",
        )
        .otherwise("explanatory_note")
    )
