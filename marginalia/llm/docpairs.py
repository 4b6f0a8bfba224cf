"""Functions paired with their documentation.

Each file is parsed in its task: Python into its abstract syntax tree, TypeScript, JavaScript and shell into a tree of
blocks (classes, functions, strings and comments told apart). Function nodes are visited, the attached documentation
is taken with exact character ranges, and documentation that says nothing is dropped. Pairs are then matched with the
`comments` table by path and hash of the documentation, an equi-join on both, so no file's text is shuffled.

Defined results: files with null or empty text give nothing; a Python file that can't be parsed is read by its lines
(definitions and the string below them); of a path that was walked twice the pairs come out once; columns other than
those named are ignored; empty tables give empty results.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = (
    "path STRING, language STRING, symbol STRING, documentation STRING, content_hash STRING, "
    "doc_start INT, doc_end INT, code_start INT, code_end INT"
)

# Extensions and names of languages.
LANGUAGE_OF = {
    "py": "python", "pyi": "python", "python": "python",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "typescript": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "javascript": "javascript",
    "sh": "shell", "bash": "shell", "shell": "shell",
}

# Documentation that only holds a place or points at the code.
NOTHING = {
    "docstring", "description", "description goes here", "documentation", "documentation pending", "documentation goes here",
    "fill me in", "to be written", "to be done", "to be documented", "to do", "coming soon", "placeholder", "pending",
    "see code", "see the code", "see above", "see below", "see source", "see implementation", "read the code", "self explanatory",
    "self documenting", "obvious", "not documented", "undocumented", "no description", "no documentation", "missing", "add docs",
    "add description", "insert description here", "write me", "document me", "lorem ipsum", "none", "n a", "na", "tbd", "tba", "wip", "xxx",
    "todo", "fixme", "a faire", "à faire", "à documenter", "voir le code", "à compléter", "siehe code", "noch zu schreiben", "zu tun",
    "folgt", "kommt noch", "por hacer", "pendiente", "ver código", "ver el código", "por documentar", "por escribir",
}
_MARK = re.compile(r"(?:todo|fixme|tbd|tba|wip|xxx|hack)\b\W*(?:\w+\W*){0,2}$")
_FILLER = {"function", "method", "func", "the", "a", "an", "this", "for", "of", "to", "def", "fn"}
_SECTION = re.compile(
    r"(?:args|arguments|parameters|params|returns?|yields?|raises|throws|examples?|notes?|keyword args|attributes)\s*:$", re.I
)
_TAG = re.compile(
    r"""(?:
      @(?:param|arg|argument|property|prop|throws|exception|template)\b\s*(?:\{[^}]*\})?\s*(?:\[[^\]]*\]|[\w.$]+)?
    | @(?:returns?|yields?|type|async|private|public|static|readonly|override)\b\s*(?:\{[^}]*\})?
    | :(?:param|arg|argument|key|keyword|type|raises?|except|exception)\b[^:]*:
    | :(?:returns?|rtype|yields?)\s*:
    )\s*[-:]?""",
    re.X,
)
_ITEM = re.compile(r"[*\w.$]+\s*(?:\([^)]*\))?\s*(?::|-|--)?\s*")
_WORDS = re.compile(r"[^\W\d_]+")


def name_words(name: str) -> set[str]:
    """The words of an identifier in camelCase, PascalCase or snake_case."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+", name)}


def doc_body(raw: str) -> list[str]:
    """The lines of a documentation comment without its marks."""
    text = re.sub(r"^\s*(?:[rRuUbBfF]{0,2}(?:\"\"\"|'''|\"|')|/\*+)", "", raw)
    text = re.sub(r"(?:\"\"\"|'''|\"|'|\*+/)\s*$", "", text)
    return [re.sub(r"^\s*(?:#+|\*+|//+)?[ \t]*", "", line).rstrip() for line in re.split(r"\r\n|\r|\n", text)]


def says_something(raw: str, name: str) -> bool:
    """Whether documentation tells more than the function's own name and the names of its parameters."""
    said: list[str] = []
    in_section = False
    for line in doc_body(raw):
        text = line.strip()
        if not text:
            continue
        if _SECTION.fullmatch(text):
            in_section = True
        elif tag := _TAG.match(text):
            said.append(text[tag.end() :])
        elif in_section:
            item = _ITEM.match(text)
            said.append(text[item.end() :] if item else text)
        else:
            said.append(text)
    text = " ".join(said).strip()
    words = [w.lower() for w in _WORDS.findall(text)]
    if not words:
        return False
    plain = re.sub(r"[\W_]+", " ", text.lower()).strip()
    if plain in NOTHING or _MARK.match(plain):
        return False
    names = name_words(name)
    forms = names | _FILLER | {n + e for n in names for e in ("s", "es", "d", "ed", "ing")}
    forms |= {n[:-1] + e for n in names if n[-1] in "ey" for e in ("ing", "ies", "ied")}
    return not set(words) <= forms


class Found(NamedTuple):
    symbol: str
    doc_start: int
    doc_end: int
    code_start: int
    code_end: int


def python_functions(text: str) -> Iterator[Found]:
    """Functions and methods with a docstring, from the syntax tree."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", data))]
    plain = len(data) == len(text)

    def at(line: int, column: int) -> int:
        byte = starts[line - 1] + column
        return byte if plain else len(data[:byte].decode("utf-8", "replace"))

    stack: list[tuple[ast.AST, str]] = [(ast.parse(text), "")]
    while stack:
        node, scope = stack.pop()
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):
            for child in getattr(node, field, ()) or ():
                if isinstance(child, ast.ClassDef):
                    stack.append((child, child.name))
                elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                    stack.append((child, ""))
                    first = child.body[0]
                    if isinstance(first, ast.Expr) and isinstance(v := first.value, ast.Constant) and isinstance(v.value, str):
                        yield Found(
                            f"{scope}.{child.name}" if scope else child.name,
                            at(v.lineno, v.col_offset), at(v.end_lineno, v.end_col_offset),
                            at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset),
                        )
                elif isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case):
                    stack.append((child, scope))


_PY_LINES = re.compile(
    r"^(?P<indent>[ \t]*)(?:(?P<kind>class)\s+(?P<class>\w+)|(?:async\s+)?def\s+(?P<name>\w+)\s*\([^#]*?\)\s*(?:->[^:\n]+)?:[ \t]*(?:#[^\n]*)?\r?\n"
    r"\s*(?P<doc>(?:[rRuU]?)(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"[^\"\n]*\"|'[^'\n]*')))",
    re.M,
)


def python_lines(text: str) -> Iterator[Found]:
    """As python_functions, by lines: for text that can't be parsed."""
    classes: list[tuple[int, str]] = []
    for m in _PY_LINES.finditer(text):
        indent = len(m["indent"].expandtabs())
        while classes and classes[-1][0] >= indent:
            classes.pop()
        if m["kind"]:
            classes.append((indent, m["class"]))
        else:
            symbol = f"{classes[-1][1]}.{m['name']}" if classes else m["name"]
            yield Found(symbol, m.start("doc"), m.end("doc"), m.start() + len(m["indent"]), m.end())


_JS = re.compile(
    r"""(?P<doc>/\*\*(?!/).*?\*/) | (?P<skip>/\*.*?\*/ | //[^\n]* | "(?:\\.|[^"\\\n])*" | '(?:\\.|[^'\\\n])*' | `(?:\\.|[^`\\])*`
      | (?<=[=(,:;!&|?{}\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)
      | \bclass\s+(?P<class>[\w$]+)[^{};()]*\{ | (?P<open>\{) | (?P<close>\})""",
    re.X | re.S,
)
_JS_FUNCTION = re.compile(
    r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>(]*>)?\s*\("
)
_JS_CONST = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+?)?=\s*(?P<value>(?:async\s+)?)")
_JS_METHOD = re.compile(
    r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^>(]*>)?\s*\("
)
_JS_VALUE = re.compile(r"(?:async\s+)?(?:function\b|[\w$]+\s*=>|(?:<[^>(]*>)?\()")
_JS_GAP = re.compile(r"[ \t]*\r?\n[ \t]*")
_JS_ARROW = re.compile(r"\s*(?::[^={};]+)?=>")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "super", "with"}


def _closed(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"""[()]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""").finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return len(text)


def script_definition(text: str, at: int, owner: str) -> str | None:
    """The symbol that is defined at `at`; owner: the class whose body this is, or ''."""
    if owner:
        if (m := _JS_METHOD.match(text, at)) and m["name"] not in _KEYWORDS:
            return f"{owner}.{m['name'].lstrip('#')}"
        return None
    if m := _JS_FUNCTION.match(text, at):
        return m["name"]
    if (m := _JS_CONST.match(text, at)) and (v := _JS_VALUE.match(text, m.start("value"))):
        if v[0].endswith("(") and not _JS_ARROW.match(text, _closed(text, v.end() - 1)):
            return None
        return m["name"]
    return None


def script_functions(text: str) -> Iterator[Found]:
    """Functions and methods of TypeScript or JavaScript with a documentation comment on the lines before them."""
    blocks: list[tuple[str, int]] = []  # open blocks: the class they are the body of, and their number among the brackets
    starts: list[int] = []  # of all brackets, and where what they open or close ends
    ends: list[int] = []
    found: list[tuple[str, int, int, int]] = []
    for m in _JS.finditer(text):
        if m["class"] is not None or m["open"]:
            blocks.append((m["class"] or "", len(starts)))
            starts.append(m.start())
            ends.append(len(text))
        elif m["close"]:
            starts.append(m.start())
            ends.append(m.end())
            if blocks:
                ends[blocks.pop()[1]] = m.end()
        elif m["doc"]:
            gap = _JS_GAP.match(text, m.end())
            owner = blocks[-1][0] if blocks else ""
            if gap and (symbol := script_definition(text, gap.end(), owner)):
                found.append((symbol, m.start(), m.end(), gap.end()))
    for symbol, doc_start, doc_end, start in found:
        # The code ends with the first block that begins behind the documentation, or the one around it.
        i = bisect.bisect_left(starts, start)
        yield Found(symbol, doc_start, doc_end, start, ends[i] if i < len(ends) else len(text))


_SH_DEFINITION = re.compile(r"[ \t]*(?:function[ \t]+(?P<a>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<b>[\w:.-]+)[ \t]*\([ \t]*\))[ \t]*(?:[{(]|$)")
_HEREDOC = re.compile(r"<<-?\s*(['\"]?)(\w+)\1")
_SH_DIRECTIVE = re.compile(r"\s*#\s*shellcheck\b")


def shell_functions(text: str) -> Iterator[Found]:
    """Functions of a shell script with comment lines right above them."""
    lines = [(m.start(), m[0].rstrip("\r\n")) for m in re.finditer(r"[^\n]*\n|[^\n]+$", text)]
    until = ""
    run: list[int] = []
    for i, (start, line) in enumerate(lines):
        stripped = line.strip()
        if until:
            until = "" if stripped == until else until
            run = []
            continue
        if stripped.startswith("#") and not (i == 0 and stripped.startswith("#!")):
            run.append(i)
            continue
        if run and (m := _SH_DEFINITION.match(line)):
            end = next((b + len(x) for b, x in lines[i:] if x.strip() in ("}", ")")), start + len(line))
            for part in _parts(lines, run):
                first, last = part[0], part[-1]
                doc_start = lines[first][0] + len(lines[first][1]) - len(lines[first][1].lstrip())
                doc_end = lines[last][0] + len(lines[last][1].rstrip())
                yield Found(m["a"] or m["b"], doc_start, doc_end, start, end)
        if (h := _HEREDOC.search(line)) and "<<<" not in line:
            until = h[2]
        run = []


def _parts(lines: list[tuple[int, str]], run: list[int]) -> list[list[int]]:
    """The comment lines as a whole; where directives of a linter stand among them, the piece nearest to the function."""
    if not any(_SH_DIRECTIVE.match(lines[i][1]) for i in run):
        return [run]
    pieces: list[list[int]] = [[]]
    for i in run:
        if _SH_DIRECTIVE.match(lines[i][1]):
            pieces.append([])
        else:
            pieces[-1].append(i)
    return [p for p in pieces if p][-1:]


def functions_of(text: str, language: str) -> list[Found]:
    """All documented functions of a file."""
    if language == "python":
        try:
            return list(python_functions(text))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return list(python_lines(text))
    if language == "shell":
        return list(shell_functions(text))
    return list(script_functions(text)) if language in ("typescript", "javascript") else []


def language_column(path: Column, language: Column) -> Column:
    """python, typescript, javascript, shell or null: by extension, else by the language's name."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(pairs, extension), F.try_element_at(pairs, F.lower(language)))


def function_docs(files: DataFrame) -> DataFrame:
    """Every function with documentation that says something, with exact ranges in characters: PAIRS."""
    known = files.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select(
        "path", language_column(F.col("path"), F.col("language")).alias("language"), "text"
    )
    # Only texts in which a documentation comment can stand reach Python.
    shaped = (
        (F.col("language") == "python") & F.col("text").rlike("[\"']")
        | F.col("language").isin("typescript", "javascript") & F.col("text").contains("/**")
        | (F.col("language") == "shell") & F.col("text").contains("#")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text in zip(batch["path"], batch["language"], batch["text"], strict=True):
                for f in functions_of(text, language):
                    raw = text[f.doc_start : f.doc_end]
                    if says_something(raw, f.symbol.rpartition(".")[2]):
                        digest = hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append((path, language, f.symbol, raw, digest, f.doc_start, f.doc_end, f.code_start, f.code_end))
            columns = [c.split()[0] for c in PAIRS.split(", ")]
            yield pd.DataFrame(rows, columns=columns)

    return known.where(shaped).mapInPandas(run, PAIRS)


def documented(files: DataFrame, comments: DataFrame) -> DataFrame:
    """path, symbol, content_hash of the functions whose documentation is a row of `comments` of the same path."""
    pairs = function_docs(files).select("path", "symbol", "content_hash").distinct()
    known = comments.select("path", "content_hash")
    return pairs.join(known, ["path", "content_hash"], "left_semi").select("path", "symbol", "content_hash")
