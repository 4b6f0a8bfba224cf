"""Comments and definitions of source files: Python by its syntax tree, TypeScript, JavaScript and shell by lexers.

Used inside tasks, file by file; everything downstream is relational. Places are characters here and become UTF-8
bytes in `extract`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

from marginalia.schema import MODULE


class Piece(NamedTuple):
    """A comment: its place, and whether it is documentation."""

    start: int
    end: int
    doc: bool


class Node(NamedTuple):
    """A definition: its qualified name, place, and signature (None for classes and constants)."""

    symbol: str
    start: int
    end: int
    params: tuple[str, ...] | None
    has_return: bool
    raises: tuple[str, ...]


_PY = re.compile(
    r"""(?P<string>(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')) | (?P<comment>\#[^\r\n]*)""", re.X | re.S
)
_JS = re.compile(
    r"""(?P<comment>/\*.*?\*/ | //[^\r\n]*) | (?P<skip>"(?:\\.|[^"\\\n])*" | '(?:\\.|[^'\\\n])*' | `(?:\\.|[^`\\])*`
      | (?<=[=(,:;!&|?{}\n\[])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)
      | (?P<open>\{) | (?P<close>\})""",
    re.X | re.S,
)
_JS_HEAD = re.compile(
    r"""(?:^|[;{}\n])[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?
        (?: class\s+(?P<class>[\w$]+)[^{};]*
          | (?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)\s*(?:<[^>(]*>)?\s*\((?P<p1>[^{]*)
          | (?:const|let|var)\s+(?P<const>[\w$]+)\s*(?::[^=]+?)?=\s*(?:async\s+)?(?:function\b[^({]*\((?P<p2>[^{]*)|\(?(?P<p3>[^{;]*?)\)?\s*(?::[^={]+)?=>\s*)
          | (?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<method>[\#\w$]+)\s*(?:<[^>(]*>)?\s*\((?P<p4>[^{;]*)\)\s*(?::\s*[^{;]+)?\s*
        )\Z""",
    re.X,
)
_JS_CONST = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)[^\n]*", re.M)
_JS_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "with", "else", "do", "try", "finally"}
_SH_DEFINITION = re.compile(r"^[ \t]*(?:function[ \t]+(?P<a>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<b>[\w:.-]+)[ \t]*\([ \t]*\))[ \t]*[{(]?", re.M)
_SH = re.compile(
    r"""(?P<here><<-?\s*(?P<q>['"]?)(?P<tag>\w+)(?P=q)[^\n]*\n(?:.*\n)*?[ \t]*(?P=tag)(?=\s|\Z)) | '[^']*' | "(?:\\.|[^"\\])*" | \\.
      | (?<![^\s;|&(){}])(?P<comment>\#[^\r\n]*) | \$\{[^}]*\} | \$\#""",
    re.X,
)


def _statement(tree: ast.AST) -> Iterator[tuple[ast.AST, str]]:
    """Definitions with the qualified name of what encloses them."""
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, scope = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{scope}.{child.name}" if scope else child.name
                yield child, name
                stack.append((child, name))
            elif not isinstance(child, ast.expr):
                stack.append((child, scope))


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """What a function holds, without what functions inside it hold."""
    stack = list(ast.iter_child_nodes(node))
    while stack:
        child = stack.pop()
        yield child
        if not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda | ast.ClassDef):
            stack.extend(ast.iter_child_nodes(child))


def _name(node: ast.AST | None) -> str:
    if isinstance(node, ast.Call):
        node = node.func
    return ast.unparse(node) if node is not None else ""


def _signature(node: ast.AST) -> tuple[tuple[str, ...] | None, bool, tuple[str, ...]]:
    if isinstance(node, ast.ClassDef):
        return None, False, ()
    a = node.args
    names = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
    inside = list(_own(node))
    has_return = node.returns is not None or any(
        isinstance(x, ast.Yield | ast.YieldFrom) or isinstance(x, ast.Return) and x.value is not None for x in inside
    )
    raises = [_name(x.exc) for x in inside if isinstance(x, ast.Raise) and x.exc is not None]
    return tuple(n for n in names if n not in ("self", "cls")), has_return, tuple(dict.fromkeys(raises))


def python(text: str) -> tuple[list[Piece], list[Node]]:
    data = text.encode("utf-8", "surrogatepass")
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", data))]

    def at(line: int, column: int) -> int:
        byte = starts[line - 1] + column
        return byte if len(data) == len(text) else len(data[:byte].decode("utf-8", "replace"))

    comments = [Piece(m.start(), m.end(), False) for m in _PY.finditer(text) if m["comment"]]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return comments, []
    nodes: list[Node] = []
    bodies: list[ast.AST] = [tree]
    for node, name in _statement(tree):
        bodies.append(node)
        nodes.append(Node(name, at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), *_signature(node)))
    for node in bodies:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            v = first.value
            comments.append(Piece(at(v.lineno, v.col_offset), at(v.end_lineno, v.end_col_offset), True))
    return sorted(comments), sorted(nodes, key=lambda n: (n.start, -n.end))


def _params(text: str | None) -> tuple[str, ...]:
    head = re.sub(r"\)[^()]*$", "", text or "")
    return tuple(m[1] for part in head.split(",") if (m := re.match(r"\s*(?:\.\.\.)?([\w$]+)", part)))


def script(text: str) -> tuple[list[Piece], list[Node]]:
    comments: list[Piece] = []
    blocks: list[tuple[str, int, re.Match | None]] = []
    nodes: list[Node] = []
    last = 0  # where the text since the last brace or comment begins
    for m in _JS.finditer(text):
        if m["comment"]:
            comments.append(Piece(m.start(), m.end(), m[0].startswith("/**") and m[0] != "/**/"))
        elif m["open"]:
            head = _JS_HEAD.search("\n" + text[last : m.start()])
            name = head and (head["class"] or head["function"] or head["const"] or head["method"])
            if head and head["method"] and (head["method"] in _JS_KEYWORDS or not (blocks and blocks[-1][2] and blocks[-1][2]["class"])):
                name = None
            outer = next((b[0] for b in reversed(blocks) if b[0]), "")
            symbol = (f"{outer}.{name.lstrip('#')}" if outer else name.lstrip("#")) if name else ""
            begin = m.start() - len(head[0].lstrip("\n;{} \t")) if name else m.start()
            blocks.append((symbol, begin, head if name else None))
        elif m["close"] and blocks:
            symbol, begin, head = blocks.pop()
            if head:
                body = text[begin : m.end()]
                params = None if head["class"] else _params(head["p1"] or head["p2"] or head["p3"] or head["p4"])
                thrown = tuple(dict.fromkeys(re.findall(r"\bthrow\s+(?:new\s+)?([\w.$]+)", body))) if params is not None else ()
                nodes.append(Node(symbol, begin, m.end(), params, bool(re.search(r"\breturn\s+[^;\s]|\byield\b|=>\s*[^\s{]", body)), thrown))
        if m["open"] or m["close"] or m["comment"]:
            last = m.end()
    inside = [(n.start, n.end) for n in nodes]
    for m in _JS_CONST.finditer(text):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        if not any(a <= m.start("name") < b for a, b in inside):
            nodes.append(Node(m["name"], begin, m.end(), None, False, ()))
    return comments, sorted(nodes, key=lambda n: (n.start, -n.end))


def shell(text: str) -> tuple[list[Piece], list[Node]]:
    comments = [Piece(m.start(), m.end(), False) for m in _SH.finditer(text) if m["comment"]]
    closed = [(m.start(), m.end()) for m in _SH.finditer(text)]
    nodes = []
    for m in _SH_DEFINITION.finditer(text):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        if any(a <= begin < b for a, b in closed):
            continue
        end = re.compile(r"^[ \t]*[})]", re.M).search(text, m.end())
        nodes.append(Node(m["a"] or m["b"], begin, end.end() if end else m.end(), (), True, ()))
    return comments, nodes


def parse(text: str, language: str) -> tuple[list[Piece], list[Node]]:
    """Comments and definitions of a file, both by place."""
    if language == "python":
        return python(text)
    if language == "shell":
        return shell(text)
    return script(text) if language in ("typescript", "javascript") else ([], [])


def enclosing(nodes: list[Node], place: int) -> str:
    """The qualified name of the innermost definition around a place."""
    inner = [n for n in nodes if n.start <= place < n.end]
    return max(inner, key=lambda n: n.start).symbol if inner else MODULE


def code_tokens(text: str, language: str, without: list[tuple[int, int]] = []) -> list[str]:  # noqa: B006
    """The tokens of a file that are code: comments and the given ranges left out."""
    pieces, _ = parse(text, language)
    gone = sorted([(p.start, p.end) for p in pieces if not (p.doc and language == "python")] + list(without))
    out, at = [], 0
    for a, b in [*gone, (len(text), len(text))]:
        if a > at:
            piece = text[at:a] if at or language != "python" else "\n" + text[:a]
            out += re.findall(r"\w+|[^\w\s]|\n[ \t]*(?=\S)" if language == "python" else r"\w+|[^\w\s]", piece)
        at = max(at, b)
    # Indentation matters in Python, but only where a line has code.
    return [t for i, t in enumerate(out) if not (t.startswith("\n") and (i + 1 == len(out) or out[i + 1].startswith("\n")))]
