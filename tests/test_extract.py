from pyspark.sql import functions as F

from marginalia.operators import edit, extract
from marginalia.operators.classify import intent, kind, markers
from marginalia.operators.parse import parse

PY = '"""Module docstring."""\nimport os\n\n# a leading note\ndef parse(data):\n    """Parse the data."""\n    # inline TODO: validate\n    return data\n\nclass Cache:\n    # cache size note\n    size = 100\n'
JS = "// top-level note\nfunction add(a, b) {\n  // adds two numbers\n  return a + b;\n}\n\n/* block comment\n   spanning lines */\nconst x = 1;\n"
TS = "/** JSDoc for greet. */\nexport function greet(name: string): string {\n  // build the greeting\n  return `hi ${name}`;\n}\n"
SH = "#!/bin/sh\n# configure the run\nset -e\n\n# greet the user\necho hello\n"


def extracted(spark, *rows):
    df = extract.comments(spark.createDataFrame(list(rows), "path string, language string, text string"))
    return [(r.kind, r.bound_symbol, r.span.start_line, r.span.end_line) for r in df.orderBy("path", "span.start_byte").collect()]


def test_golden(spark):
    assert extracted(spark, ("a.py", "python", PY)) == [("docstring", "<module>", 1, 1), ("line", "parse", 4, 4), ("docstring", "parse", 6, 6), ("line", "parse", 7, 7), ("line", "Cache", 11, 11)]
    assert extracted(spark, ("a.js", "javascript", JS)) == [("line", "add", 1, 1), ("line", "add", 3, 3), ("block", "x", 7, 8)]
    assert extracted(spark, ("a.ts", "typescript", TS)) == [("docstring", "greet", 1, 1), ("line", "greet", 3, 3)]
    assert extracted(spark, ("a.sh", "shell", SH)) == [("shebang", "<module>", 1, 1), ("line", "<module>", 2, 2), ("line", "<module>", 5, 5)]


def test_coalesce(spark):
    assert extracted(spark, ("a.py", "python", "# a\n# b\n# c\n")) == [("block", "<module>", 1, 3)]
    assert len(extracted(spark, ("a.py", "python", "# a\n\n# b\n"))) == 2
    assert len(extracted(spark, ("a.py", "python", "x = 1  # trailing\n# lead\n"))) == 2
    assert [k for k, *_ in extracted(spark, ("a.py", "python", "# a\n# noqa: E501\n# b\n"))] == ["line", "directive", "line"]
    assert extracted(spark, ("a.py", "python", None), ("b.py", None, "# x"), ("c.py", "python", "")) == []


def test_strings_are_no_comments():
    assert parse('x = "# not a comment"\ny = \'// also not\'\n', "python")[0] == []
    assert parse('const s = "// not a comment"; const t = `# ${"//"} nope`;', "javascript")[0] == []
    assert parse("echo '# no' \"# no\" ${x#y} $#\ncat <<E\n# no\nE\n", "shell")[0] == []
    assert [p.start for p in parse("# a\r\n# b\r\n", "python")[0]] == [0, 5]


def test_signatures():
    _, nodes = parse("class A:\n    def f(self, a, *b, c=1, **d) -> int:\n        raise ValueError()\n\n    def g(self):\n        def h():\n            return 1\n", "python")
    by = {n.symbol: n for n in nodes}
    assert by["A"].params is None and by["A.f"].params == ("a", "b", "c", "d") and by["A.f"].raises == ("ValueError",) and by["A.f"].has_return
    assert not by["A.g"].has_return and by["A.g.h"].has_return
    _, nodes = parse("export class B {\n  async run(x: number): void {\n    if (x) { throw new RangeError('x'); }\n  }\n}\nconst f = (a, b) => {\n  return a;\n};\n", "typescript")
    assert [(n.symbol, n.params) for n in nodes] == [("B", None), ("B.run", ("x",)), ("f", ("a", "b"))]


def test_kinds(spark):
    cases = [
        ("shell", "#!/bin/bash", 1, "shebang"), ("shell", "#! not really", 5, "line"), ("python", "# -*- coding: utf-8 -*-", 1, "encoding-decl"), ("python", "# coding: utf-8", 9, "line"),
        ("python", "# noqa: E501", 3, "directive"), ("typescript", "// @ts-expect-error legacy", 3, "directive"), ("typescript", "/** doc */", 3, "docstring"), ("javascript", "/* plain block */", 3, "block"),
        ("python", "# regular", 3, "line"), ("javascript", "// SPDX-License-Identifier: MIT", 1, "license"), ("python", "# discusses copyright law", 40, "line"),
    ]
    df = spark.createDataFrame(cases, "language string, raw string, line int, expected string")
    assert df.where(kind(F.col("raw"), F.col("language"), F.col("line"), F.lit(False)) != F.col("expected")).count() == 0


def test_markers(spark):
    cases = {
        "// log at WARNING level when the queue is full": [], "// see the TODO in the parser above": [], "# AUTOTODO marker": [], "# TODOS list": [], "# a todo in prose": [],
        "# WARNING: this mutates global state": ["WARNING"], "// NOTE(team): x": ["NOTE"], "/*\n * TODO: refactor this\n * the WARNING path is fine\n */": ["TODO"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.m for r in df.select("x", markers(F.col("x")).alias("m")).collect()} == cases
    assert spark.createDataFrame([("// DO_NOT_MERGE before review",)], "x string").select(markers(F.col("x"), ("SECURITY", "DO_NOT_MERGE"))).first()[0] == ["DO_NOT_MERGE"]


def test_intent(spark):
    rows = [("Args:\n  x", "line", [], "f", "doc_contract"), ("# x", "line", ["TODO"], None, "directive"), ("# emits a warning to the log", "line", [], None, "log_level_reference"), ("# why", "line", [], None, "explanatory_note")]
    df = spark.createDataFrame(rows, "raw string, kind string, m array<string>, s string, expected string")
    assert df.where(intent(F.col("raw"), F.col("kind"), F.col("m"), F.col("s")) != F.col("expected")).count() == 0


def test_strip():
    text = "# a leading note\nx = 1  # a trailing note\n\n\ndef f():\n    # inside\n    return x\n"
    spans = [(p.start, p.end) for p in parse(text, "python")[0]]
    assert edit.strip_text(text, "python", spans) == ("x = 1\n\n\ndef f():\n    return x\n", 3, 0, [1, 2, 6])
    only = 'def f(a):\n    """Doc."""\n'
    assert edit.strip_text(only, "python", [(14, 24)])[:3] == (only, 0, 1)


def test_edits_keep_the_code(spark):
    files = spark.createDataFrame([("a.py", "python", "# x\ny = 1\n")], "path string, language string, text string")
    span = F.struct(F.lit(0).alias("start_byte"), F.lit(3).alias("end_byte"))
    good = edit.apply_edits(files, files.select("path", span.alias("span"), F.lit("# ünew").alias("new_text"))).first()
    bad = edit.apply_edits(files, files.select("path", span.alias("span"), F.lit("# x\nz = 2").alias("new_text"))).first()
    assert good.ok and good.new_text == "# ünew\ny = 1\n" and not bad.ok and bad.new_text == "# x\ny = 1\n"
