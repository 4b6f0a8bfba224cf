import dataclasses
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from marginalia.plans import pipeline
from marginalia.sources import files, records, sinks
from marginalia.streaming import incremental

ROWS = [
    ("refs.py", "python", '# see `gone()` and `parse`\ndef parse(data):\n    """Parse.\n\n    Args:\n        data: x\n        old: y\n    """\n    pass  # TODO: x\n'),
    ("a.js", "javascript", "// marginalia:disable-next-line=rot_ref\n// calls `nothere()` now\nfunction add(a, b) {\n  return a + b;\n}\n"),
    ("s.sh", "shell", "#!/bin/sh\n# reads missing.html and ./s.sh\necho 1\n"),
]


@pytest.fixture(scope="module")
def session(spark):
    made = pipeline.scan(spark.createDataFrame(ROWS, "path string, language string, text string").cache())
    return dataclasses.replace(made, comments=made.comments.cache())


def test_check(session):
    rows = pipeline.check(session).collect()
    assert {(r.file_path, r.canonical_rule_id, r.severity, r.suppressed_by) for r in rows} == {
        ("refs.py", "rot_ref", "warning", None), ("refs.py", "rot_signature", "error", None), ("a.js", "rot_ref", "warning", "directive"), ("s.sh", "rot_path", "warning", None),
        ("refs.py", "marker:TODO", "warning", None),
    }
    one = pipeline.summary(pipeline.check(session), session.comments).first()
    assert (one.findings, one.suppressed, one.unattached) == (4, 1, 0)
    assert [r.severity for r in pipeline.candidates(session, 1).collect()] == ["error"]


def test_query_and_edit(session):
    assert pipeline.query(session, "missing html reads", 3).first().path == "s.sh"
    cid = session.comments.where("raw_text LIKE '# see%'").first().id
    assert pipeline.context(session, cid, pipeline.check(session), True).first().code.startswith("def parse")
    edited = pipeline.apply_edit(session, cid, "# see `parse`")
    assert edited.first().ok and pipeline.recheck(edited, session.files, 2).count() == 0
    shebang = session.comments.where("kind = 'shebang'").first().id
    assert pipeline.remove(session, shebang).count() == 0 and pipeline.remove(session, shebang, True).count() == 1
    assert {r.path: r.removed for r in pipeline.strip(session).collect()} == {"refs.py": 3, "a.js": 1, "s.sh": 1}
    todo, done = pipeline.issues_sync(session, session.files.sparkSession.createDataFrame([], records.LEDGER))
    assert todo.count() == 1 and done.count() == 0


def test_sinks(spark, session, tmp_path):
    sinks.write_jsonl(session.comments, f"{tmp_path}/jsonl")
    assert records.read_jsonl(spark, f"{tmp_path}/jsonl").count() == session.comments.count()
    checked = pipeline.check(session)
    sinks.write_sarif(checked, f"{tmp_path}/sarif")
    log = json.loads("".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part*"))))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 5
    base = pipeline.baseline_accept(checked, session.comments)
    full = base.withColumn("reason", F.lit('a "b"')).withColumn("date", F.lit(None).cast("string"))
    sinks.write_baseline(full, f"{tmp_path}/base.toml")
    assert records.read_baseline(spark, f"{tmp_path}/base.toml").exceptAll(full).count() == 0
    assert records.read_baseline(spark, f"{tmp_path}/none.toml").count() == 0
    ledger = spark.createDataFrame([("s|line|TODO", "1", None, True)], records.LEDGER)
    sinks.write_ledger(ledger, f"{tmp_path}/ledger.toml")
    assert records.read_ledger(spark, f"{tmp_path}/ledger.toml").collect() == ledger.collect()
    (tmp_path / "new.toml").write_text("version = 9\n")
    with pytest.raises(records.VersionError):
        records.read_ledger(spark, f"{tmp_path}/new.toml")
    vectors = session.comments.select("id", F.array(F.lit(1.0)).alias("vector"))
    sinks.persist_index(session.comments, checked, vectors, f"{tmp_path}/index")
    assert sinks.open_index(spark, f"{tmp_path}/index")["identity"].count() == session.comments.count()


def test_report_and_placements(spark, session, tmp_path):
    checked = pipeline.check(session)
    runs = spark.createDataFrame([("ruff", "SUCCESS")], "provider string, run_state string")
    assert pipeline.report(checked, session.comments, runs, str(tmp_path)).first().verdict == "fail"
    assert (tmp_path / "sarif").exists() and (tmp_path / "markdown").exists() and (tmp_path / "jsonl").exists()
    placed = {r.path: r for r in pipeline.suppressions_place(session, checked).collect()}
    assert placed["s.sh"].ok and "# reads missing.html and ./s.sh  # marginalia:disable-line=native:rot_path" in placed["s.sh"].new_text
    again = session.files.join(spark.createDataFrame([(p, r.new_text) for p, r in placed.items()], "path string, t string"), "path").select("path", "language", F.col("t").alias("text"))
    from marginalia.operators import suppress

    assert suppress.placements(suppress.export_directives(checked), again).where("path = 's.sh'").count() == 0
    assert pipeline.known_providers(spark).count() == 4


def test_sql_functions_and_embedder(spark, session):
    from marginalia.functions import sql
    from marginalia.operators.embed import HashEmbedder, missing_vectors, with_vectors

    sql.register(spark)
    row = spark.sql("SELECT comment_tokens('A b,c!') t, utf16_length('a💩') u, qualified_rule('r', 'D1') q, spans_overlap(0, 2, 1, 3) o, severity_rank('error') s, severity_rank('x') n").first()
    assert (row.t, row.u, row.q, row.o, row.s, row.n) == (["a", "b", "c"], 3, "r:D1", True, 2, None)
    first = session.comments.select("content_hash").first().content_hash
    cache = spark.createDataFrame([(first, "det64/1", [0.5])], "content_hash string, model_version string, vector array<float>")
    texts = session.comments.select("content_hash").distinct().count()
    assert missing_vectors(session.comments, cache, "det64/1").count() == texts - 1
    out = {r.content_hash: r.vector for r in with_vectors(session.comments, cache, HashEmbedder()).collect()}
    assert len(out) == texts and out[first] == [0.5]


def test_walk(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "b/tool": "#!/usr/bin/env bash\n", ".hidden.py": "x\n", "gen.py": "# @generated\n", "dist/c.js": "1\n", "d.txt": "no\n", "b/__init__.py": "", "big.js": "a" * 3000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    tree = files.tree(spark, str(tmp_path))
    found = {(r.path, r.language) for r in files.walk(tree, ["dist/"]).collect()}
    assert found == {("a.py", "python"), ("b/tool", "shell"), ("bad.py", "python"), ("b/__init__.py", "python")}
    assert {r.path for r in files.skipped(tree).collect()} == {"bad.py"}
    assert ".hidden.py" in {r.path for r in files.universe(tree).collect()}


def test_globs(spark):
    df = spark.createDataFrame([("a/b.min.js",), ("dist/x.py",), ("src/dist.py",), ("docs/a.md",), ("docs/keep.md",)], "path string")
    kept = df.where(~files.ignored(F.col("path"), ["*.min.js", "dist/", "/docs/*", "!/docs/keep.md", "# note", ""]))
    assert {r.path for r in kept.collect()} == {"src/dist.py", "docs/keep.md"}


def test_stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "path string, language string, text string")
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        incremental.stream_comments(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_optional_subpackage():
    code = "import sys; sys.modules['marginalia.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run(["python", "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 40, out.stderr
