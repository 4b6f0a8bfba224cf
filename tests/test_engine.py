"""Markers, toggles, regions and blocks of lines against brute force, and the cases that are easy to get wrong."""

import itertools

import pytest
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.operators import findings, identity, providers, rot, suppress, triage
from marginalia.plans import lineage, pipeline
from marginalia.plans.timings import Timings
from marginalia.sources import files, records

SPAN = "struct<start_byte:bigint,end_byte:bigint,start_line:int,end_line:int>"


def session_of(spark, texts):
    rows = spark.createDataFrame(texts, "path string, text string").withColumn("language", files.language(F.col("path")))
    return pipeline.scan(rows)


def test_marker_findings(spark):
    session = session_of(spark, [("a.py", "# héllo TODO\n# TODO: one\nx = 1\n\n# FIXME two; TODO\ny = 2\n"), ("b.py", ""), ("c.py", None)])
    found = pipeline.check(session, off=rot.DETECTORS, severities={"FIXME": "error"}).orderBy("file_path", "span.start_byte").collect()
    assert [(r.canonical_rule_id, r.severity, r.category) for r in found] == [("marker:TODO", "warning", "marker_stale"), ("marker:FIXME", "error", "marker_stale")]
    # The first place of the word, which need not be that of the marker.
    assert found[0].span.start_byte == len("# héllo ".encode())
    known = suppress.accept(pipeline.check(session), session.comments)
    assert suppress.new_findings(pipeline.check(session), session.comments, known).count() == 0
    assert pipeline.candidates(session, 1, off=rot.DETECTORS).first().canonical_rule_id == "marker:TODO"
    assert pipeline.native(session, (*rot.DETECTORS, "markers")).count() == 0


def test_markers_are_suppressed_by_directives(spark):
    session = session_of(spark, [("a.py", "# marginalia:disable-file=marker_stale\nx = 1\n\n# TODO: one\ny = 2\n"), ("b.py", "# TODO: two\n")])
    found = {r.file_path: r.suppressed_by for r in pipeline.check(session, off=rot.DETECTORS).where("category = 'marker_stale'").collect()}
    assert found == {"a.py": "directive", "b.py": None}


def test_regions_against_brute_force(spark):
    verbs = ["disable", "enable", "disable-line", "disable-next-line", "disable-file"]
    targets = [[], ["r"], ["c"], ["o", "r"]]
    ds = [(i, f"f{i % 3}", (i * 7) % 11, verbs[i % 4] if i % 9 else verbs[4], targets[(i * 5) % 4]) for i in range(60)]
    ds = [d for d in ds if d[3] != "disable-file" or d[1] == "f2"]
    fs = [(1000 + i, f"f{i % 3}", i % 12, "r" if i % 2 else "q", "c" if i % 5 else None, "o" if i % 7 else "p") for i in range(90)]
    f = spark.createDataFrame(fs, "finding_id long, file_path string, line int, provider_rule_id string, category string, origin string").selectExpr("*", "provider_rule_id AS canonical_rule_id", "named_struct('start_line', line) AS span")
    d = spark.createDataFrame(ds, "directive_id long, path string, line int, verb string, targets array<string>")

    def covers(d, x, everywhere):
        same = everywhere or d[1] == x[1]
        named = not d[4] or set(d[4]) & {x[3], x[4], x[5]}
        if not same or not named:
            return False
        if d[3] == "disable":
            ended = any(e[3] == "enable" and (everywhere or e[1] == d[1]) and d[2] < e[2] <= x[2] and (not e[4] or not d[4] or set(e[4]) & set(d[4])) for e in ds)
            return d[2] <= x[2] and not ended
        return d[3] == "disable-file" or d[3] == "disable-line" and d[2] == x[2] or d[3] == "disable-next-line" and d[2] + 1 == x[2]

    got = {r.finding_id for r in suppress.suppressed_by_directive(f, d).collect()}
    assert got == {x[0] for x in fs if any(covers(y, x, False) for y in ds)}
    got = {r.finding_id for r in suppress.suppressed_by_directive(f, d, everywhere=True).collect()}
    assert got == {x[0] for x in fs if any(covers(y, x, True) for y in ds)}
    assert suppress.suppressed_by_directive(f, d.limit(0)).count() == 0


def test_blocks_of_lines(spark):
    blame = [("a", n, (n * 37) % 1000, f"c{n}") for n in range(1, 400) if n % 5]
    spans = [(i, "a", a, b) for i, (a, b) in enumerate(itertools.product((1, 63, 64, 65, 127, 128, 200), (1, 63, 64, 127, 128, 191, 399)))] + [(999, "b", 1, 2), (998, "a", None, None)]
    rows = spark.createDataFrame([(i, p, (0, 0, a, b) if a else None) for i, p, a, b in spans], f"id long, path string, span {SPAN}")
    b = spark.createDataFrame(blame, "path string, line int, committed_unix long, commit_id string").selectExpr("*", "'x' AS author", "'' AS email")
    got = {r.id: r.commit.commit_id for r in rot.latest_in_lines(rows, b, "span").collect()}
    wanted = {}
    for i, p, lo, hi in spans:
        inside = [x for x in blame if lo and x[0] == p and lo <= x[1] <= max(lo, hi)]
        if inside:
            wanted[i] = max(inside, key=lambda x: (x[2], -x[1]))[3]
    assert got == wanted


def test_match_leaves_out_the_row_itself(spark):
    schema = "id long, content_hash string, bound_symbol string, cosmetic_fingerprint string, kind string, vector array<float>"
    rows = [(100, "h", "f", "p", "line", [1.0, 0.0]), (101, "h", "g", "q", "line", None), (200, "i", "f", "r", "line", [1.0, 0.1]), (300, "j", "z", "s", "line", [0.0, 1.0]), (400, None, None, None, None, None)]
    c = spark.createDataFrame(rows, schema)
    got = {(r.query_id, r.id, r.tier) for r in identity.match(c.where("id % 100 = 0"), c).collect()}
    assert got == {(100, 101, 1), (200, 100, 4)}


def test_nested_documents(spark):
    doc = '[{"filePath":"./a.ts","messages":[{"ruleId":"require-jsdoc","line":3},{"ruleId":"no-undef","line":4}]},{"filePath":"b.ts","messages":[]},{"filePath":"c.ts"}]'
    runs = spark.createDataFrame([(1, doc), (2, "["), (3, None), (4, "{}")], "run int, document string")
    got = providers.normalise(runs, providers.ESLINT).select("run", "provider_rule_id", "category", "file_path", "line").collect()
    assert [tuple(r) for r in got] == [(1, "eslint:require-jsdoc", "doc_missing", "a.ts", 3)]


def test_providers_and_states(spark):
    f = spark.createDataFrame([("a.py", "python"), ("b.sh", "shell"), ("c", None)], "path string, language string")
    p = spark.createDataFrame([("ruff", ["python"]), ("all", []), ("none", None)], "provider string, languages array<string>")
    got = {(r.provider, r.path) for r in findings.provider_files(f, p).collect()}
    assert got == {("ruff", "a.py"), *(("all", x) for x in ("a.py", "b.sh", "c")), *(("none", x) for x in ("a.py", "b.sh", "c"))}
    runs = spark.createDataFrame([("g", "SUCCESS"), ("h", "EMPTY"), ("g", "PARTIAL"), ("x", "SUCCESS")], "provider string, run_state string")
    kept, scoped = spark.createDataFrame([("h",)], "origin string"), spark.createDataFrame([("g",), ("h",)], "provider string")
    assert sorted(tuple(r)[:2] for r in findings.scoped_states(runs, kept, scoped).select("provider", "run_state").collect()) == [("g", "EMPTY"), ("g", "PARTIAL"), ("h", "SUCCESS"), ("x", "SUCCESS")]


def test_latest_files(spark):
    rows = [("a", "1", "2025-01-01"), ("a", "2", "2025-01-02"), ("b", "3", None), ("c", "4", "2025-01-01"), ("c", "4", "2025-01-01")]
    f = spark.createDataFrame(rows, "path string, text string, at string").selectExpr("path", "text", "cast(at AS timestamp) AS walked_at")
    assert sorted((r.path, r.text) for r in files.latest(f).collect()) == [("a", "2"), ("b", "3"), ("c", "4")]


def test_a_tree_with_one_large_folder(spark, tmp_path):
    for i in range(30):
        (tmp_path / "src" / f"d{i % 3}" / f"e{i}").mkdir(parents=True)
        (tmp_path / "src" / f"d{i % 3}" / f"e{i}" / "__init__.py").write_text(f"x = {i}\n")
    (tmp_path / ".hidden").write_bytes(b"\xff")
    got = {r.path: r.text for r in files.tree(spark, str(tmp_path)).collect()}
    assert len(got) == 31 and got["src/d1/e1/__init__.py"] == "x = 1\n" and got[".hidden"] is None


def test_errors_and_timings(spark, tmp_path):
    assert str(errors.ProviderError("ruff", "gone")) == "provider 'ruff' error: gone" and str(errors.WalkError("gone")) == "file walk error: gone"
    (tmp_path / "marginalia.toml").write_text("not toml [")
    with pytest.raises(errors.ConfigError):
        records.read_config(str(tmp_path))
    t = Timings()
    with t.stage("read"):
        t.counted("read", spark.range(7)).write.format("noop").mode("overwrite").save()
    (name, seconds, rows), = t.report()
    assert name == "read" and seconds > 0 and rows == 7


def test_a_shared_folder_is_asked_for(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        lineage.ensure_checkpoint_dir(Session())
