from pyspark.sql import functions as F

from marginalia.operators import findings, identity, issues, providers, rank, revisions, rot, search, suppress
from marginalia.schema import FINDINGS, categories
from marginalia.sources.records import LEDGER, merge_config, parse_blame

SPAN = "STRUCT<start_byte: BIGINT, end_byte: BIGINT, start_line: INT, end_line: INT>"


def finding(i, start, end, origin="ruff", severity="info", category="doc_style", line=1, rule=None, file="f", comment=None):
    return (i, comment, file, None, None, (start, end, line, line), origin, rule or f"{origin}:r", "r", category, severity, None, None, "m", "none", None, None)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), FINDINGS)


def merged(spark, *rows):
    out = findings.merge_overlaps(table(spark, *rows)).orderBy("span.start_byte").collect()
    return [(r.origin, r.severity, r.also_from, r.merged) for r in out]


def test_merge_overlaps(spark):
    assert merged(spark, finding(1, 0, 10), finding(2, 5, 15, "eslint", "warning")) == [("eslint", "warning", ["ruff"], 2)]
    assert len(merged(spark, finding(1, 0, 10), finding(2, 10, 20))) == 2
    assert len(merged(spark, finding(1, 0, 10), finding(2, 0, 10, category="secret"))) == 2
    chain = [finding(1, 0, 6), finding(2, 5, 11, "eslint", "warning"), finding(3, 10, 16, "native")]
    assert merged(spark, *chain) == merged(spark, *chain[::-1]) == [("eslint", "warning", ["native", "ruff"], 3)]
    assert len(merged(spark, finding(1, 4, 4), finding(2, 4, 4))) == 2
    assert len(merged(spark, finding(1, 4, 4), finding(2, 0, 9))) == 1
    assert merged(spark) == []


def test_severity(spark):
    f = table(spark, finding(1, 0, 1, category="secret"), finding(2, 0, 1, rule="ruff:D417"), finding(3, 0, 1, category="unknown"))
    out = {r.finding_id: r.severity for r in findings.resolve_severity(f, categories(spark), {"ruff:D417": "critical"}).collect()}
    assert out == {1: "critical", 2: "critical", 3: None}


def test_attach_takes_the_first(spark):
    comments = spark.createDataFrame([(7, "f", (0, 20, 1, 1), None), (8, "f", (5, 9, 1, 1), "sym"), (9, "g", (0, 99, 1, 1), None)], f"id long, path string, span {SPAN}, bound_symbol string")
    out = {r.finding_id: r.comment_id for r in findings.attach(table(spark, finding(1, 6, 6), finding(2, 30, 31)), comments).collect()}
    assert out == {1: 7, 2: None}
    assert [r.finding_id for r in findings.in_comments(table(spark, finding(1, 6, 6), finding(2, 30, 31)), comments).collect()] == [1]


def test_run_states_and_verdict(spark):
    runs = spark.createDataFrame([("a", "SUCCESS"), ("a", "PARTIAL"), ("b", "SKIPPED"), ("c", "SKIPPED"), ("c", "EMPTY"), ("d", "SUCCESS"), ("d", "SKIPPED")], "k string, run_state string")
    assert {r.k: r.run_state for r in findings.fold_run_states(runs, "k").collect()} == {"a": "PARTIAL", "b": "SKIPPED", "c": "EMPTY", "d": "SUCCESS"}
    good = runs.where("run_state <> 'PARTIAL'")
    assert findings.verdict(table(spark, finding(1, 0, 1, severity="error")), runs).first().verdict == "degraded"
    assert findings.verdict(table(spark, finding(1, 0, 1, severity="error")), good).first().verdict == "fail"
    assert findings.verdict(table(spark), good).first().verdict == "pass"


def directives(spark, *rows):
    return spark.createDataFrame([(i, "f", line, verb, list(targets)) for i, (line, verb, *targets) in enumerate(rows)], "directive_id long, path string, line int, verb string, targets array<string>")


def test_suppression(spark):
    def hit(line, *rows):
        f = table(spark, finding(1, 0, 1, rule="ruff:D417", line=line, category="doc_drift"))
        return suppress.suppressed_by_directive(f.withColumn("canonical_rule_id", F.lit("D417")), directives(spark, *rows)).count() == 1

    assert hit(5, (5, "disable-line", "D417")) and hit(5, (4, "disable-next-line", "D417")) and not hit(5, (9, "disable-line", "D417"))
    assert hit(5, (5, "disable-line", "doc_drift")) and hit(5, (5, "disable-line", "ruff")) and not hit(5, (5, "disable-line", "eslint")) and hit(5, (1, "disable-file", "D417"))
    region = ((1, "disable", "D417"), (6, "enable", "D417"))
    assert hit(3, *region) and not hit(9, *region) and hit(9, (1, "disable", "D417"), (6, "enable", "other"))
    f = table(spark, finding(1, 0, 1, line=2))
    assert [r.directive_id for r in suppress.unused_directives(f, directives(spark, (1, "disable-next-line"), (7, "disable-line"))).collect()] == [1]


def test_baseline(spark):
    comments = spark.createDataFrame([(1, None, "p1"), (2, "s", "p2")], "id long, bound_symbol string, cosmetic_fingerprint string")
    f = table(spark, finding(1, 0, 1, comment=1), finding(2, 0, 1, comment=2), finding(3, 0, 1, comment=2, rule="x:y"))
    base = suppress.accept(f.where("finding_id < 3"), comments)
    assert [r.bound_symbol for r in base.collect()] == [None, "s"]
    assert [r.finding_id for r in suppress.new_findings(f, comments, base).collect()] == [3]
    by_canonical = base.withColumn("rule", F.lit("r"))
    assert suppress.new_findings(f, comments, by_canonical).count() == 0
    assert suppress.prune(base, f.where("finding_id = 1"), comments).count() == 1


def test_ranking(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert [r.id for r in rank.fuse([a, b], 10).collect()] == [2, 1, 3]
    rows = spark.range(10)
    order = [F.asc("id")]
    page = lambda *x: [(r.id, r.total, r.cursor) for r in rank.page(rows.withColumn("cost", F.lit(x[3] if len(x) > 3 else 0)), order, x[0], x[1], "cost" if len(x) > 2 else None, x[2] if len(x) > 2 else None).collect()]
    assert page(3, 0) == [(0, 10, 3), (1, 10, 3), (2, 10, 3)] and page(3, 3)[0] == (3, 10, 6)
    assert [p[0] for p in page(10, 0, 10, 4)] == [0, 1] and page(10, 0, 10, 100) == [(0, 10, 1)] and page(10, 99) == [] and page(10, 0)[0][2] is None
    s = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.9)], "id int, s double")
    assert [r.id for r in rank.by_score(s, "s", "id").collect()] == [3, 1, 2]


def test_search(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue fox jumps"), (4, None), (5, "")], "id int, raw_text string")
    assert [r.id for r in search.keyword(texts, "dog", 5).collect()] == [2]
    assert search.keyword(texts, "  ", 5).count() == 0
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None)], "id int, vector array<float>")
    assert [r.id for r in search.nearest(v, [1.0, 0.0], 5).collect()] == [2, 1]


def test_tiers(spark):
    kind = "id int, content_hash string, bound_symbol string, cosmetic_fingerprint string, kind string, vector array<float>"
    stored = spark.createDataFrame([(1, "h", "s", "p", "line", [1.0, 0.0]), (2, "x", None, "q", "line", [0.0, 1.0]), (3, "y", "t", "r", "line", [0.6, 0.8])], kind)
    asked = spark.createDataFrame([(10, "h", "z", "z", "line", None), (11, "-", None, "q", "line", None), (12, "-", "u", "r", "line", None), (13, "-", "t", "-", "line", [0.6, 0.8]), (14, "-", "-", "-", "line", None)], kind)
    assert {(r.query_id, r.id, r.tier) for r in identity.match(asked, stored).collect()} == {(10, 1, 1), (11, 2, 2), (12, 3, 3), (13, 3, 4)}


def test_ordinals_across_ranges(spark):
    rows = [(i, f"d/{i % 7}", (i, i + 1, 1, 1), None if i % 3 else "s", "line", "p") for i in range(200)]
    df = spark.createDataFrame(rows, f"id long, path string, span {SPAN}, bound_symbol string, kind string, cosmetic_fingerprint string")
    got = {r.id: r.ordinal for r in identity.ordinals(df, 5).collect()}
    for symbol in (None, "s"):
        own = sorted((r for r in rows if r[3] == symbol), key=lambda r: (r[1].split("/"), r[2][0], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))


def test_references(spark):
    texts = ["// mirrors `gone()` upstream", "see `compute`", "the `vanished` helper", ":func:`missing_fn`", "prefer check_and_create_session()", "token(s)", "`None` and `True`", "``two `ticks` ``"]
    df = spark.createDataFrame([(i, "a.py", t, "explanatory_note") for i, t in enumerate(texts)], "id long, path string, raw_text string, intent string")
    known = spark.createDataFrame([("compute",)], "name string")
    assert sorted(r.comment_id for r in rot.stale_references(df, known).collect()) == [0, 2, 3, 4]
    contract = df.withColumn("intent", F.lit("doc_contract")).where("id = 2")
    assert rot.stale_references(contract, known).count() == 0


def test_paths(spark):
    texts = {"account_deletion_requested.html": True, "home.html": False, "./home.html": False, "module_email/dispatch.py": False, "../../etc/passwd.txt": False, "/etc/hosts.txt": False, "a.b.c": False, "api/v1": False, "gone.py.": True}
    df = spark.createDataFrame([(i, t, "explanatory_note") for i, t in enumerate(texts)], "id long, raw_text string, intent string")
    paths = spark.createDataFrame([("web/home.html",), ("src/module_email/dispatch.py",)], "path string")
    got = rot.missing_paths(df, paths).collect()
    assert {list(texts)[r.comment_id] for r in got} == {t for t, missing in texts.items() if missing}
    assert "no such file: gone.py" in {r.message for r in got}


def test_contracts():
    google = '"""Do.\n\n    Args:\n        campaign_slug: the slug\n            that wraps: here\n        context (dict): x\n\n    Raises:\n        CampaignContractError: never\n    """'
    assert rot.doc_contract(google) == (["campaign_slug", "context"], False, ["CampaignContractError"])
    assert rot.doc_contract("/**\n * @param {number} [retries=3] x\n * @throws {ValidationError} y\n * @returns z\n */") == (["retries"], True, ["ValidationError"])
    assert rot.doc_contract(":param str campaign_slug: x\n:returns: y") == (["campaign_slug"], True, [])
    assert rot.doc_contract("Returns the thing.") == ([], False, [])


def test_drift(spark):
    comments = spark.createDataFrame([(1, "f", (0, 1, 1, 1), (2, 3, 2, 4), ("a", "e", "c", 0)), (2, "f", (0, 1, 1, 1), (2, 3, 2, 2), ("a", "e", "c", 0))], f"id long, path string, span {SPAN}, bound_node_range {SPAN}, git struct<author:string,email:string,commit_id:string,committed_unix:bigint>")
    blame = spark.createDataFrame([("f", 4, "c", "a", "e", 31 * 86400), ("f", 2, "c", "a", "e", 30 * 86400)], "path string, line int, commit_id string, author string, email string, committed_unix bigint")
    assert [(r.comment_id, r.message) for r in rot.drift(comments, blame).collect()] == [(1, "code changed 31 days after the comment")]


def test_issues(spark):
    comments = spark.createDataFrame([(1, "f", (0, 1, 1, 1), "s", "line", ["TODO"]), (2, "g", (0, 1, 1, 1), "s", "line", ["TODO", "HACK"])], f"id long, path string, span {SPAN}, bound_symbol string, kind string, markers array<string>")
    ledger = spark.createDataFrame([("s|line|TODO", "1", None, True)], LEDGER)
    tokens = issues.marker_tokens(comments)
    assert [(r.token, r.comment_id, r.mentions) for r in issues.to_file(tokens, ledger).collect()] == [("s|line|HACK", 2, 1)]
    assert [(r.path, r.issues) for r in issues.resolved(tokens, ledger).collect()] == [("f", ["1"])]


def test_providers(spark):
    docs = [("a", '[{"code":"D417","message":"m","filename":"./a.py","location":{"row":1,"column":2}},{"code":"E501"}]'), ("b", "{oops"), ("c", "[]"), ("d", ""), ("e", None)]
    df = spark.createDataFrame(docs, "k string, document string")
    rows = providers.normalise(df, providers.RUFF).collect()
    assert [(r.provider_rule_id, r.category, r.file_path, r.line, r.column) for r in rows] == [("ruff:D417", "doc_drift", "a.py", 1, 2)]
    n = F.when(F.col("k") == "a", 2).otherwise(0)
    assert [r.s for r in df.orderBy("k").select(providers.run_state(F.col("document"), n).alias("s")).collect()] == ["SUCCESS", "PARTIAL", "EMPTY", "SKIPPED", "SKIPPED"]
    shell = spark.createDataFrame([('[{"code":2148,"level":"error","file":"a.sh","line":1,"column":1}]',)], "document string")
    assert [(r.provider_rule_id, r.category, r.severity_native) for r in providers.normalise(shell, providers.SHELLCHECK).collect()] == [("shellcheck:2148", "shebang", "error")]
    leaks = spark.createDataFrame([('[{"RuleID":"aws-access-key","Description":"d","File":"config.py","StartLine":5,"StartColumn":10}]',)], "document string")
    assert [(r.category, r.line, r.column) for r in providers.normalise(leaks, providers.GITLEAKS).collect()] == [("secret", 5, 10)]
    sarif = spark.createDataFrame([('{"runs":[{"results":[{"ruleId":"R","level":"note","message":{"text":"t"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a"}}}]}]}]}',)], "document string")
    assert [(r.canonical_rule_id, r.file_path, r.line) for r in providers.from_sarif(sarif).collect()] == [("R", "a", 1)]
    located = providers.locate(providers.normalise(df, providers.RUFF), spark.createDataFrame([("a.py", "é = 1\n")], "path string, text string"))
    assert located.first().span.start_byte in (0, 1, 2)


def test_cache_and_upsert(spark):
    results = spark.createDataFrame([("h", "p", "1", "SUCCESS", 1), ("h", "p", "1", "PARTIAL", 2), ("g", "p", "1", "EMPTY", 1)], "content_hash string, provider string, provider_version string, run_state string, cached_at int")
    needed = spark.createDataFrame([("h", "p", "1"), ("g", "p", "1"), ("g", "p", "2")], "content_hash string, provider string, provider_version string")
    assert [(r.content_hash, r.provider_version) for r in providers.missing(needed, results).collect()] == [("g", "2")]
    assert providers.cached(needed, results).where("cached").count() == 1
    assert {r.cached_at for r in providers.upsert(results, results.where("cached_at = 2"), ["content_hash"], "cached_at").collect()} == {1, 2}


def test_revisions(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, content_hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, content_hash string")
    assert {(r.path, r.change) for r in revisions.changed_files(a, b).collect()} == {("y", "modified"), ("z", "removed"), ("w", "added")}
    assert revisions.inputs_key(1, {"a": ("1", "c"), "b": ("2", "d")}) == revisions.inputs_key(1, {"b": ("2", "d"), "a": ("1", "c")})
    assert revisions.readable(1, 2) and revisions.readable(2, 2) and not revisions.readable(3, 2) and not revisions.readable(0, 2)


def test_records(spark):
    assert merge_config({"a": {"x": 1}}, {"a": {"x": 2, "y": 3}, "b": 1}) == {"a": {"x": 1, "y": 3}, "b": 1}
    dump = "a" * 40 + " 1 1 1\nauthor Ann\nauthor-mail <a@b>\ncommitter-time 5\n\tcode\n"
    df = spark.createDataFrame([("f", dump), ("g", None)], "path string, dump string")
    assert [(r.line, r.author, r.email, r.committed_unix) for r in parse_blame(df).collect()] == [(1, "Ann", "a@b", 5)]
