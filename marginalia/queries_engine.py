"""Registered queries of places, keys, revisions, reports, directives and verbs, each over its whole tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.functions.places import byte_offset, sub_span
from marginalia.operators import classify, edit, extract, findings, identity, issues, providers, rank, revisions, rot, search, suppress, triage
from marginalia.operators.classify import DIRECTIVE_WORD
from marginalia.plans import pipeline
from marginalia.plans.lineage import shared_folder
from marginalia.queries import WORDS, _accepted, _comments, _findings, _sources, _walked, query
from marginalia.sources import files, records, sinks
from marginalia.sources.tables import table

MARKER_SEVERITIES = {"FIXME": "error", "HACK": "critical"}
MODEL = "det64/1"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid4().hex}"


# Functions of text and places


@query
def fn_rule_id(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).select("finding_id", T.rule_id(F.col("origin"), F.col("canonical_rule_id")).alias("rule"))


@query
def fn_inner_text(spark: SparkSession, folder: str) -> DataFrame:
    """Comments without their marks."""
    return _comments(spark, folder).select("id", F.sha2(classify.inner_text(F.col("raw_text")), 256).alias("inner"))


@query
def fn_unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The first value and the length of each usable vector once it is scaled to length 1."""
    v = table(spark, folder, "comment_vectors", "content_hash", "model_version", "vector").where(F.size("vector") == 64)
    v = v.where(F.forall("vector", lambda x: ~F.isnan(x))).distinct().withColumn("u", V.unit(F.col("vector")))
    return v.select("content_hash", "model_version", F.round(F.element_at("u", 1), 5).alias("first"), F.round(V.norm(F.col("u")), 5).alias("length"))


@query
def fn_byte_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The byte of the third character of each document's second line, by characters, UTF-16 units and bytes."""
    d = table(spark, folder, "documents", "doc_id", "text")
    by = lambda system: byte_offset(F.col("text"), F.lit(2), F.lit(3), system)
    return d.select("doc_id", by("1-based-char").alias("by_char"), by("1-based-utf16").alias("by_unit"), by("1-based-utf8").alias("by_byte"), byte_offset(F.col("text"), F.lit(1), F.lit(2), "0-based-utf8").alias("from_0"))


@query
def fn_sub_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The place of the first marker of each comment that has one."""
    c = _comments(spark, folder).where(F.size("markers") > 0)
    first = F.element_at("markers", 1)
    at = F.octet_length(F.call_function("substring_index", F.col("raw_text"), first, F.lit(1)))
    return c.select("id", sub_span(F.col("span"), at, F.octet_length(first)).alias("s")).select("id", "s.start_byte", "s.end_byte")


@query
def fn_eslint_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by the category of their rule at eslint, whatever tool they are of."""
    c = T.eslint_category(F.regexp_replace(F.lower("canonical_rule_id"), "^d417$", "jsdoc/check-param-names"))
    return _findings(spark, folder).groupBy(F.coalesce(c, F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query
def fn_fix_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Who may fix each finding, where only ruff and eslint can do so by themselves."""
    return _findings(spark, folder).select("finding_id", T.fix_route(F.col("fix"), F.col("origin").isin("ruff", "eslint")).alias("route"))


@query
def fn_search_terms(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct words each finding's message asks a search for; null if none."""
    return _findings(spark, folder).select("finding_id", F.when(T.search_terms(F.col("message")).isNotNull(), F.size(T.search_terms(F.col("message")))).alias("terms"))


# Sources


@query
def sc_relative(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a checkout, relative to it."""
    p = _walked(spark, folder).select("path", F.concat(F.lit("file:///srv/checkout/"), F.replace("path", F.lit("/"), F.lit("\\"))).alias("full"))
    return p.select("path", files.relative(F.col("full"), "/srv/checkout").alias("relative"))


@query
def sc_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """All comments written as JSON lines and read back."""
    out = _folder(spark)
    sinks.write_jsonl(_comments(spark, folder), out)
    c = records.read_jsonl(spark, out)
    return c.select("id", "path", "kind", "bound_symbol", F.sha2("raw_text", 256).alias("hash"), F.col("span.end_byte").alias("end_byte"), F.array_join(F.coalesce("markers", F.array().cast("array<string>")), ",").alias("markers"), F.col("git.commit_id").alias("commit"))


@query
def sc_blame(spark: SparkSession, folder: str) -> DataFrame:
    """Blame dumps made of the comments' commits, and parsed."""
    c = _comments(spark, folder).where("git.commit_id IS NOT NULL AND path IS NOT NULL")
    one = F.concat(
        F.rpad(F.substring(F.sha2("git.commit_id", 256), 1, 40), 40, "0"), F.lit(" 1 "), F.col("span.start_line").cast("string"), F.lit("\nauthor "), F.coalesce("git.author", F.lit("")), F.lit("\nauthor-mail <"),
        F.coalesce("git.email", F.lit("")), F.lit(">\ncommitter-time "), F.coalesce("git.committed_unix", F.lit(0)).cast("string"), F.lit("\n\tcode\n"),
    )
    dumps = c.groupBy("path", "span.start_line").agg(F.min_by(one, "id").alias("dump")).select("path", "dump")
    return records.parse_blame(dumps)


@query
def sc_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline up to October 2025 written as TOML and read back."""
    out = _folder(spark)
    sinks.write_baseline(_accepted(spark, folder), out)
    return records.read_baseline(spark, out)


@query
def sc_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """An issue ledger of all markers written as TOML and read back."""
    out = _folder(spark)
    tokens = issues.marker_tokens(_comments(spark, folder)).select("token").distinct()
    url = F.when(F.length("token") % 3 == 0, F.concat(F.lit("https://issues.invalid/?q=\""), "token", F.lit("\"")))
    sinks.write_ledger(tokens.select("token", F.sha2("token", 256).alias("id"), url.alias("url"), (F.length("token") % 2 == 0).alias("closed")), out)
    return records.read_ledger(spark, out)


@query
def sc_generated_walk(spark: SparkSession, folder: str) -> DataFrame:
    """The source files to look at: not ignored, not hidden, of a known language, not generated."""
    return files.walk(_walked(spark, folder, "text"), ("node_modules/", "vendor/", "*.min.js")).select("path", "language")


@query
def sc_skipped(spark: SparkSession, folder: str) -> DataFrame:
    return files.skipped(_walked(spark, folder, "text"))


# Extraction against the table of comments


@query
def ex_scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Comments of the table whose place and text the extraction finds in their files."""
    found = extract.comments(_sources(spark, folder)).select("path", F.col("span.start_byte").alias("start_byte"), "content_hash")
    known = _comments(spark, folder).where("NOT (kind = 'docstring' AND bound_symbol = '<module>')").select("path", F.col("span.start_byte").alias("start_byte"), "content_hash").distinct()
    return known.join(found, ["path", "start_byte", "content_hash"], "left_semi")


@query
def ex_coalesced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line comments merged where nothing but blanks stands between them: what stands around them is taken from the files."""
    c = _comments(spark, folder).select("path", "span", "raw_text", "kind", "bound_symbol", "bound_node_range", "id")
    first = c.groupBy("path", "span.start_byte").agg(F.min_by(F.struct("span", "raw_text", "kind", "bound_symbol", "bound_node_range", "id"), "id").alias("c")).select("path", "c.*")
    placed = first.withColumn("before", F.lag("span.end_byte").over(_by_place()))
    texts = _walked(spark, folder, "text").where("text IS NOT NULL").select("path", F.encode("text", "UTF-8").alias("bytes"))
    piece = lambda a, b: F.substring(F.col("bytes"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    start = F.col("span.start_byte")
    around = placed.join(texts, "path").withColumn("own_line", F.trim(F.regexp_extract(piece(F.lit(0), start), r"([^\n]*)\z", 1)) == "")
    joint = F.when(F.col("before") <= start, piece(F.coalesce("before", F.lit(0)), start))
    around = around.withColumn("joint", F.when(F.regexp_replace(joint, r"\s+", "") == "", joint)).drop("bytes", "before")
    merged = extract.coalesce_lines(around)
    return merged.select("path", "id", "kind", F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line"), F.length("raw_text").alias("length"))


def _by_place() -> object:
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("span.start_byte")


# Commits, drift and candidates


def _code_blame(spark: SparkSession, folder: str) -> DataFrame:
    """Blame of the code that comments are about: the time of the latest walk of its file, as its last commit."""
    walked = table(spark, folder, "walked_files", "path", "walked_at").groupBy("path").agg(F.max("walked_at").alias("at"))
    c = _comments(spark, folder).where("bound_node_range IS NOT NULL")
    lines = c.select("path", F.explode(F.sequence("bound_node_range.start_line", F.greatest("bound_node_range.start_line", "bound_node_range.end_line"))).alias("line")).distinct()
    return lines.join(walked, "path").select("path", "line", F.lit("walk").alias("commit_id"), F.lit("walker").alias("author"), F.lit("").alias("email"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("committed_unix"))


@query
def rt_code_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Comments whose file was walked more than five hundred days after their commit."""
    return rot.drift(_comments(spark, folder), _code_blame(spark, folder), 500).select("comment_id", "message")


@query
def ck_rot_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of comments that are older than their code."""
    c = _comments(spark, folder)
    f = rot.as_findings(triage.older_than_code(c, _code_blame(spark, folder)), c)
    return f.select("comment_id", "provider_rule_id", "category", "severity", F.col("span.start_byte").alias("start_byte"))


@query
def ck_marker_findings(spark: SparkSession, folder: str) -> DataFrame:
    """A finding for each marker of each comment, at the first place of its word."""
    c = _comments(spark, folder)
    f = rot.as_findings(triage.markers(c, MARKER_SEVERITIES), c)
    return f.select("comment_id", "file_path", "provider_rule_id", "category", "severity", "message", F.col("span.start_byte").alias("start_byte"), F.col("span.end_byte").alias("end_byte"))


# Findings, comments and providers


def _behind(spark: SparkSession, folder: str) -> DataFrame:
    """Findings seen from behind: at the byte behind their span, without a symbol."""
    s = F.col("span")
    end = F.struct(s["end_byte"].alias("start_byte"), s["end_byte"].alias("end_byte"), s["end_line"].alias("start_line"), s["end_line"].alias("end_line"))
    return _findings(spark, folder).withColumn("span", end).withColumn("target_symbol", F.lit(None).cast("string"))


@query
def jn_unattached_behind(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that touch no comment once they are seen from behind."""
    return findings.unattached(_behind(spark, folder), _comments(spark, folder)).select("finding_id")


@query
def ag_unattached_rules(spark: SparkSession, folder: str) -> DataFrame:
    return findings.rule_counts(findings.unattached(_behind(spark, folder), _comments(spark, folder)))


def _providers(spark: SparkSession) -> DataFrame:
    return pipeline.known_providers(spark)


@query
def jn_provider_files(spark: SparkSession, folder: str) -> DataFrame:
    """What each provider is run on: the files of its languages."""
    return findings.provider_files(_walked(spark, folder).select("path", files.language(F.col("path")).alias("language")), _providers(spark))


@query
def jn_scoped_states(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their states recomputed from the findings that lie in comments, for comment-scoped providers."""
    runs = providers.latest(table(spark, folder, "provider_results")).select("content_hash", "provider", "provider_version", "run_state")
    kept = findings.in_comments(_behind(spark, folder), _comments(spark, folder))
    scoped = spark.createDataFrame([("gitleaks",), ("eslint",)], "provider STRING")
    return findings.scoped_states(runs, kept, scoped)


@query
def jn_identity_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Identities, with ordinals, of all comments that share a key with a comment of a finding."""
    c = _comments(spark, folder)
    keys = c.join(_findings(spark, folder).select(F.col("comment_id").alias("id")), "id", "left_semi")
    return identity.lookup(identity.ordinals(c), keys).select("id", "ordinal")


@query
def jn_match_all(spark: SparkSession, folder: str) -> DataFrame:
    """Comments whose id is divisible by 100 matched with all other comments, by text, symbol, fingerprint and vector."""
    v = table(spark, folder, "comment_vectors", "content_hash", "model_version", "vector").where((F.col("model_version") == MODEL) & (F.size("vector") == 64))
    v = v.where(F.forall("vector", lambda x: ~F.isnan(x))).groupBy("content_hash").agg(F.min("vector").alias("vector"))
    c = _comments(spark, folder).join(v, "content_hash", "left")
    return identity.match(c.where("id % 100 = 0"), c)


@query
def st_scope_veto(spark: SparkSession, folder: str) -> DataFrame:
    """What providers are run on, without the files that cached results say were skipped."""
    planned = findings.provider_files(_walked(spark, folder).select("path", files.language(F.col("path")).alias("language")), _providers(spark))
    skipped = table(spark, folder, "provider_results").where("run_state = 'SKIPPED'").select("content_hash", "provider").distinct()
    vetoed = _walked(spark, folder, "content_hash").join(skipped, "content_hash").select("provider", "path")
    return revisions.scope_veto(planned, vetoed)


@query
def ag_merge_per_comment(spark: SparkSession, folder: str) -> DataFrame:
    merged = findings.merge_per_comment(_findings(spark, folder))
    return merged.select("finding_id", "merged", F.array_join("also_from", ",").alias("also_from"))


@query
def ag_rule_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.rule_descriptors(_findings(spark, folder))


@query
def ag_cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    """How many files a cache of the results up to October 2025 serves for the newest version of each provider."""
    r = table(spark, folder, "provider_results")
    newest = F.broadcast(r.groupBy("provider").agg(F.max("provider_version").alias("provider_version")))
    needed = _walked(spark, folder, "content_hash").where("content_hash IS NOT NULL").select("content_hash").distinct()
    needed = needed.withColumn("provider", F.explode(F.array(*map(F.lit, ("ruff", "shellcheck", "eslint", "gitleaks"))))).join(newest, "provider")
    return findings.cache_stats(providers.cached(needed, r.where(F.col("cached_at") < "2025-10-01")))


@query
def ag_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on all findings, with the runs as they are, with partial runs taken as skipped, and for no finding."""
    runs = providers.latest(table(spark, folder, "provider_results"))
    whole = runs.withColumn("run_state", F.when(F.col("run_state") == "PARTIAL", "SKIPPED").otherwise(F.col("run_state")))
    f = _findings(spark, folder)
    parts = [("as they are", f, runs), ("none partial", f, whole), ("no finding", f.where("false"), whole)]
    out = [findings.verdict(x, r, "critical").select(F.lit(name).alias("case_name"), "verdict", "code") for name, x, r in parts]
    return out[0].union(out[1]).union(out[2])


# Orders and searches


@query
def wn_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty first findings in canonical order."""
    return sinks.first_in_order(_findings(spark, folder), 50).select("finding_id", "position")


@query
def wn_by_score(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty vectors most like a query's, by score, of unusable ones those without a number last."""
    v = table(spark, folder, "comment_vectors", "content_hash", "model_version", "vector").where(f"size(vector) = 64 AND model_version = '{MODEL}'")
    v = v.select("content_hash", V.cosine(F.col("vector"), F.array(*[F.lit(x) for x in search.embed(WORDS)])).alias("score")).groupBy("content_hash").agg(F.max("score").alias("score"))
    return rank.by_score(v, "score", "content_hash").limit(30).select("content_hash", F.round("score", 5).alias("score"))


@query
def wn_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Comments by words and by vectors, fused."""
    c = _comments(spark, folder)
    v = table(spark, folder, "comment_vectors", "content_hash", "model_version", "vector").where(f"size(vector) = 64 AND model_version = '{MODEL}'")
    v = v.where(F.forall("vector", lambda x: ~F.isnan(x))).groupBy("content_hash").agg(F.min("vector").alias("vector"))
    vectors = c.select("id", "content_hash").join(v, "content_hash").select("id", "vector")
    return search.hybrid(c.select("id", "raw_text"), vectors, WORDS, search.embed(WORDS)).select("id", F.round("score", 9).alias("score"))


# Directives and baselines


def _directed(spark: SparkSession, folder: str) -> DataFrame:
    """Comments that hold directives on findings of their line: the verb by the finding's severity, the target by its tool."""
    f = _findings(spark, folder)
    verb = F.create_map(*[F.lit(x) for kv in {"info": "disable", "warning": "disable-line", "error": "disable-next-line", "critical": "enable"}.items() for x in kv])
    target = F.when(F.col("origin") == "ruff", F.lit("")).when(F.col("origin") == "eslint", F.concat(F.lit("="), "category")).otherwise(F.concat(F.lit("="), "provider_rule_id", F.lit(","), "origin"))
    word = F.when((F.col("severity") == "critical") & (F.col("origin") == "native"), "disable-file").otherwise(F.coalesce(F.try_element_at(verb, F.col("severity")), F.lit("none")))
    return f.select(
        F.col("finding_id").alias("id"), F.col("file_path").alias("path"), "span", F.concat(F.lit(f"/* {DIRECTIVE_WORD}:"), word, target, F.lit("*/")).alias("raw_text"),
        F.lit(None).cast("string").alias("bound_symbol"), F.lit(None).cast("string").alias("cosmetic_fingerprint"),
    )


@query
def fn_directives(spark: SparkSession, folder: str) -> DataFrame:
    """Directives of all scopes, parsed from the text of comments."""
    d = suppress.directives(_directed(spark, folder))
    return d.select("directive_id", "path", "line", "verb", F.array_join("targets", ",").alias("targets"))


@query
def sp_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Findings covered by a directive for their file, line, next line or region, and by which."""
    return suppress.suppressed_by_directive(_findings(spark, folder), suppress.directives(_directed(spark, folder)))


@query
def sp_unused(spark: SparkSession, folder: str) -> DataFrame:
    return suppress.unused_directives(_findings(spark, folder), suppress.directives(_directed(spark, folder))).select("directive_id")


@query
def sp_combined(spark: SparkSession, folder: str) -> DataFrame:
    """All findings with what suppresses them: a directive, else the baseline up to October 2025."""
    c = _comments(spark, folder).select("id", "path", "span", "raw_text", "bound_symbol", "cosmetic_fingerprint")
    # The directives' comments have ids of their own.
    own = _directed(spark, folder).withColumn("id", -F.col("id") - 1)
    return suppress.suppress(_findings(spark, folder), c.unionByName(own), _accepted(spark, folder)).select("finding_id", "suppressed_by")


@query
def sp_live(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the findings when suppressed ones are hidden, by tool."""
    c = _comments(spark, folder).select("id", "path", "span", "raw_text", "bound_symbol", "cosmetic_fingerprint")
    own = _directed(spark, folder).withColumn("id", -F.col("id") - 1)
    left = suppress.live(suppress.suppress(_findings(spark, folder), c.unionByName(own), _accepted(spark, folder)))
    return left.groupBy("origin").agg(F.count("*").alias("n"))


@query
def sp_marker_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Marker findings that a baseline of the comments scanned up to October 2025 doesn't know."""
    c = _comments(spark, folder)
    f = rot.as_findings(triage.markers(c), c)
    known = suppress.accept(rot.as_findings(triage.markers(c.where(F.col("scanned_at") < "2025-10-01")), c), c)
    return suppress.new_findings(f, c, known).select("comment_id", "provider_rule_id")


# Keys of runs, and what they are good for


def _runs_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """month, provider, provider_version, config_hash: the newest version of each provider in a month."""
    r = table(spark, folder, "provider_results", "provider", "provider_version", "cached_at").where("cached_at IS NOT NULL")
    month = F.date_format(F.col("cached_at").cast("timestamp"), "yyyy-MM")
    newest = r.groupBy(month.alias("month"), "provider").agg(F.max("provider_version").alias("provider_version"))
    return newest.withColumn("config_hash", revisions.config_hash_of(F.concat("provider", "provider_version")))


@query
def ck_inputs_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The cache keys of inputs and of the index for each month's providers."""
    return revisions.keys_of(_runs_by_month(spark, folder), "month", 3, 5, 7)


@query
def ck_version_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The key of each provider version, whose program is stood for by its name; skipped ones can't be read."""
    r = table(spark, folder, "provider_results").groupBy("provider", "provider_version").agg(F.bool_or(F.col("run_state") != "SKIPPED").alias("readable"))
    program = F.when(F.col("readable"), F.encode(F.concat("provider", "provider_version"), "UTF-8"))
    return r.select("provider", "provider_version", revisions.version_key_of(program, F.concat(F.lit("config of "), "provider")).alias("key"))


@query
def ck_restore_plan(spark: SparkSession, folder: str) -> DataFrame:
    """How each month starts: from the index if its providers are those of the month before, from inputs if one is."""
    m = _runs_by_month(spark, folder)
    keys = m.groupBy("month").agg(F.array_sort(F.collect_set(F.concat_ws("@", "provider", "provider_version"))).alias("now"))
    prior = keys.select(F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), 1), "yyyy-MM").alias("month"), F.col("now").alias("was"))
    both = keys.join(prior, "month", "left")
    hit, part = F.coalesce(F.col("now") == F.col("was"), F.lit(False)), F.coalesce(F.arrays_overlap("now", "was"), F.lit(False))
    return both.select("month", revisions.restore_plan(hit, part).alias("plan"))


@query
def ck_comparable(spark: SparkSession, folder: str) -> DataFrame:
    """Providers whose newest version is the same before and since October 2025."""
    r = table(spark, folder, "provider_results")

    def state(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy("provider").agg(F.max("provider_version").alias("provider_version"))
        return newest.select("provider", F.lit(4).alias("ruleset"), "provider_version", revisions.config_hash_of(F.col("provider")).alias("config_hash"))

    return revisions.comparable(state(r.where(F.col("cached_at") < "2025-10-01")), state(r.where((F.col("cached_at") >= "2025-10-01") & (F.col("provider") != "ruff"))))


@query
def ck_readable(spark: SparkSession, folder: str) -> DataFrame:
    """Results whose provider's major version is the current one, 2, or the one before."""
    r = table(spark, folder, "provider_results", "content_hash", "provider", "provider_version").distinct()
    major = F.substring_index("provider_version", ".", 1).cast("int")
    return r.groupBy("provider").agg(F.count_if(revisions.readable_column(major, 2)).alias("readable"), F.count("*").alias("n"))


@query
def ck_fatal_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that end a strict check, by provider."""
    r = providers.latest(table(spark, folder, "provider_results"))
    return r.groupBy("provider").agg(F.count_if(revisions.fatal(F.col("run_state"), True)).alias("strict"), F.count_if(revisions.fatal(F.col("run_state"), False)).alias("lenient"))


# Verbs


def _session(spark: SparkSession, folder: str) -> pipeline.Session:
    c = _comments(spark, folder)
    return pipeline.Session(_sources(spark, folder), c, _walked(spark, folder), baseline=_accepted(spark, folder), external=_findings(spark, folder).drop("found_at"))


@query
def ck_check(spark: SparkSession, folder: str) -> DataFrame:
    """The verb check: markers and all findings of tools together, severities resolved, merged per comment, suppression flagged."""
    checked = pipeline.check(_session(spark, folder), {"gitleaks": "warning"}, off=(*rot.DETECTORS, "candidates"), severities=MARKER_SEVERITIES)
    return checked.groupBy("origin", "severity", "suppressed_by").agg(F.count("*").alias("n"), F.count("comment_id").alias("attached"))


@query
def ck_summary(spark: SparkSession, folder: str) -> DataFrame:
    checked = pipeline.check(_session(spark, folder), off=(*rot.DETECTORS, "candidates"))
    return pipeline.summary(checked, _comments(spark, folder))


@query
def ck_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The verb candidates: the twenty markers to act on first."""
    return pipeline.candidates(_session(spark, folder), 20, off=(*rot.DETECTORS, "candidates")).select("rank", "file_path", F.col("span.start_line").alias("line"), "provider_rule_id", "severity")


@query
def cx_context(spark: SparkSession, folder: str) -> DataFrame:
    """The verb context, for every comment: its findings and the length of the code that it is about."""
    session = _session(spark, folder)
    rows = pipeline.context(session, None, _findings(spark, folder), with_code=True)
    named = F.array_join(F.transform(F.coalesce("findings", F.array().cast("array<struct<provider_rule_id:string,category:string,severity:string,message:string>>")), lambda f: f["provider_rule_id"]), ",")
    return rows.select("id", named.alias("rules"), F.octet_length("code").alias("code_bytes"))


@query
def cx_report(spark: SparkSession, folder: str) -> DataFrame:
    """The verb report: SARIF, Markdown and JSON lines written; how many results the log holds, and the verdict."""
    out = _folder(spark)
    f = _findings(spark, folder).withColumn("suppressed_by", F.when(F.col("category") == "doc_style", "baseline"))
    verdict = pipeline.report(f, _comments(spark, folder), providers.latest(table(spark, folder, "provider_results")), out, "error")
    results = spark.read.text(f"{out}/sarif").where(F.col("value").contains('"ruleId"')).agg(F.count("*").alias("results"))
    rows = spark.read.text(f"{out}/markdown", wholetext=False).where(F.col("value").startswith("| ")).agg(F.count("*").alias("rows"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(results).join(one(rows), "one").join(one(verdict), "one").select("results", "rows", "verdict", "code")


def _first_line_comment(c: DataFrame) -> DataFrame:
    """The first `#` or `//` line comment of each file."""
    line = c.where("kind = 'line' AND (raw_text LIKE '#%' OR raw_text LIKE '//%')")
    return line.groupBy("path").agg(F.min_by(F.struct("span", "raw_text"), F.struct("span.start_byte", "id")).alias("c")).select("path", "c.*")


@query
def up_edited(spark: SparkSession, folder: str) -> DataFrame:
    """The first line comment of each file exchanged for another, where the table's text stands at its place."""
    w = _sources(spark, folder).where("text IS NOT NULL AND language IS NOT NULL")
    mark = F.when(F.col("raw_text").startswith("#"), "# checked").otherwise("// checked")
    todo = _first_line_comment(_comments(spark, folder)).select("path", "span", mark.alias("new_text"))
    return edit.apply_edits(w, todo).select("path", "ok", "applied", F.sha2("new_text", 256).alias("hash"))


@query
def up_removed(spark: SparkSession, folder: str) -> DataFrame:
    """The first line comment of each file taken out; behaving kinds are protected."""
    w = _sources(spark, folder).where("text IS NOT NULL AND language IS NOT NULL")
    first = _first_line_comment(_comments(spark, folder)).where(~edit.protected(F.lit("line"), F.lit(False)))
    return edit.apply_edits(w, first.select("path", "span", F.lit("").alias("new_text"))).select("path", "ok", "applied", F.sha2("new_text", 256).alias("hash"))


@query
def up_protected(spark: SparkSession, folder: str) -> DataFrame:
    """Comments by kind: how many an edit is refused for, and how many even when significant ones may be edited."""
    c = _comments(spark, folder)
    kept = lambda allowed: F.count_if(edit.protected(F.col("kind"), F.lit(allowed)))
    return c.groupBy("kind").agg(kept(False).alias("refused"), kept(True).alias("refused_anyway"))


# Sinks


@query
def sk_terminal(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.terminal(_findings(spark, folder)).select("file_path", F.sha2("value", 256).alias("hash"))


@query
def sk_totals(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.report_totals(_findings(spark, folder))


@query
def sk_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index written and opened again: how often each word stands in the comments."""
    out = _folder(spark)
    c = _comments(spark, folder)
    sinks.persist_index(c, _findings(spark, folder), table(spark, folder, "comment_vectors"), out)
    words = sinks.open_index(spark, out)["words"]
    return words.groupBy("word").agg(F.sum("times").alias("times"), F.count("*").alias("comments"))


@query
def sk_cached_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results stored in two deliveries, and the latest complete one of each key read back."""
    out = _folder(spark)
    r = table(spark, folder, "provider_results")
    sinks.store_results(r.where(F.col("cached_at") < "2025-10-01"), out)
    sinks.store_results(r.where(F.col("cached_at") >= "2025-10-01"), out)
    return providers.latest(spark.read.parquet(out)).select("content_hash", "provider", "provider_version", "run_state")


@query
def sk_sarif_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Whole SARIF results, as text."""
    return sinks.sarif_results(_findings(spark, folder))


@query
def pr_sarif(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of SARIF documents, of which each file's results make one."""
    f = _findings(spark, folder).where("file_path IS NOT NULL").select("file_path", "finding_id")
    rows = sinks.sarif_results(_findings(spark, folder)).join(f, "finding_id")
    docs = rows.groupBy(F.col("file_path").alias("document_of")).agg(F.concat(F.lit('{"runs":[{"results":['), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}]}")).alias("document"))
    found = providers.from_sarif(docs)
    return found.groupBy("document_of", "canonical_rule_id", "severity_native", "file_path", "line").agg(F.count("*").alias("n"))


ESLINT_RULES = {"D417": "jsdoc/check-param-names", "D103": "require-jsdoc", "2148": "no-undef", "generic-api-key": "no-warning-comments"}


@query
def pr_by_tool(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all tools, each by its own manifest, from documents in the tool's own shape."""
    r = providers.latest(table(spark, folder, "provider_results")).where("provider IS NOT NULL")
    rows = F.from_json("findings_json", "array<struct<code:string,line:int,file:string>>")
    valid = r.withColumn("rows", F.when(F.try_parse_json("findings_json").isNotNull(), rows)).where("rows IS NOT NULL")
    code = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in ESLINT_RULES.items() for y in kv]), x["code"]), x["code"])
    shapes: dict[str, Column] = {
        "ruff": F.to_json(F.transform("rows", lambda x: F.struct(x["code"].alias("code"), x["file"].alias("filename"), F.struct(x["line"].alias("row")).alias("location")))),
        "shellcheck": F.to_json(F.transform("rows", lambda x: F.struct(x["code"].alias("code"), x["file"].alias("file"), x["line"].alias("line")))),
        "gitleaks": F.to_json(F.transform("rows", lambda x: F.struct(x["code"].alias("RuleID"), x["file"].alias("File"), x["line"].alias("StartLine")))),
        "eslint": F.to_json(F.transform("rows", lambda x: F.struct(x["file"].alias("filePath"), F.array(F.struct(code(x).alias("ruleId"), x["line"].alias("line"))).alias("messages")))),
    }
    parts = []
    for manifest in providers.BUILT_IN:
        documents = valid.where(F.col("provider") == manifest.id).select("content_hash", "provider_version", shapes[manifest.id].alias("document"))
        parts.append(providers.normalise(documents, manifest).select("content_hash", "provider_version", "provider_rule_id", "category", "file_path", "line"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def st_late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """First deliveries of findings by day, from a stream that reads the table to its end; days are closed by a lateness of two days."""
    from marginalia.streaming.incremental import counts_by_time, each_batch

    plain = table(spark, folder, "findings", "finding_id", "origin", "found_at")
    out = _folder(spark)
    plain.withColumn("found_at", F.col("found_at").cast("timestamp")).write.parquet(f"{out}/in")
    stream = spark.readStream.schema("finding_id BIGINT, origin STRING, found_at TIMESTAMP").parquet(f"{out}/in")
    counted = counts_by_time(stream, "found_at", "1 day", "2 days", ["origin"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    each_batch(counted, write, f"{out}/state", "append").awaitTermination()
    closed = spark.read.schema("start TIMESTAMP, origin STRING, n BIGINT").parquet(f"{out}/counts")
    return closed.select(F.col("start").cast("date").cast("string").alias("day"), "origin", "n")
