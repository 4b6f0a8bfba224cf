"""Registered queries over a data folder, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.functions.places import utf16_length
from marginalia.operators import classify, edit, extract, findings, identity, issues, providers, rank, revisions, rot, search, suppress
from marginalia.schema import categories
from marginalia.sources import files, sinks
from marginalia.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORDS = "lease registry scanner"
OVERRIDES = {"ruff:D417": "critical", "todo_format": "warning", "gitleaks": "error"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments")


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "findings")


def _walked(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The columns of walked_files with one row for each path, the latest; only the columns asked for are read.

    Texts are asked for where work per row is heavy, so a small table is dealt out to all cores.
    """
    return files.latest(table(spark, folder, "walked_files", *dict.fromkeys(["path", "walked_at", *columns]), spread="text" in columns)).drop("walked_at")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """path, language, text of the latest files; language by path and text."""
    w = _walked(spark, folder, "text")
    return w.select("path", files.language(F.col("path"), F.col("text")).alias("language"), "text")


@query
def flagship_ranked_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty findings to act on first: merged, with severities resolved, ranked."""
    f = findings.resolve_severity(_findings(spark, folder), categories(spark))
    merged = findings.merge_overlaps(f)
    top = rank.actionable(merged, _comments(spark, folder), 50)
    return top.select("rank", "finding_id", "file_path", "category", "severity", F.array_join("also_from", ",").alias("also_from"), "merged")


@query
def fn_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _comments(spark, folder).select("id", T.normalize(F.col("raw_text")).alias("normal"), T.fingerprint(F.col("raw_text")).alias("print"))


@query
def fn_content_hash(spark: SparkSession, folder: str) -> DataFrame:
    h = T.content_hash(F.col("raw_text"))
    return _comments(spark, folder).select("id", h.alias("hash"), (h == F.col("content_hash")).alias("same"))


@query
def fn_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents", "text").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


@query
def fn_hash_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The bucket of the FNV-1a hash of each distinct word of the comments."""
    words = _comments(spark, folder).select(F.explode(F.array_distinct(T.tokens(F.col("raw_text")))).alias("token")).distinct()
    return words.select("token", T.fnv1a(F.col("token")).alias("fnv"), (T.fnv1a(F.col("token")) % 64).alias("bucket"))


@query
def fn_hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Hash embeddings of all documents, one row for each bucket that isn't zero."""
    e = V.hash_embedding(table(spark, folder, "documents", "doc_id", "text", spread=True), "doc_id", "text")
    return e.select("doc_id", F.posexplode("vector").alias("bucket", "x")).where("x > 0").select("doc_id", "bucket", F.round("x", 6).alias("x"))


@query
def fn_first_line(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("raw_text")
    return _comments(spark, folder).select("id", T.first_line(t).alias("first"), T.csv_field(t).alias("csv"), T.markdown_cell(t).alias("cell"))


@query
def fn_utf16_length(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", utf16_length(F.col("text")).alias("units"), F.octet_length("text").cast("bigint").alias("bytes"))


@query
def fn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of all usable vectors of one model with a query's embedding."""
    v = table(spark, folder, "comment_vectors").where("size(vector) = 64 AND model_version = 'det64/1'")
    v = v.where(F.forall("vector", lambda x: ~F.isnan(x))).select("content_hash", "vector").distinct()
    wanted = F.array(*[F.lit(x) for x in search.embed(WORDS)])
    return v.select("content_hash", F.round(V.cosine(F.col("vector"), wanted), 5).alias("cosine"))


@query
def sc_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Language and the generated-file test for all files."""
    return _walked(spark, folder, "text").select("path", files.language(F.col("path"), F.col("text")).alias("language"), files.is_generated(F.col("text")).alias("generated"))


@query
def sc_ignored(spark: SparkSession, folder: str) -> DataFrame:
    p = _walked(spark, folder).select("path")
    return files.universe(p, ("node_modules/", "*.min.js", "/harbor-mono/tests/", "!/harbor-mono/tests/*.py"))


@query
def sc_changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between the files walked up to mid-2025 and all of them."""
    w = table(spark, folder, "walked_files", "path", "content_hash", "walked_at")

    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy("path").agg(F.max_by("content_hash", "walked_at").alias("content_hash"))

    return revisions.changed_files(state(w.where(F.col("walked_at") < "2025-07-01")), state(w))


@query
def ex_kind(spark: SparkSession, folder: str) -> DataFrame:
    c = _comments(spark, folder)
    k = classify.kind(F.col("raw_text"), F.coalesce("language", F.lit("")), F.col("span.start_line"), F.col("kind") == "docstring")
    return c.select("id", k.alias("kind"))


@query
def ex_markers(spark: SparkSession, folder: str) -> DataFrame:
    return _comments(spark, folder).select("id", F.array_join(classify.markers(F.col("raw_text"), ("Reading", "Callers")), ",").alias("markers"))


@query
def ex_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Every comment of every readable file: kind, symbol, place and text hash."""
    found = extract.comments(_sources(spark, folder))
    return found.select("path", "kind", "bound_symbol", F.col("span.start_byte").alias("start_byte"), F.col("span.end_line").alias("end_line"), "content_hash")


@query
def ex_definitions(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.definitions(_sources(spark, folder))
    return found.select("path", "symbol", F.col("span.start_line").alias("line"), F.array_join("params", ",").alias("params"), "has_return")


@query
def ex_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """Line comments right below each other, merged, over the comments of all files."""
    c = _comments(spark, folder).select("path", "span", "raw_text", "kind", "bound_symbol", "bound_node_range", "id")
    first = c.groupBy("path", "span.start_byte").agg(F.min_by(F.struct("span", "raw_text", "kind", "bound_symbol", "bound_node_range", "id"), "id").alias("c")).select("path", "c.*")
    merged = extract.coalesce_lines(first.withColumn("own_line", F.lit(True)).withColumn("joint", F.lit("\n")))
    return merged.select("path", "id", "kind", F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line"), F.sha2("raw_text", 256).alias("hash"))


@query
def rt_intent(spark: SparkSession, folder: str) -> DataFrame:
    return rot.with_intent(_comments(spark, folder)).select("id", "intent")


@query
def rt_stale_references(spark: SparkSession, folder: str) -> DataFrame:
    c = rot.with_intent(_comments(spark, folder))
    return rot.stale_references(c, rot.symbols(c))


@query
def rt_missing_paths(spark: SparkSession, folder: str) -> DataFrame:
    c = rot.with_intent(_comments(spark, folder))
    return rot.missing_paths(c, _walked(spark, folder).select("path")).select("comment_id", "message")


@query
def rt_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return rot.symbols(_comments(spark, folder))


def _blame(c: DataFrame) -> DataFrame:
    """The commits of all comments as blame of their lines."""
    dated = c.where("git.committed_unix IS NOT NULL")
    return dated.select("path", F.explode(F.sequence("span.start_line", "span.end_line")).alias("line"), "git.commit_id", "git.author", "git.email", "git.committed_unix")


@query
def rt_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Comments far older than what else was committed in the code that they are about."""
    c = _comments(spark, folder)
    return rot.drift(c, _blame(c)).select("comment_id", "message")


@query
def rt_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation that claims what the signature doesn't hold."""
    w = _sources(spark, folder)
    claims = rot.contracts(rot.with_intent(_comments(spark, folder)))
    return rot.signature_findings(claims, extract.definitions(w).where("params IS NOT NULL")).select("comment_id", "message")


@query
def mp_latest_commit(spark: SparkSession, folder: str) -> DataFrame:
    c = _comments(spark, folder)
    return rot.latest_in_lines(c, _blame(c), "span").select("id", "commit.committed_unix")


@query
def jn_attach(spark: SparkSession, folder: str) -> DataFrame:
    return findings.attach(_findings(spark, folder), _comments(spark, folder)).select("finding_id", "comment_id")


@query
def jn_unattached(spark: SparkSession, folder: str) -> DataFrame:
    return findings.unattached(_findings(spark, folder), _comments(spark, folder)).select("finding_id")


@query
def jn_in_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of comment-scoped tools that lie in a comment, by tool."""
    inside = findings.in_comments(_findings(spark, folder), _comments(spark, folder))
    return inside.groupBy("origin").agg(F.count("*").alias("n"))


@query
def jn_in_scope(spark: SparkSession, folder: str) -> DataFrame:
    return findings.in_scope(_findings(spark, folder), _walked(spark, folder)).select("finding_id")


@query
def jn_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Files that each tool has to be run on, because no complete result is cached."""
    results = table(spark, folder, "provider_results")
    tools = F.broadcast(spark.createDataFrame([("ruff",), ("shellcheck",), ("eslint",), ("gitleaks",)], "provider STRING"))
    versions = F.broadcast(results.groupBy("provider").agg(F.max("provider_version").alias("provider_version")))
    contents = _walked(spark, folder, "content_hash").where("content_hash IS NOT NULL").select("content_hash").distinct()
    needed = contents.withColumn("provider", F.explode(F.array(*[F.lit(x) for x in ("ruff", "shellcheck", "eslint", "gitleaks")])))
    needed = needed.join(tools, "provider", "left_semi").join(versions, "provider")
    return providers.missing(needed.select("content_hash", "provider", "provider_version"), results)


@query
def jn_tiered_match(spark: SparkSession, folder: str) -> DataFrame:
    """Comments whose id is divisible by 100 matched with all others: by text, symbol and fingerprint, fingerprint."""
    c = _comments(spark, folder).withColumn("vector", F.lit(None).cast("array<float>"))
    return identity.match(c.where("id % 100 = 0"), c.where("id % 100 <> 0"), by_vector=False)


@query
def ag_merge_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    merged = findings.merge_overlaps(_findings(spark, folder))
    return merged.select("finding_id", "merged", F.array_join("also_from", ",").alias("also_from"))


@query
def ag_merge_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Shipping intervals of five days per supplier and return flag, merged where they overlap."""
    li = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    spans = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.col("l_suppkey").cast("string").alias("file_path"), F.col("l_returnflag").alias("category"),
        F.struct(day.alias("start_byte"), (day + 5).alias("end_byte"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")).alias("span"), F.col("l_linestatus").alias("origin"),
        F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 20, "error").otherwise("info").alias("severity"), F.lit("r").alias("provider_rule_id"), F.lit(None).cast("array<string>").alias("also_from"),
    )
    return findings.merge_overlaps(spans).select("finding_id", "file_path", "category", "merged", F.array_join("also_from", ",").alias("also_from"))


@query
def ag_severity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return findings.severity_histogram(_findings(spark, folder))


@query
def ag_resolved_severities(spark: SparkSession, folder: str) -> DataFrame:
    f = findings.resolve_severity(_findings(spark, folder), categories(spark), OVERRIDES)
    return f.select("finding_id", "severity", "severity_rank", T.native_severity(F.col("origin"), F.col("severity_native")).alias("native"))


@query
def ag_rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return findings.rule_counts(_findings(spark, folder))


@query
def ag_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return findings.by_file(_findings(spark, folder))


@query
def ag_run_states(spark: SparkSession, folder: str) -> DataFrame:
    """The state of all runs of each provider version, from their documents."""
    r = providers.latest(table(spark, folder, "provider_results"))
    n = F.coalesce(F.size(F.from_json("findings_json", "array<struct<code:string>>")), F.lit(0))
    return findings.fold_run_states(r.withColumn("run_state", providers.run_state(F.col("findings_json"), n)), "provider")


@query
def ag_verdict(spark: SparkSession, folder: str) -> DataFrame:
    runs = providers.latest(table(spark, folder, "provider_results"))
    return findings.verdict(_findings(spark, folder), runs, "critical")


@query
def ag_exit_code(spark: SparkSession, folder: str) -> DataFrame:
    return findings.exit_code(_findings(spark, folder), _comments(spark, folder), "critical")


@query
def ag_set_hash(spark: SparkSession, folder: str) -> DataFrame:
    return providers.set_hash(_walked(spark, folder, "tree", "content_hash").where("content_hash IS NOT NULL"), "tree")


@query
def wn_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each comment among those of the same identity."""
    return identity.ordinals(_comments(spark, folder)).select("id", "ordinal")


@query
def wn_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of the longest documents."""
    d = table(spark, folder, "documents", "doc_id", "n_chars")
    return rank.page(d, [F.desc("n_chars"), F.asc("doc_id")], 20, 40)


@query
def wn_budget_page(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in order of id, from the eleventh, as long as their lengths fit 20,000 characters."""
    d = table(spark, folder, "documents", "doc_id", "n_chars")
    return rank.page(d, [F.asc("doc_id")], 100, 10, "n_chars", 20_000)


@query
def wn_keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    top = search.keyword(table(spark, folder, "documents", "doc_id", "text", spread=True), WORDS, 20, "doc_id", "text")
    return top.select("id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "comment_vectors").where("size(vector) = 64 AND model_version = 'det64/1'")
    return v.select(F.col("content_hash").alias("id"), "vector").distinct()


@query
def wn_nearest(spark: SparkSession, folder: str) -> DataFrame:
    top = search.nearest(_vectors(spark, folder), search.embed(WORDS), 20)
    return top.select("id", F.round("distance", 5).alias("distance"), "rank")


@query
def wn_fused(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by words and by length, fused by reciprocal ranks."""
    d = table(spark, folder, "documents", "doc_id", "text", "n_chars", spread=True)
    words = search.keyword(d, WORDS, 100, "doc_id", "text").select("id", "rank")
    order = [F.desc("n_chars"), F.asc("doc_id")]
    longest = d.orderBy(*order).limit(100).select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    return rank.fuse([words, longest], 20).select("id", F.round("score", 9).alias("score"))


def _lines_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of their users' files."""
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type", "value")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", F.col("user_id").cast("string").alias("path"), line.alias("line"), "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("level"))


@query
def sp_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Views and clicks that an earlier error of the same level disables and no purchase or signup enables again."""
    e = _lines_of_events(spark, folder)
    f = e.where("event_type IN ('view', 'click')").select(
        F.col("event_id").alias("finding_id"), F.col("path").alias("file_path"), F.struct(F.col("line").alias("start_line")).alias("span"), F.concat(F.lit("e:"), "event_type").alias("provider_rule_id"),
        F.col("event_type").alias("canonical_rule_id"), F.col("level").alias("category"), F.lit("e").alias("origin"),
    )
    verb = F.when(F.col("event_type") == "error", "disable").otherwise("enable")
    targets = F.when(F.col("event_type") == "signup", F.array().cast("array<string>")).otherwise(F.array("level"))
    d = e.where("event_type IN ('error', 'purchase', 'signup')").select(F.col("event_id").alias("directive_id"), "path", "line", verb.alias("verb"), targets.alias("targets"))
    return suppress.suppressed_by_directive(f, d)


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    old = _findings(spark, folder).where(F.col("found_at") < "2025-10-01")
    return suppress.accept(old, _comments(spark, folder)).withColumn("reason", F.lit("known")).withColumn("date", F.lit("2025-10-01"))


@query
def st_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline of the findings up to October 2025."""
    return _accepted(spark, folder)


@query
def st_new_findings(spark: SparkSession, folder: str) -> DataFrame:
    return suppress.new_findings(_findings(spark, folder), _comments(spark, folder), _accepted(spark, folder)).select("finding_id")


@query
def st_pruned_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """What remains of the baseline when only findings since September 2025 are left."""
    left = _findings(spark, folder).where(F.col("found_at") >= "2025-09-01")
    return suppress.prune(_accepted(spark, folder), left, _comments(spark, folder))


@query
def sp_export(spark: SparkSession, folder: str) -> DataFrame:
    return suppress.export_directives(_findings(spark, folder))


@query
def pr_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the documents of all tools, one row each, by shellcheck's manifest."""
    r = providers.latest(table(spark, folder, "provider_results"))
    rows = providers.normalise(r.select("content_hash", "provider", "provider_version", F.col("findings_json").alias("document")), providers.SHELLCHECK)
    return rows.select("content_hash", "provider", "provider_version", "nth", "provider_rule_id", "category", "file_path", "line")


@query
def is_to_file(spark: SparkSession, folder: str) -> DataFrame:
    """Markers without an issue: tokens that only appear since October 2025."""
    c = _comments(spark, folder)
    old = issues.marker_tokens(c.where(F.col("scanned_at") < "2025-10-01")).select("token").distinct()
    ledger = old.select("token", F.sha2("token", 256).alias("id"), (F.length("token") % 2 == 0).alias("closed"))
    return issues.to_file(issues.marker_tokens(c), ledger)


@query
def is_resolved(spark: SparkSession, folder: str) -> DataFrame:
    c = _comments(spark, folder)
    old = issues.marker_tokens(c.where(F.col("scanned_at") < "2025-10-01")).select("token").distinct()
    ledger = old.select("token", F.sha2("token", 256).alias("id"), (F.length("token") % 2 == 0).alias("closed"))
    return issues.resolved(issues.marker_tokens(c), ledger).select("path", "start_byte", F.array_join("issues", ",").alias("issues"))


@query
def up_strip_report(spark: SparkSession, folder: str) -> DataFrame:
    return edit.strip_report(edit.removal_plan(_comments(spark, folder), ("docstring",)))


@query
def up_strip_files(spark: SparkSession, folder: str) -> DataFrame:
    """How many comments stripping takes from each file, and from which lines."""
    rows = edit.strip_files(edit.removal_plan(_comments(spark, folder)))
    return rows.select("path", "removed", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query
def up_stripped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All files without their comments, as far as the code stays the same."""
    w = _sources(spark, folder).where("text IS NOT NULL AND language IS NOT NULL")
    plan = edit.removal_plan(extract.comments(w))
    return edit.strip(w, plan).select("path", "removed", "failed", F.sha2("new_text", 256).alias("hash"))


@query
def sk_csv(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.csv_rows(_findings(spark, folder))


@query
def sk_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.markdown_rows(_findings(spark, folder))


@query
def sk_sarif(spark: SparkSession, folder: str) -> DataFrame:
    """SARIF results, and the fields read back from them."""
    rows = sinks.sarif_results(_findings(spark, folder))
    return rows.select("finding_id", F.get_json_object("value", "$.ruleId").alias("rule"), F.get_json_object("value", "$.level").alias("level"), F.get_json_object("value", "$.locations[0].physicalLocation.region.startLine").cast("int").alias("line"))


@query
def sk_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    rows = sinks.jsonl_rows(_comments(spark, folder)).where("path IS NOT NULL")
    return rows.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.markers[0]").alias("marker"))


@query
def sk_latest_results(spark: SparkSession, folder: str) -> DataFrame:
    """Provider results with one row for each key, the latest: an upsert of all deliveries."""
    r = table(spark, folder, "provider_results")
    early, late = r.where(F.col("cached_at") < "2025-10-01"), r.where(F.col("cached_at") >= "2025-10-01")
    keys = ["content_hash", "provider", "provider_version"]
    return providers.upsert(early, late, keys, "cached_at").select(*keys, "cached_at")


@query
def st_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type, counted by a stream that reads the table to its end."""
    from uuid import uuid4

    from marginalia.plans.lineage import shared_folder
    from marginalia.streaming.incremental import counts_by_time

    events = table(spark, folder, "events", "event_id", "ts", "event_type")
    stream = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parquet*")
    stream = stream.select(*[F.col(c).cast("timestamp") if c == "ts" else F.col(c) for c in events.columns])
    counted = counts_by_time(stream, "ts", "1 day", "3650 days", ["event_type"])
    out = f"{shared_folder(spark)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts")

    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts").select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n")
