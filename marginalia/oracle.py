"""The registered queries in SQL, for DuckDB on the same tables, written independently of the Spark plans."""

from __future__ import annotations

from marginalia.operators.classify import CONTRACT_MARKS, DIRECTIVE_WORD, DIRECTIVES, LEVELS, LICENSE_WORDS, LOG_WORDS, MARKERS
from marginalia.operators.rot import PATH_EXTENSIONS
from marginalia.operators.search import embed
from marginalia.queries import WORDS
from marginalia.schema import CATEGORY_SEVERITY, SEVERITIES
from marginalia.sources.files import EXTENSIONS, GENERATED


def _quoted(values: object) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _case(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _any(column: str, pieces: object) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, p.replace("'", "''")) for p in pieces) + ")"


def _head(marks: object) -> str:
    """Whether a mark stands within the first 8 KiB of a text."""
    at = "instr(lower(text), '{0}')"
    return "(" + " OR ".join(f"({at.format(m)} > 0 AND strlen(substr(text, 1, ({at.format(m)} - 1)::INT)) + {len(m)} <= 8192)" for m in marks) + ")"


_RANK = f"(list_position([{_quoted(SEVERITIES)}], severity) - 1)"
_ANCHOR = _case("category", CATEGORY_SEVERITY)
_WALKED = """(SELECT path, w.tree AS tree, w.language AS language, w.text AS text, w.content_hash AS content_hash FROM (
  SELECT path, arg_max({'tree': tree, 'language': language, 'text': text, 'content_hash': content_hash}, walked_at) AS w FROM walked_files GROUP BY path))"""
_NORMAL = r"""trim(regexp_replace(trim(lower(regexp_replace(array_to_string(list_transform(regexp_split_to_array(raw_text, '\r?\n'),
  lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(x), '^(?:/\*\*|/\*|///|//|#)', ''), '\*/$', ''), '^[\s"'']+|[\s"'']+$', '', 'g'), '^\*+\s*', '')
  ), ' '), '\s+', ' ', 'g'))), '[.,;:!? ]+$', ''))"""
_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(hex(encode({0}))) + 1, 2), lambda i: ('0x' || hex(encode({0}))[i:i + 1])::BIGINT)),
  lambda a, b: (xor(a, b) * 16777619) & 4294967295)"""
_MARK = r"(?m)^[\s#/*<>!\-;%\"'']*({})(?:[^\p{{L}}\p{{N}}_]|$)"


def _marks(words: object) -> str:
    return _MARK.format("|".join(sorted(words, key=lambda w: (-len(w), w))))


_INNER = r"""trim(CASE WHEN starts_with(trim(raw_text), '/**') THEN regexp_replace(regexp_replace(trim(raw_text), '^/\*\*', ''), '\*/$', '')
  WHEN starts_with(trim(raw_text), '/*') THEN regexp_replace(regexp_replace(trim(raw_text), '^/\*', ''), '\*/$', '')
  WHEN starts_with(trim(raw_text), '//') THEN regexp_replace(trim(raw_text), '^//', '')
  WHEN starts_with(trim(raw_text), '#') THEN regexp_replace(trim(raw_text), '^#', '') ELSE trim(raw_text) END)"""
_KIND = f"""CASE WHEN kind = 'docstring' THEN 'docstring' WHEN span.start_line = 1 AND starts_with(raw_text, '#!') THEN 'shebang'
  WHEN language = 'python' AND span.start_line <= 2 AND regexp_matches(raw_text, 'coding[:=]\\s*[-\\w.]+') THEN 'encoding-decl'
  WHEN {" OR ".join(f"starts_with({_INNER}, '{d}')" for d in (f"{DIRECTIVE_WORD}:", *DIRECTIVES))} THEN 'directive'
  WHEN language IN ('typescript', 'javascript') AND starts_with(raw_text, '/**') THEN 'docstring'
  WHEN span.start_line <= 15 AND {_any("lower(raw_text)", LICENSE_WORDS)} THEN 'license'
  WHEN starts_with(raw_text, '/*') OR contains(raw_text, chr(10)) THEN 'block' ELSE 'line' END"""
_LOWER_WORDS = r"regexp_split_to_array(lower(raw_text), '[^\p{L}\p{N}]+')"
_INTENT = f"""CASE WHEN bound_symbol IS NOT NULL AND (kind = 'docstring' OR {_any("raw_text", CONTRACT_MARKS)}) THEN 'doc_contract'
  WHEN coalesce(len(markers), 0) > 0 OR regexp_matches(raw_text, '{_marks(MARKERS)}') THEN 'directive'
  WHEN list_has_any({_LOWER_WORDS}, [{_quoted(LEVELS)}]) AND list_has_any({_LOWER_WORDS}, [{_quoted(LOG_WORDS)}]) THEN 'log_level_reference'
  ELSE 'explanatory_note' END"""
_CLUSTERS = """clusters AS (
  SELECT *, sum(starts) OVER (PARTITION BY file_path, category ORDER BY s, e, finding_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (
    SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY file_path, category ORDER BY s, e, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM spans)
), merged AS (
  SELECT file_path, category, cluster, arg_min(finding_id, row(-r, file_path, l, s, provider_rule_id, finding_id)) AS finding_id,
    arg_min(origin, row(-r, file_path, l, s, provider_rule_id, finding_id)) AS best_origin,
    list_sort(list_distinct(list_concat(list(origin), coalesce(flatten(list(also_from)), [])))) AS origins, count(*) AS merged FROM clusters GROUP BY ALL
)"""
_MERGED = "array_to_string(list_sort(list_filter(origins, lambda x: x IS NOT NULL AND x <> best_origin)), ',')"


def _spans(rank: str) -> str:
    return f"""spans AS (SELECT finding_id, file_path, category, span.start_byte AS s, span.end_byte AS e, span.start_line AS l, origin, provider_rule_id, also_from, {rank} AS r FROM findings)"""


_ANCHORED = "coalesce(list_position([" + _quoted(SEVERITIES) + f"], {_ANCHOR}) - 1, -1)"
_BLAME = """blame AS (SELECT path, unnest(range(span.start_line, span.end_line + 1)) AS line, git.commit_id AS commit_id, git.committed_unix AS at FROM comments WHERE git.committed_unix IS NOT NULL)"""
_LATEST = """latest AS (SELECT r.* FROM (SELECT arg_max(p, row(cached_at, findings_json, run_state)) AS r FROM provider_results p GROUP BY content_hash, provider, provider_version))"""
_TOUCH = """(coalesce(f.target_symbol = c.bound_symbol, false) OR (c.span.start_byte <= f.span.start_byte AND f.span.start_byte < c.span.end_byte)
  OR (c.span.start_byte < f.span.end_byte AND f.span.start_byte < c.span.end_byte))"""
_ATTACHED = f"""attached AS (SELECT f.finding_id, arg_min(c.id, row(c.span.start_byte, c.id)) AS comment_id FROM findings f JOIN comments c ON f.file_path = c.path AND {_TOUCH} GROUP BY f.finding_id)"""
_KEYS = """keys AS (SELECT finding_id, found_at, bound_symbol, cosmetic_fingerprint AS fingerprint, unnest(list_distinct([provider_rule_id, canonical_rule_id])) AS rule, provider_rule_id
  FROM findings f JOIN comments c ON f.comment_id = c.id WHERE cosmetic_fingerprint IS NOT NULL),
  accepted AS (SELECT DISTINCT bound_symbol, fingerprint, provider_rule_id AS rule FROM keys WHERE found_at < TIMESTAMP '2025-10-01')"""
_MATCHED = "k.bound_symbol IS NOT DISTINCT FROM a.bound_symbol AND k.fingerprint = a.fingerprint AND k.rule = a.rule"
_MARKED = """marked AS (SELECT id, path, span.start_byte AS start_byte, scanned_at, coalesce(bound_symbol, '<none>') || '|' || kind || '|' || marker AS token
  FROM (SELECT *, unnest(markers) AS marker FROM comments)),
  ledger AS (SELECT DISTINCT token, sha256(token) AS issue, length(token) % 2 = 0 AS closed FROM marked WHERE scanned_at < TIMESTAMP '2025-10-01')"""
_QUERY = WORDS.split()
_BM25 = f"""words AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
  counted AS (SELECT doc_id, len(w) AS length, {", ".join(f"len(list_filter(w, lambda x: x = '{q}'))::DOUBLE AS t{i}" for i, q in enumerate(_QUERY))} FROM words),
  corpus AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(_QUERY)))} FROM counted),
  scored AS (SELECT doc_id AS id, {" + ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(_QUERY)))} AS score
    FROM counted, corpus WHERE {" OR ".join(f"t{i} > 0" for i in range(len(_QUERY)))})"""
_VECTOR = "[" + ", ".join(repr(float(x)) for x in embed(WORDS)) + "]::DOUBLE[]"
_USABLE = "SELECT DISTINCT content_hash, vector FROM comment_vectors WHERE len(vector) = 64 AND model_version = 'det64/1'"
_CSV = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_MD = lambda c: f"replace(replace({c}, '|', '\\|'), chr(10), ' ')"
_CELLS = ["coalesce(file_path, '')", "coalesce(span.start_line::VARCHAR, '')", "coalesce(severity, '')", "coalesce(category, '')", "coalesce(provider_rule_id, '')", "coalesce(origin, '')", "coalesce(message, '')"]

ORACLES: dict[str, str] = {
    "flagship_ranked_findings": f"""
WITH {_spans(_ANCHORED)}, {_CLUSTERS}
SELECT row_number() OVER (ORDER BY r DESC, committed DESC, weight DESC, file_path, l, s, provider_rule_id, finding_id)::INT AS rank, finding_id, file_path, category, severity, also_from, merged FROM (
  SELECT m.finding_id, m.file_path, m.category, {_ANCHOR.replace("CASE category", "CASE m.category")} AS severity, {_MERGED} AS also_from, merged,
    sp.r, sp.l, sp.s, sp.provider_rule_id, coalesce(greatest(c.git.committed_unix, 0), 0) AS committed, coalesce(len(c.markers), 0) AS weight
  FROM merged m JOIN spans sp USING (finding_id) JOIN findings f USING (finding_id) LEFT JOIN comments c ON f.comment_id = c.id)
ORDER BY rank LIMIT 50""",
    "fn_normalize": f"SELECT id, {_NORMAL} AS normal, sha256({_NORMAL}) AS print FROM comments",
    "fn_content_hash": "SELECT id, sha256(raw_text) AS hash, sha256(raw_text) = content_hash AS same FROM comments",
    "fn_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token",
    "fn_hash_buckets": f"SELECT token, fnv, fnv % 64 AS bucket FROM (SELECT token, {_FNV.format('token')} AS fnv FROM (SELECT DISTINCT unnest({_TOKENS.format('raw_text')}) AS token FROM comments))",
    "fn_hash_embedding": f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents), h AS (SELECT token, ({_FNV.format("token")} % 64)::INT AS bucket FROM (SELECT DISTINCT token FROM t)),
  n AS (SELECT doc_id, bucket, count(*) AS n FROM t JOIN h USING (token) GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM n""",
    "fn_first_line": f"SELECT id, trim(string_split(replace(raw_text, chr(13), ''), chr(10))[1]) AS first, {_CSV('raw_text')} AS csv, {_MD('raw_text')} AS cell FROM comments",
    "fn_utf16_length": "SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units, strlen(text) AS bytes FROM documents",
    "fn_cosine": f"""SELECT content_hash, round(CASE WHEN list_sum(list_transform(vector, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(vector::DOUBLE[], {_VECTOR}) ELSE 0 END, 5) AS cosine
FROM ({_USABLE}) WHERE len(list_filter(vector, lambda x: isnan(x))) = 0""",
    "sc_walk": f"""SELECT path, coalesce({_case("lower(regexp_extract(path, '\\.([^./]+)$', 1))", EXTENSIONS)}, CASE WHEN starts_with(string_split(text, chr(10))[1], '#!') AND contains(string_split(text, chr(10))[1], 'sh') THEN 'shell' END) AS language,
  {_head(GENERATED)} OR strlen(string_split(text, chr(10))[1]) > 2000 AS generated FROM {_WALKED}""",
    "sc_ignored": """SELECT DISTINCT path FROM walked_files WHERE NOT starts_with(path, '.git/') AND NOT CASE
  WHEN regexp_matches(path, '^harbor-mono/tests/[^/]*\\.py(/|$)') THEN false WHEN regexp_matches(path, '^harbor-mono/tests/.*') THEN true
  WHEN regexp_matches(path, '(^|/)[^/]*\\.min\\.js(/|$)') THEN true WHEN regexp_matches(path, '(^|/)node_modules/.*') THEN true ELSE false END""",
    "sc_changed_files": """WITH b AS (SELECT path, h.h AS h FROM (SELECT path, arg_max({'h': content_hash}, walked_at) AS h FROM walked_files GROUP BY path)),
  a AS (SELECT path, h.h AS h FROM (SELECT path, arg_max({'h': content_hash}, walked_at) AS h FROM walked_files WHERE walked_at < TIMESTAMP '2025-07-01' GROUP BY path))
SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h""",
    "ex_kind": f"SELECT id, {_KIND} AS kind FROM comments",
    "ex_markers": f"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '{_marks([*MARKERS, 'Reading', 'Callers'])}', 1))), ',') AS markers FROM comments",
    "ex_coalesce": """
WITH c AS (SELECT path, r.id, r.kind, r.raw_text AS raw_text, r.span AS span FROM (SELECT path, arg_min({'id': id, 'kind': kind, 'raw_text': raw_text, 'span': span}, id) AS r FROM comments GROUP BY path, span.start_byte)),
  l AS (SELECT *, kind = 'line' AND lag(kind) OVER w = 'line' AND span.start_line = lag(span.end_line) OVER w + 1 AS joins FROM c WINDOW w AS (PARTITION BY path ORDER BY span.start_byte)),
  i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY span.start_byte ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT path, arg_min(id, span.start_byte) AS id, CASE WHEN count(*) > 1 THEN 'block' ELSE min(kind) END AS kind, min(span.start_line) AS start_line, arg_max(span.end_line, span.start_byte) AS end_line,
  sha256(string_agg(raw_text, chr(10) ORDER BY span.start_byte)) AS hash FROM i GROUP BY path, island""",
    "rt_intent": f"SELECT id, {_INTENT} AS intent FROM comments",
    "rt_missing_paths": f"""
WITH c AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(raw_text, '[A-Za-z0-9_./-]+'), lambda w: regexp_replace(w, '[.,;:)]+$', '')))) AS word FROM comments WHERE {_INTENT} <> 'log_level_reference'),
  k AS (SELECT id, word, regexp_replace(word, '^(?:\\./)+', '') AS candidate FROM c WHERE lower(regexp_extract(word, '[^/.]\\.([^./]+)$', 1)) IN ({_quoted(PATH_EXTENSIONS)})),
  s AS (SELECT DISTINCT array_to_string(string_split(path, '/')[i:], '/') AS candidate FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM walked_files))
SELECT id AS comment_id, 'no such file: ' || candidate AS message FROM k ANTI JOIN s USING (candidate) WHERE NOT starts_with(candidate, '/') AND NOT regexp_matches(candidate, '(^|/)\\.\\.(/|$)')""",
    "rt_symbols": "SELECT DISTINCT unnest([bound_symbol, string_split(bound_symbol, '.')[-1]]) AS name FROM comments WHERE bound_symbol IS NOT NULL AND bound_symbol <> '<module>'",
    "rt_drift": f"""WITH {_BLAME}, code AS (SELECT c.id, max(b.at) AS at FROM comments c JOIN blame b ON c.path = b.path AND b.line BETWEEN c.bound_node_range.start_line AND greatest(c.bound_node_range.start_line, c.bound_node_range.end_line) GROUP BY c.id)
SELECT c.id AS comment_id, 'code changed ' || ((code.at - c.git.committed_unix) // 86400)::VARCHAR || ' days after the comment' AS message FROM comments c JOIN code USING (id) WHERE code.at - c.git.committed_unix > 30 * 86400""",
    "mp_latest_commit": f"WITH {_BLAME} SELECT c.id, max(b.at) AS committed_unix FROM comments c JOIN blame b ON c.path = b.path AND b.line BETWEEN c.span.start_line AND greatest(c.span.start_line, c.span.end_line) GROUP BY c.id",
    "jn_attach": f"WITH {_ATTACHED} SELECT finding_id, a.comment_id FROM findings LEFT JOIN attached a USING (finding_id)",
    "jn_unattached": f"WITH {_ATTACHED} SELECT finding_id FROM findings ANTI JOIN attached USING (finding_id)",
    "jn_in_comments": "SELECT origin, count(*) AS n FROM findings f WHERE EXISTS (SELECT 1 FROM comments c WHERE c.path = f.file_path AND c.span.start_byte <= f.span.start_byte AND f.span.start_byte < c.span.end_byte) GROUP BY origin",
    "jn_in_scope": "SELECT finding_id FROM findings WHERE file_path IN (SELECT path FROM walked_files WHERE path IS NOT NULL)",
    "jn_cache_misses": f"""WITH v AS (SELECT provider, max(provider_version) AS provider_version FROM provider_results WHERE provider IN ('ruff', 'shellcheck', 'eslint', 'gitleaks') GROUP BY provider)
SELECT content_hash, provider, provider_version FROM (SELECT DISTINCT content_hash FROM {_WALKED} WHERE content_hash IS NOT NULL) CROSS JOIN v
ANTI JOIN (SELECT * FROM provider_results WHERE run_state IN ('SUCCESS', 'EMPTY')) USING (content_hash, provider, provider_version)""",
    "jn_tiered_match": """WITH q AS (SELECT * FROM comments WHERE id % 100 = 0), s AS (SELECT * FROM comments WHERE id % 100 <> 0), t AS (
  SELECT q.id AS query_id, min(s.id) AS id, 1 AS tier FROM q JOIN s ON q.content_hash = s.content_hash GROUP BY q.id
  UNION ALL SELECT q.id, min(s.id), 2 FROM q JOIN s ON q.cosmetic_fingerprint = s.cosmetic_fingerprint AND q.bound_symbol IS NOT DISTINCT FROM s.bound_symbol GROUP BY q.id
  UNION ALL SELECT q.id, min(s.id), 3 FROM q JOIN s ON q.cosmetic_fingerprint = s.cosmetic_fingerprint AND q.bound_symbol IS DISTINCT FROM s.bound_symbol GROUP BY q.id)
SELECT query_id, arg_min(id, tier) AS id, min(tier) AS tier FROM t GROUP BY query_id""",
    "ag_merge_overlaps": f"WITH {_spans(f'coalesce({_RANK}, -1)')}, {_CLUSTERS} SELECT finding_id, merged, {_MERGED} AS also_from FROM merged",
    "ag_merge_intervals": f"""WITH spans AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_suppkey::VARCHAR AS file_path, l_returnflag AS category, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s,
  date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + 5 AS e, 1 AS l, l_linestatus AS origin, 'r' AS provider_rule_id, NULL::VARCHAR[] AS also_from, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 20 THEN 2 ELSE 0 END AS r FROM lineitem), {_CLUSTERS}
SELECT finding_id, file_path, category, merged, {_MERGED} AS also_from FROM merged""",
    "ag_severity_histogram": "SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM findings",
    "ag_resolved_severities": f"""SELECT finding_id, severity, {_RANK}::INT AS severity_rank, native FROM (SELECT finding_id, CASE WHEN provider_rule_id = 'ruff:D417' THEN 'critical' WHEN category = 'todo_format' THEN 'warning' WHEN origin = 'gitleaks' THEN 'error' ELSE {_ANCHOR} END AS severity,
  CASE WHEN origin = 'eslint' AND lower(severity_native) IN ('2', 'error') THEN 'error' WHEN origin = 'eslint' AND lower(severity_native) IN ('1', 'warn', 'warning') THEN 'warning'
    WHEN origin = 'shellcheck' AND lower(severity_native) IN ('error', 'warning') THEN lower(severity_native) WHEN origin = 'shellcheck' AND lower(severity_native) IN ('info', 'style') THEN 'info' WHEN origin = 'gitleaks' THEN 'critical' END AS native FROM findings)""",
    "ag_rule_counts": "SELECT canonical_rule_id, count(*) AS n FROM findings GROUP BY canonical_rule_id ORDER BY canonical_rule_id NULLS FIRST LIMIT 12",
    "ag_by_file": f"SELECT file_path, count(*) AS findings, max({_RANK})::INT AS worst, array_to_string(list_sort(list(DISTINCT canonical_rule_id) FILTER (canonical_rule_id IS NOT NULL)), ',') AS rules FROM findings GROUP BY file_path",
    "ag_run_states": f"""WITH {_LATEST}, s AS (SELECT provider, CASE WHEN findings_json IS NULL OR trim(findings_json) = '' THEN 'SKIPPED' WHEN NOT json_valid(findings_json) THEN 'PARTIAL' WHEN json_array_length(findings_json) > 0 THEN 'SUCCESS' ELSE 'EMPTY' END AS st FROM latest)
SELECT provider, CASE WHEN bool_or(st = 'PARTIAL') THEN 'PARTIAL' WHEN bool_and(st = 'SKIPPED') THEN 'SKIPPED' WHEN bool_or(st = 'SUCCESS') THEN 'SUCCESS' ELSE 'EMPTY' END AS run_state FROM s GROUP BY provider""",
    "ag_verdict": f"""WITH {_LATEST}, p AS (SELECT coalesce(bool_or(run_state = 'PARTIAL'), false) AS partial FROM latest), f AS (SELECT coalesce(bool_or({_RANK} >= 3), false) AS failed FROM findings)
SELECT CASE WHEN partial THEN 'degraded' WHEN failed THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN partial THEN 2 WHEN failed THEN 1 ELSE 0 END AS code FROM p, f""",
    "ag_exit_code": f"SELECT CASE WHEN (SELECT bool_or({_RANK} >= 3) FROM findings) OR (SELECT bool_or(list_contains(markers, 'DO_NOT_MERGE')) FROM comments) THEN 1 ELSE 0 END AS code",
    "ag_set_hash": f"""WITH r AS (SELECT tree, sha256(path || chr(0) || content_hash || chr(10)) AS h FROM {_WALKED} WHERE content_hash IS NOT NULL), p AS (SELECT tree, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY tree, substr(h, 1, 3))
SELECT tree, sha256(string_agg(h, '' ORDER BY h)) AS set_hash FROM p GROUP BY tree""",
    "wn_ordinals": "SELECT id, (row_number() OVER (PARTITION BY bound_symbol, kind, cosmetic_fingerprint ORDER BY string_split(path, '/'), span.start_byte, id) - 1)::INT AS ordinal FROM comments",
    "wn_page": "SELECT doc_id, n_chars, position, total, 60 AS cursor FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id))::INT AS position, (count(*) OVER ())::INT AS total FROM documents) WHERE position BETWEEN 41 AND 60",
    "wn_budget_page": """WITH h AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id))::INT AS position, (count(*) OVER ())::INT AS total FROM documents), r AS (SELECT *, sum(n_chars) OVER (ORDER BY position) AS running FROM h WHERE position BETWEEN 11 AND 110)
SELECT doc_id, n_chars, position, total, max(position) OVER () AS cursor FROM r WHERE position = 11 OR running <= 20000""",
    "wn_keyword_search": f"WITH {_BM25} SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, id))::INT AS rank FROM scored ORDER BY rank LIMIT 20",
    "wn_nearest": f"""SELECT id, round(d, 5) AS distance, (row_number() OVER (ORDER BY d, id))::INT AS rank FROM (SELECT content_hash AS id, sqrt(list_sum(list_transform(list_zip(vector, {_VECTOR}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) AS d FROM ({_USABLE})) WHERE NOT isnan(d) ORDER BY rank LIMIT 20""",
    "wn_fused": f"""WITH {_BM25}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 100), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 100)
SELECT id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1.0::DOUBLE / (rank + 60)) DESC, id LIMIT 20""",
    "sp_regions": """WITH e AS (SELECT event_id, user_id, event_type AS t, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS lv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
  h AS (SELECT f.event_id AS finding_id, d.event_id AS directive_id, f.user_id, d.line AS d_line, f.line AS f_line, d.lv FROM e f JOIN e d ON f.user_id = d.user_id AND d.t = 'error' AND f.t IN ('view', 'click') AND d.line <= f.line AND d.lv = f.lv)
SELECT finding_id, arg_min(directive_id, row(d_line, directive_id)) AS directive_id FROM h WHERE NOT EXISTS (
  SELECT 1 FROM e x WHERE x.user_id = h.user_id AND x.t IN ('purchase', 'signup') AND h.d_line < x.line AND x.line <= h.f_line AND (x.t = 'signup' OR x.lv = h.lv)) GROUP BY finding_id""",
    "st_baseline": f"WITH {_KEYS} SELECT bound_symbol, fingerprint, rule, 'known' AS reason, '2025-10-01' AS date FROM accepted",
    "st_new_findings": f"WITH {_KEYS} SELECT finding_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM keys k JOIN accepted a ON {_MATCHED} WHERE k.finding_id = f.finding_id)",
    "st_pruned_baseline": f"WITH {_KEYS} SELECT bound_symbol, fingerprint, rule, 'known' AS reason, '2025-10-01' AS date FROM accepted a WHERE EXISTS (SELECT 1 FROM keys k WHERE {_MATCHED} AND k.found_at >= TIMESTAMP '2025-09-01')",
    "sp_export": f"SELECT file_path AS path, span.start_line AS line, origin, '{DIRECTIVE_WORD}:disable-line=' || array_to_string(list_sort(list(DISTINCT provider_rule_id)), ',') AS directive FROM findings GROUP BY ALL",
    "pr_normalised": f"""WITH {_LATEST}, d AS (SELECT content_hash, provider, provider_version, findings_json AS j FROM latest WHERE json_valid(findings_json) AND json_type(findings_json) = 'ARRAY'),
  x AS (SELECT content_hash, provider, provider_version, nth::INT AS nth, json_extract(j, '$[' || nth || ']') AS f FROM (SELECT *, unnest(range(0, json_array_length(j)::BIGINT)) AS nth FROM d))
SELECT content_hash, provider, provider_version, nth, 'shellcheck:' || (f ->> '$.code') AS provider_rule_id, CASE f ->> '$.code' WHEN '2148' THEN 'shebang' ELSE 'directive' END AS category, f ->> '$.file' AS file_path, (f ->> '$.line')::INT AS line
FROM x WHERE f ->> '$.code' IN ('2148', '1090', '1091')""",
    "is_to_file": f"WITH {_MARKED} SELECT token, arg_min(id, row(path, start_byte, id)) AS comment_id, count(*) AS mentions FROM marked ANTI JOIN ledger USING (token) GROUP BY token",
    "is_resolved": f"""WITH {_MARKED} SELECT path, start_byte, array_to_string(list_sort(list(DISTINCT issue) FILTER (issue IS NOT NULL)), ',') AS issues FROM marked LEFT JOIN ledger USING (token) GROUP BY path, start_byte HAVING bool_and(coalesce(closed, false))""",
    "up_strip_report": """WITH p AS (SELECT path, CASE WHEN kind = 'docstring' THEN 'k' WHEN kind = 'license' THEN 'l' WHEN kind IN ('directive', 'shebang', 'encoding-decl') THEN 's' ELSE 'r' END AS a FROM comments)
SELECT count(DISTINCT path) AS files, count(*) AS comments, count(*) FILTER (a = 'r') AS removed, count(*) FILTER (a = 'k') AS kept_by_kind, count(*) FILTER (a = 'l') AS kept_license, count(*) FILTER (a = 's') AS kept_significant FROM p""",
    "up_strip_files": "SELECT path, count(*) AS removed, array_to_string(list_sort(list(span.start_line)), ',') AS lines FROM comments WHERE kind NOT IN ('license', 'directive', 'shebang', 'encoding-decl') GROUP BY path",
    "sk_csv": "SELECT finding_id, " + " || ',' || ".join(_CSV(c) for c in _CELLS) + " AS value FROM findings",
    "sk_markdown": "SELECT finding_id, '| ' || " + " || ' | ' || ".join(_MD(c) for c in _CELLS) + " || ' |' AS value FROM findings",
    "sk_sarif": "SELECT finding_id, provider_rule_id AS rule, CASE WHEN severity IN ('critical', 'error') THEN 'error' WHEN severity = 'warning' THEN 'warning' WHEN severity = 'info' THEN 'note' END AS level, span.start_line AS line FROM findings",
    "sk_jsonl": "SELECT id, kind, markers[1] AS marker FROM comments",
    "sk_latest_results": "SELECT content_hash, provider, provider_version, max(cached_at) AS cached_at FROM provider_results GROUP BY ALL",
    "st_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
