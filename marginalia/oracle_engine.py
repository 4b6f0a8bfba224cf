"""The queries of `queries_engine` in SQL, for DuckDB on the same tables, written independently of the Spark plans."""

from __future__ import annotations

from marginalia.functions.text import ESLINT_CATEGORY
from marginalia.operators.classify import DIRECTIVE_WORD
from marginalia.operators.providers import BUILT_IN, RUFF
from marginalia.oracle import _ANCHOR, _INNER, _KEYS, _LATEST, _MATCHED, _QUERY, _RANK, _TOKENS, _VECTOR, ORACLES, _case, _head, _quoted
from marginalia.queries_engine import ESLINT_RULES, MARKER_SEVERITIES, MODEL
from marginalia.schema import CATEGORY_SEVERITY, SEVERITIES
from marginalia.sources.files import EXTENSIONS, GENERATED

_LANGUAGE = _case("lower(regexp_extract(path, '\\.([^./]+)$', 1))", EXTENSIONS)
_W = "(SELECT path, arg_max({'h': content_hash, 't': text}, walked_at) AS w FROM walked_files GROUP BY path)"
_PATHS = "(SELECT DISTINCT path FROM walked_files)"
_FULL_LANGUAGE = f"coalesce({_LANGUAGE}, CASE WHEN starts_with(string_split(w.t, chr(10))[1], '#!') AND contains(string_split(w.t, chr(10))[1], 'sh') THEN 'shell' END)"
_CODE = """code AS (SELECT c.id, max(epoch(w.at))::BIGINT AS at FROM comments c JOIN (SELECT path, max(walked_at) AS at FROM walked_files GROUP BY path) w ON c.path = w.path WHERE c.bound_node_range IS NOT NULL GROUP BY c.id)"""
_BEHIND = """behind AS (SELECT f.finding_id, f.canonical_rule_id, f.origin, EXISTS (SELECT 1 FROM comments c WHERE c.path = f.file_path AND c.span.start_byte <= f.span.end_byte AND f.span.end_byte < c.span.end_byte) AS inside FROM findings f)"""
_NAMED = [(m.id, m.languages) for m in BUILT_IN]
_PROVIDERS = "(VALUES " + ", ".join(f"('{p}', {'[' + _quoted(ls) + ']' if ls else '[]::VARCHAR[]'})" for p, ls in _NAMED) + ") p(provider, languages)"
_PLANNED = f"planned AS (SELECT provider, path FROM (SELECT path, {_LANGUAGE} AS language FROM {_PATHS}) f JOIN {_PROVIDERS} ON len(languages) = 0 OR list_contains(languages, language))"
_VECTORS = f"SELECT content_hash, min(vector) AS vector FROM comment_vectors WHERE model_version = '{MODEL}' AND len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0 GROUP BY content_hash"
_DIRECTED = f"""directed AS (SELECT finding_id AS directive_id, file_path AS path, span.start_line AS line,
  CASE WHEN severity = 'critical' AND origin = 'native' THEN 'disable-file' WHEN severity = 'info' THEN 'disable' WHEN severity = 'warning' THEN 'disable-line' WHEN severity = 'error' THEN 'disable-next-line' WHEN severity = 'critical' THEN 'enable' END AS verb,
  CASE WHEN origin = 'ruff' THEN [] WHEN origin = 'eslint' THEN [category] ELSE [provider_rule_id, origin] END AS targets FROM findings)"""
_HITS = """hits AS (SELECT f.finding_id, d.* FROM findings f JOIN directed d ON f.file_path = d.path AND (len(d.targets) = 0 OR list_has_any(d.targets, [f.provider_rule_id, f.canonical_rule_id, f.category, f.origin]))
  AND (d.verb = 'disable-file' OR (d.verb = 'disable-line' AND d.line = f.span.start_line) OR (d.verb = 'disable-next-line' AND d.line + 1 = f.span.start_line)
    OR (d.verb = 'disable' AND d.line <= f.span.start_line AND NOT EXISTS (SELECT 1 FROM directed e WHERE e.verb = 'enable' AND e.path = d.path AND d.line < e.line AND e.line <= f.span.start_line
      AND (len(e.targets) = 0 OR len(d.targets) = 0 OR list_has_any(d.targets, e.targets)))))),
  covered AS (SELECT finding_id, arg_min(directive_id, row(path, line, directive_id)) AS directive_id FROM hits GROUP BY finding_id)"""
_SUPPRESSED = f"""suppressed AS (SELECT f.finding_id, f.origin, CASE WHEN v.finding_id IS NOT NULL THEN 'directive' WHEN EXISTS (SELECT 1 FROM keys k JOIN accepted a ON {_MATCHED} WHERE k.finding_id = f.finding_id) THEN 'baseline' END AS suppressed_by
  FROM findings f LEFT JOIN covered v USING (finding_id))"""
_MONTHS = """months AS (SELECT strftime(cached_at, '%Y-%m') AS month, provider, max(provider_version) AS provider_version FROM provider_results WHERE cached_at IS NOT NULL GROUP BY ALL)"""
_CLUSTER = """clusters AS (
  SELECT *, sum(starts) OVER w AS cluster FROM (
    SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY {keys} ORDER BY s, e, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM spans)
  WINDOW w AS (PARTITION BY {keys} ORDER BY s, e, finding_id ROWS UNBOUNDED PRECEDING)
), merged AS (
  SELECT {keys}, cluster, arg_min(finding_id, row(-r, file_path, l, s, provider_rule_id, finding_id)) AS finding_id, arg_min(origin, row(-r, file_path, l, s, provider_rule_id, finding_id)) AS best_origin,
    max(r) AS r, list_sort(list_distinct(list_concat(list(origin), coalesce(flatten(list(also_from)), [])))) AS origins, count(*) AS merged, list(finding_id) AS members FROM clusters GROUP BY ALL)"""
_PER_COMMENT = _CLUSTER.format(keys="comment_id, file_path, category")
_FINDING_SPANS = "SELECT finding_id, comment_id, file_path, category, span.start_byte AS s, span.end_byte AS e, span.start_line AS l, origin, provider_rule_id, also_from"
_MARKERS = """marks AS (SELECT id, path, span, kind, bound_symbol, cosmetic_fingerprint, git, markers, scanned_at, raw_text, unnest(markers) AS m FROM comments), placed AS (SELECT *, instr(raw_text, m) AS pos,
  CASE WHEN instr(raw_text, m) > 0 THEN span.start_byte + strlen(substr(raw_text, 1, (instr(raw_text, m) - 1)::INT)) ELSE span.start_byte END AS s FROM marks)"""
_MARKER_SEVERITY = "CASE m " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in MARKER_SEVERITIES.items()) + f" ELSE '{CATEGORY_SEVERITY['marker_stale']}' END"
_BM25_COMMENTS = f"""words AS (SELECT id, {_TOKENS.format("raw_text")} AS w FROM comments WHERE raw_text IS NOT NULL),
  counted AS (SELECT id, len(w) AS length, {", ".join(f"len(list_filter(w, lambda x: x = '{q}'))::DOUBLE AS t{i}" for i, q in enumerate(_QUERY))} FROM words),
  corpus AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(_QUERY)))} FROM counted),
  scored AS (SELECT id, {" + ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(_QUERY)))} AS score
    FROM counted, corpus WHERE {" OR ".join(f"t{i} > 0" for i in range(len(_QUERY)))})"""
_DOCS = """docs AS (SELECT content_hash, provider, provider_version, findings_json AS j FROM latest WHERE json_valid(findings_json) AND json_type(findings_json) = 'ARRAY'),
  items AS (SELECT content_hash, provider, provider_version, json_extract(j, '$[' || nth || ']') AS f FROM (SELECT *, unnest(range(0, json_array_length(j)::BIGINT)) AS nth FROM docs)),
  plain AS (SELECT content_hash, provider, provider_version, f ->> '$.code' AS code, regexp_replace(f ->> '$.file', '^\\./', '') AS file_path, (f ->> '$.line')::INT AS line FROM items)"""
_FIRST_LINE = """firsts AS (SELECT path, arg_min({'s': span, 'r': raw_text}, row(span.start_byte, id)) AS c FROM comments WHERE kind = 'line' AND (raw_text LIKE '#%' OR raw_text LIKE '//%') GROUP BY path)"""


def _check(severity: str) -> str:
    """All findings and markers with a severity, merged per comment, and what of the baseline suppresses them."""
    return f"""{_MARKERS}, {_KEYS}, rows AS (SELECT 'f' || finding_id AS finding_id, comment_id, file_path, category, span.start_byte AS s, span.end_byte AS e, span.start_line AS l, origin, provider_rule_id, canonical_rule_id, also_from FROM findings
  UNION ALL SELECT 'm' || id || m, id, path, 'marker_stale', s, CASE WHEN pos > 0 THEN s + strlen(m) ELSE span.end_byte END, span.start_line, 'native', 'native:marker:' || m, 'marker:' || m, []::VARCHAR[] FROM placed),
  rated AS (SELECT *, {severity} AS sev FROM rows), spans AS (SELECT *, coalesce(list_position([{_quoted(SEVERITIES)}], sev) - 1, -1) AS r FROM rated), {_PER_COMMENT},
  best AS (SELECT p.comment_id, p.origin, p.sev AS severity, CASE WHEN EXISTS (SELECT 1 FROM comments c JOIN accepted a ON c.bound_symbol IS NOT DISTINCT FROM a.bound_symbol AND c.cosmetic_fingerprint = a.fingerprint
    WHERE c.id = p.comment_id AND a.rule IN (p.provider_rule_id, p.canonical_rule_id)) THEN 'baseline' END AS suppressed_by FROM merged m JOIN spans p USING (finding_id))"""


_CHECKED_SEVERITY = "CASE " + " ".join(f"WHEN provider_rule_id = 'native:marker:{m}' THEN '{s}'" for m, s in MARKER_SEVERITIES.items()) + f" WHEN origin = 'gitleaks' THEN 'warning' ELSE {_ANCHOR} END"


def _edited(new: str) -> str:
    return f"""WITH {_FIRST_LINE}, f AS (SELECT path, w.t AS t, c.s.start_byte AS s, c.s.end_byte AS e, {new} AS new FROM firsts JOIN {_W} USING (path) WHERE w.t IS NOT NULL AND {_FULL_LANGUAGE} IS NOT NULL)
SELECT path, true AS ok, 1 AS applied, sha256(decode(encode(t)[1:s]) || new || decode(encode(t)[e + 1:octet_length(encode(t))])) AS hash FROM f"""


ORACLES |= {
    "fn_rule_id": "SELECT finding_id, origin || ':' || canonical_rule_id AS rule FROM findings",
    "fn_inner_text": f"SELECT id, sha256({_INNER}) AS inner FROM comments",
    "fn_unit_vectors": """WITH v AS (SELECT DISTINCT content_hash, model_version, vector FROM comment_vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0), n AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x))) AS n FROM v)
SELECT content_hash, model_version, round(CASE WHEN n > 0 THEN vector[1]::DOUBLE / n ELSE vector[1] END, 5) AS first, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 5)::DOUBLE AS length FROM n""",
    "fn_byte_offsets": """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS rows FROM documents), l AS (SELECT *, rows[2] AS r, strlen(rows[1]) + 1 AS before FROM d)
SELECT doc_id, CASE WHEN length(r) >= 2 THEN before + strlen(substr(r, 1, 2)) END AS by_char,
  CASE WHEN length(r) >= 2 AND NOT regexp_matches(substr(r, 1, 2), '[\\x{10000}-\\x{10FFFF}]') THEN before + strlen(substr(r, 1, 2)) WHEN regexp_matches(substr(r, 1, 1), '[\\x{10000}-\\x{10FFFF}]') THEN before + strlen(substr(r, 1, 1)) END AS by_unit,
  CASE WHEN strlen(substr(r, 1, 1)) = 2 THEN before + 2 WHEN strlen(substr(r, 1, 1)) = 1 AND length(r) >= 2 AND strlen(substr(r, 2, 1)) = 1 THEN before + 2 END AS by_byte,
  CASE WHEN strlen(substr(r, 1, 1)) = 2 THEN before + 2 WHEN strlen(substr(r, 1, 1)) = 1 AND length(r) >= 2 AND strlen(substr(r, 2, 1)) = 1 THEN before + 2 END AS from_0 FROM l""",
    "fn_sub_spans": "SELECT id, span.start_byte + p AS start_byte, span.start_byte + p + strlen(markers[1]) AS end_byte FROM (SELECT *, strlen(string_split(raw_text, markers[1])[1]) AS p FROM comments WHERE len(markers) > 0)",
    "fn_eslint_categories": f"SELECT coalesce({_case('r', ESLINT_CATEGORY)}, 'none') AS category, count(*) AS n FROM (SELECT CASE WHEN lower(canonical_rule_id) = 'd417' THEN 'jsdoc/check-param-names' ELSE lower(canonical_rule_id) END AS r FROM findings) GROUP BY 1",
    "fn_fix_routes": "SELECT finding_id, CASE WHEN fix = 'provider_autofix' AND origin NOT IN ('ruff', 'eslint') THEN 'agent_only' ELSE fix END AS route FROM findings",
    "fn_search_terms": f"SELECT finding_id, CASE WHEN len(t) > 0 THEN len(t)::INT END AS terms FROM (SELECT finding_id, list_distinct({_TOKENS.format('message')}) AS t FROM findings)",
    "sc_relative": f"SELECT path, path AS relative FROM {_PATHS}",
    "sc_jsonl": "SELECT id, path, kind, bound_symbol, sha256(raw_text) AS hash, span.end_byte AS end_byte, array_to_string(coalesce(markers, []), ',') AS markers, git.commit_id AS commit FROM comments",
    "sc_blame": """SELECT path, c.span.start_line AS line, substr(sha256(c.git.commit_id), 1, 40) AS commit_id, coalesce(c.git.author, '') AS author, coalesce(c.git.email, '') AS email, coalesce(c.git.committed_unix, 0) AS committed_unix
FROM (SELECT path, arg_min(c, id) AS c FROM comments c WHERE git.commit_id IS NOT NULL AND path IS NOT NULL GROUP BY path, span.start_line)""",
    "sc_baseline": f"WITH {_KEYS} SELECT bound_symbol, fingerprint, rule, 'known' AS reason, '2025-10-01' AS date FROM accepted",
    "sc_ledger": """SELECT DISTINCT token, sha256(token) AS id, CASE WHEN length(token) % 3 = 0 THEN 'https://issues.invalid/?q="' || token || '"' END AS url, length(token) % 2 = 0 AS closed
FROM (SELECT coalesce(bound_symbol, '<none>') || '|' || kind || '|' || unnest(markers) AS token FROM comments)""",
    "sc_generated_walk": f"""SELECT path, language FROM (SELECT path, w.t AS text, {_FULL_LANGUAGE} AS language FROM {_W}) WHERE language IS NOT NULL AND NOT regexp_matches(path, '(^|/)\\.[^/]') AND NOT regexp_matches(path, '(^|/)(node_modules|vendor)/.*') AND NOT regexp_matches(path, '(^|/)[^/]*\\.min\\.js(/|$)')
  AND NOT coalesce({_head(GENERATED)} OR strlen(string_split(text, chr(10))[1]) > 2000, false)""",
    "sc_skipped": f"SELECT path, 'not UTF-8' AS reason FROM {_W} WHERE w.t IS NULL",
    "ex_scanned": f"SELECT DISTINCT path, span.start_byte AS start_byte, content_hash FROM comments JOIN {_W} USING (path) WHERE NOT (kind = 'docstring' AND bound_symbol = '<module>') AND w.t IS NOT NULL AND {_FULL_LANGUAGE} IS NOT NULL",
    "ex_coalesced_lines": f"""
WITH c AS (SELECT path, r.id, r.kind, r.raw_text AS raw_text, r.span AS span FROM (SELECT path, arg_min({{'id': id, 'kind': kind, 'raw_text': raw_text, 'span': span}}, id) AS r FROM comments GROUP BY path, span.start_byte)),
  p AS (SELECT c.*, lag(span.end_byte) OVER (PARTITION BY path ORDER BY span.start_byte) AS before FROM c),
  a AS (SELECT p.*, regexp_matches(regexp_extract(decode(encode(w.t)[1:span.start_byte]), '([^\\n]*)$', 1), '^ *$') AS own_line,
    CASE WHEN coalesce(before, 0) <= span.start_byte THEN decode(encode(w.t)[coalesce(before, 0) + 1:span.start_byte]) END AS joint FROM p JOIN {_W} w USING (path) WHERE w.t IS NOT NULL),
  l AS (SELECT *, kind = 'line' AND own_line AS merges, before IS NOT NULL AND joint IS NOT NULL AND regexp_replace(joint, '\\s+', '', 'g') = '' AS blank FROM a),
  j AS (SELECT *, merges AND coalesce(lag(merges) OVER w, false) AND span.start_line = lag(span.end_line) OVER w + 1 AND blank AS joins FROM l WINDOW w AS (PARTITION BY path ORDER BY span.start_byte)),
  i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY span.start_byte ROWS UNBOUNDED PRECEDING) AS island FROM j)
SELECT path, arg_min(id, span.start_byte) AS id, CASE WHEN count(*) > 1 THEN 'block' ELSE min(kind) END AS kind, min(span.start_line) AS start_line, arg_max(span.end_line, span.start_byte) AS end_line,
  (sum(length(raw_text)) + coalesce(sum(CASE WHEN joins THEN length(joint) END), 0))::INT AS length FROM i GROUP BY path, island""",
    "rt_code_drift": f"WITH {_CODE} SELECT c.id AS comment_id, 'code changed ' || ((code.at - c.git.committed_unix) // 86400)::VARCHAR || ' days after the comment' AS message FROM comments c JOIN code USING (id) WHERE code.at - c.git.committed_unix > 500 * 86400",
    "ck_rot_candidates": f"WITH {_CODE} SELECT c.id AS comment_id, 'native:rot_candidate' AS provider_rule_id, 'rot_candidate' AS category, 'info' AS severity, c.span.start_byte AS start_byte FROM comments c JOIN code USING (id) WHERE c.git.committed_unix < code.at",
    "ck_marker_findings": f"""WITH {_MARKERS} SELECT id AS comment_id, path AS file_path, 'native:marker:' || m AS provider_rule_id, 'marker_stale' AS category, {_MARKER_SEVERITY} AS severity, m || ' marker' AS message, s AS start_byte,
  CASE WHEN pos > 0 THEN s + strlen(m) ELSE span.end_byte END AS end_byte FROM placed""",
    "jn_unattached_behind": f"WITH {_BEHIND} SELECT finding_id FROM behind WHERE NOT inside",
    "ag_unattached_rules": f"WITH {_BEHIND} SELECT canonical_rule_id, count(*) AS n FROM behind WHERE NOT inside GROUP BY canonical_rule_id ORDER BY canonical_rule_id NULLS FIRST LIMIT 12",
    "jn_provider_files": f"WITH {_PLANNED} SELECT provider, path FROM planned",
    "jn_scoped_states": f"""WITH {_LATEST}, {_BEHIND} SELECT content_hash, provider, provider_version, CASE WHEN provider IN ('gitleaks', 'eslint') AND run_state IN ('SUCCESS', 'EMPTY')
  THEN CASE WHEN EXISTS (SELECT 1 FROM behind b WHERE b.inside AND b.origin = provider) THEN 'SUCCESS' ELSE 'EMPTY' END ELSE run_state END AS run_state FROM latest""",
    "jn_identity_lookup": """WITH o AS (SELECT id, bound_symbol, kind, cosmetic_fingerprint, (row_number() OVER (PARTITION BY bound_symbol, kind, cosmetic_fingerprint ORDER BY string_split(path, '/'), span.start_byte, id) - 1)::INT AS ordinal FROM comments),
  k AS (SELECT DISTINCT bound_symbol AS s, kind AS k, cosmetic_fingerprint AS p FROM comments WHERE id IN (SELECT comment_id FROM findings WHERE comment_id IS NOT NULL))
SELECT o.id, o.ordinal FROM o JOIN k ON o.bound_symbol IS NOT DISTINCT FROM k.s AND o.kind IS NOT DISTINCT FROM k.k AND o.cosmetic_fingerprint IS NOT DISTINCT FROM k.p""",
    "jn_match_all": f"""WITH v AS ({_VECTORS}), s AS (SELECT c.*, v.vector AS vec FROM comments c LEFT JOIN v USING (content_hash)), q AS (SELECT * FROM s WHERE id % 100 = 0), t AS (
  SELECT q.id AS query_id, min(s.id) AS id, 1 AS tier FROM q JOIN s ON q.content_hash = s.content_hash AND q.id <> s.id GROUP BY q.id
  UNION ALL SELECT q.id, min(s.id), 2 FROM q JOIN s ON q.cosmetic_fingerprint = s.cosmetic_fingerprint AND q.bound_symbol IS NOT DISTINCT FROM s.bound_symbol AND q.id <> s.id GROUP BY q.id
  UNION ALL SELECT q.id, min(s.id), 3 FROM q JOIN s ON q.cosmetic_fingerprint = s.cosmetic_fingerprint AND q.bound_symbol IS DISTINCT FROM s.bound_symbol GROUP BY q.id
  UNION ALL SELECT q.id, min(s.id), 4 FROM q JOIN s ON q.bound_symbol = s.bound_symbol AND q.kind = s.kind AND q.id <> s.id
    AND CASE WHEN list_sum(list_transform(q.vec, lambda x: x::DOUBLE * x)) > 0 AND list_sum(list_transform(s.vec, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(q.vec::DOUBLE[], s.vec::DOUBLE[]) ELSE 0 END >= 0.8 GROUP BY q.id HAVING count(*) = 1)
SELECT query_id, arg_min(id, tier) AS id, min(tier) AS tier FROM t GROUP BY query_id""",
    "st_scope_veto": f"""WITH {_PLANNED}, vetoed AS (SELECT DISTINCT r.provider, f.path FROM (SELECT path, w.h AS h FROM {_W}) f JOIN provider_results r ON f.h = r.content_hash AND r.run_state = 'SKIPPED')
SELECT provider, path FROM planned ANTI JOIN vetoed USING (provider, path)""",
    "ag_merge_per_comment": f"WITH spans AS ({_FINDING_SPANS}, coalesce({_RANK}, -1) AS r FROM findings), {_PER_COMMENT} SELECT finding_id, merged, array_to_string(list_sort(list_filter(origins, lambda x: x IS NOT NULL AND x <> best_origin)), ',') AS also_from FROM merged",
    "ag_rule_descriptors": "SELECT provider_rule_id, arg_min(finding_id, row(file_path, span.start_line, span.start_byte, finding_id)) AS first FROM findings GROUP BY provider_rule_id",
    "ag_cache_stats": f"""WITH v AS (SELECT provider, max(provider_version) AS provider_version FROM provider_results WHERE provider IN ('ruff', 'shellcheck', 'eslint', 'gitleaks') GROUP BY provider), n AS (SELECT * FROM (SELECT DISTINCT w.h AS content_hash FROM {_W} WHERE w.h IS NOT NULL) CROSS JOIN v),
  l AS (SELECT r.* FROM (SELECT arg_max(p, row(cached_at, findings_json, run_state)) AS r FROM provider_results p WHERE cached_at < TIMESTAMP '2025-10-01' GROUP BY content_hash, provider, provider_version))
SELECT count(*) FILTER (EXISTS (SELECT 1 FROM l WHERE l.content_hash = n.content_hash AND l.provider = n.provider AND l.provider_version = n.provider_version AND l.run_state IN ('SUCCESS', 'EMPTY'))) AS hits, count(*) AS runs FROM n""",
    "ag_verdicts": f"""WITH {_LATEST}, p AS (SELECT coalesce(bool_or(run_state = 'PARTIAL'), false) AS partial FROM latest), f AS (SELECT coalesce(bool_or({_RANK} >= 3), false) AS failed FROM findings)
SELECT 'as they are' AS case_name, CASE WHEN partial THEN 'degraded' WHEN failed THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN partial THEN 2 WHEN failed THEN 1 ELSE 0 END AS code FROM p, f
UNION ALL SELECT 'none partial', CASE WHEN failed THEN 'fail' ELSE 'pass' END, CASE WHEN failed THEN 1 ELSE 0 END FROM f UNION ALL SELECT 'no finding', 'pass', 0""",
    "wn_canonical": "SELECT finding_id, (row_number() OVER (ORDER BY file_path NULLS FIRST, span.start_line, span.start_byte, provider_rule_id NULLS FIRST, finding_id))::INT AS position FROM findings QUALIFY position <= 50",
    "wn_by_score": f"""WITH s AS (SELECT content_hash, CASE WHEN list_sum(list_transform(vector, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(vector::DOUBLE[], {_VECTOR}) WHEN len(list_filter(vector, lambda x: isnan(x))) > 0 THEN 'nan'::DOUBLE ELSE 0 END AS score
  FROM comment_vectors WHERE model_version = '{MODEL}' AND len(vector) = 64), m AS (SELECT content_hash, max(score) AS score FROM s GROUP BY content_hash)
SELECT content_hash, round(score, 5) AS score FROM m ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, content_hash LIMIT 30""",
    "wn_hybrid": f"""WITH {_BM25_COMMENTS}, v AS ({_VECTORS}), d AS (SELECT c.id, sqrt(list_sum(list_transform(list_zip(v.vector, {_VECTOR}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) AS d FROM comments c JOIN v USING (content_hash)),
  a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 100), b AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM d QUALIFY rank <= 100)
SELECT id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1.0::DOUBLE / (rank + 60)) DESC, id LIMIT 20""",
    "fn_directives": f"WITH {_DIRECTED} SELECT directive_id, path, line, verb, array_to_string(targets, ',') AS targets FROM directed WHERE verb IS NOT NULL",
    "sp_scopes": f"WITH {_DIRECTED}, {_HITS} SELECT finding_id, directive_id FROM covered",
    "sp_unused": f"WITH {_DIRECTED}, {_HITS} SELECT directive_id FROM directed WHERE verb IS NOT NULL AND verb <> 'enable' AND directive_id NOT IN (SELECT directive_id FROM covered)",
    "sp_combined": f"WITH {_DIRECTED}, {_HITS}, {_KEYS}, {_SUPPRESSED} SELECT finding_id, suppressed_by FROM suppressed",
    "sp_live": f"WITH {_DIRECTED}, {_HITS}, {_KEYS}, {_SUPPRESSED} SELECT origin, count(*) AS n FROM suppressed WHERE suppressed_by IS NULL GROUP BY origin",
    "sp_marker_baseline": f"""WITH {_MARKERS}, known AS (SELECT DISTINCT bound_symbol AS b, cosmetic_fingerprint AS p, m AS k FROM placed WHERE scanned_at < TIMESTAMP '2025-10-01' AND cosmetic_fingerprint IS NOT NULL)
SELECT id AS comment_id, 'native:marker:' || m AS provider_rule_id FROM placed WHERE NOT EXISTS (SELECT 1 FROM known WHERE b IS NOT DISTINCT FROM bound_symbol AND p = cosmetic_fingerprint AND k = m)""",
    "ck_inputs_keys": f"""WITH {_MONTHS}, k AS (SELECT month, sha256('inputs_schema=3' || string_agg(';' || provider || '=' || provider_version || '@sha256:' || sha256(provider || provider_version), '' ORDER BY provider)) AS inputs_key FROM months GROUP BY month)
SELECT month, inputs_key, sha256(inputs_key || ';ruleset=5;index_schema=7') AS index_key FROM k""",
    "ck_version_keys": "SELECT provider, provider_version, CASE WHEN bool_or(run_state <> 'SKIPPED') THEN sha256(sha256(provider || provider_version) || chr(0) || 'config of ' || provider) END AS key FROM provider_results GROUP BY provider, provider_version",
    "ck_restore_plan": f"""WITH {_MONTHS}, n AS (SELECT month, list_sort(list(provider || '@' || provider_version)) AS now FROM months GROUP BY month), p AS (SELECT strftime(strptime(month, '%Y-%m') + INTERVAL 1 MONTH, '%Y-%m') AS month, now AS was FROM n)
SELECT month, CASE WHEN now = was THEN 'use_index' WHEN coalesce(list_has_any(now, was), false) THEN 'rederive' ELSE 'cold' END AS plan FROM n LEFT JOIN p USING (month)""",
    "ck_comparable": """WITH a AS (SELECT provider, max(provider_version) AS v FROM provider_results WHERE cached_at < TIMESTAMP '2025-10-01' GROUP BY provider), b AS (SELECT provider, max(provider_version) AS v FROM provider_results WHERE cached_at >= TIMESTAMP '2025-10-01' AND provider <> 'ruff' GROUP BY provider)
SELECT coalesce(a.provider, b.provider) AS provider, coalesce(a.v = b.v, false) AS comparable FROM a FULL JOIN b ON a.provider = b.provider""",
    "ck_readable": "SELECT provider, count(*) FILTER (string_split(provider_version, '.')[1]::INT IN (1, 2)) AS readable, count(*) AS n FROM (SELECT DISTINCT content_hash, provider, provider_version FROM provider_results) GROUP BY provider",
    "ck_fatal_runs": f"WITH {_LATEST} SELECT provider, count(*) FILTER (run_state = 'PARTIAL') AS strict, 0::BIGINT AS lenient FROM latest GROUP BY provider",
    "ck_check": f"WITH {_check(_CHECKED_SEVERITY)} SELECT origin, severity, suppressed_by, count(*) AS n, count(comment_id) AS attached FROM best GROUP BY ALL",
    "ck_summary": f"WITH {_check(_ANCHOR)} SELECT (SELECT count(*) FROM comments) AS comments, count(*) FILTER (suppressed_by IS NULL) AS findings, count(*) FILTER (comment_id IS NULL) AS unattached, count(*) FILTER (suppressed_by IS NOT NULL) AS suppressed FROM best",
    "ck_candidates": f"""WITH {_MARKERS} SELECT (row_number() OVER (ORDER BY coalesce(greatest(git.committed_unix, 0), 0) DESC, len(markers) DESC, path NULLS FIRST, span.start_line, s, m))::INT AS rank, path AS file_path, span.start_line AS line, 'native:marker:' || m AS provider_rule_id, 'warning' AS severity
FROM placed QUALIFY rank <= 20""",
    "cx_context": f"""SELECT c.id, coalesce(array_to_string(list_sort(f.rules), ','), '') AS rules, CASE WHEN c.bound_node_range IS NOT NULL AND w.w.t IS NOT NULL THEN greatest(least(c.bound_node_range.end_byte, strlen(w.w.t)) - c.bound_node_range.start_byte, 0)::INT END AS code_bytes
FROM comments c LEFT JOIN (SELECT comment_id, list(provider_rule_id) AS rules FROM findings GROUP BY comment_id) f ON c.id = f.comment_id LEFT JOIN {_W} w ON c.path = w.path""",
    "cx_report": f"""WITH {_LATEST}, p AS (SELECT coalesce(bool_or(run_state = 'PARTIAL'), false) AS partial FROM latest), f AS (SELECT count(*) AS n, coalesce(bool_or({_RANK} >= 2), false) AS failed FROM findings WHERE category IS DISTINCT FROM 'doc_style')
SELECT n AS results, n AS rows, CASE WHEN partial THEN 'degraded' WHEN failed THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN partial THEN 2 WHEN failed THEN 1 ELSE 0 END AS code FROM p, f""",
    "up_edited": _edited("encode(CASE WHEN starts_with(c.r, '#') THEN '# checked' ELSE '// checked' END)"),
    "up_removed": _edited("encode('')"),
    "up_protected": "SELECT kind, CASE WHEN kind IN ('directive', 'shebang', 'encoding-decl') THEN count(*) ELSE 0 END AS refused, 0::BIGINT AS refused_anyway FROM comments GROUP BY kind",
    "sk_terminal": """SELECT file_path, sha256(file_path || chr(10) || string_agg(printf('  %5d  %-8s %-14s %s', span.start_line, severity, category, coalesce(message, '')), chr(10) ORDER BY span.start_line, finding_id)) AS hash FROM findings GROUP BY file_path""",
    "sk_totals": f"SELECT count(*) AS findings, count(DISTINCT file_path) AS files, max({_RANK})::INT AS worst FROM findings",
    "sk_index": f"SELECT word, count(*) AS times, count(DISTINCT id) AS comments FROM (SELECT id, unnest({_TOKENS.format('raw_text')}) AS word FROM comments) GROUP BY word",
    "sk_cached_results": "SELECT r.content_hash, r.provider, r.provider_version, r.run_state FROM (SELECT arg_max(p, row(cached_at, findings_json, run_state)) AS r FROM provider_results p WHERE run_state IN ('SUCCESS', 'EMPTY') AND cached_at IS NOT NULL GROUP BY content_hash, provider, provider_version)",
    "sk_sarif_whole": """SELECT finding_id, '{"ruleId":' || to_json(provider_rule_id) || ',"level":"' || CASE WHEN severity IN ('critical', 'error') THEN 'error' WHEN severity = 'warning' THEN 'warning' ELSE 'note' END || '","message":{"text":' || to_json(message) || '},"locations":[{"physicalLocation":{"artifactLocation":{"uri":' || to_json(file_path) || '},"region":{"startLine":' || span.start_line || ',"endLine":' || span.end_line || '}}}]}' AS value FROM findings""",
    "pr_sarif": "SELECT file_path AS document_of, provider_rule_id AS canonical_rule_id, CASE WHEN severity IN ('critical', 'error') THEN 'error' WHEN severity = 'warning' THEN 'warning' WHEN severity = 'info' THEN 'note' END AS severity_native, file_path, span.start_line AS line, count(*) AS n FROM findings WHERE file_path IS NOT NULL GROUP BY ALL",
    "pr_by_tool": f"""WITH {_LATEST}, {_DOCS}, mapped AS (SELECT *, CASE WHEN provider = 'eslint' THEN coalesce({_case('code', ESLINT_RULES)}, code) ELSE code END AS rule FROM plain),
  named AS (SELECT *, CASE provider WHEN 'ruff' THEN {_case('rule', RUFF.category_map)} WHEN 'shellcheck' THEN CASE rule WHEN '2148' THEN 'shebang' WHEN '1090' THEN 'directive' WHEN '1091' THEN 'directive' END WHEN 'gitleaks' THEN 'secret' WHEN 'eslint' THEN {_case('rule', ESLINT_CATEGORY)} END AS category FROM mapped)
SELECT content_hash, provider_version, provider || ':' || rule AS provider_rule_id, category, file_path, line FROM named WHERE category IS NOT NULL""",
    "st_late_counts": "SELECT strftime(found_at, '%Y-%m-%d') AS day, origin, count(*) AS n FROM findings WHERE date_trunc('day', found_at) + INTERVAL 1 DAY <= (SELECT max(found_at) FROM findings) - INTERVAL 2 DAY GROUP BY ALL",
}
