"""SQL for the registered queries, as DuckDB reads it over the same tables."""

from __future__ import annotations

FILES = r"""
files AS (
  SELECT doc_id, 'doc:///' || source || '/' || doc_id AS uri, source AS scope_id, lang AS language, coalesce(text, '') AS text,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, 'sha256:' || sha256(coalesce(text, '')) AS sha256 FROM documents)"""
LINES = FILES + r""",
l0 AS (
  SELECT doc_id, uri, scope_id, language, sha256, unnest(range(len(ls))) AS line, unnest(ls) AS line_text, unnest(list_concat(es, [''])) AS terminator
  FROM (SELECT *, string_split_regex(text, '\r\n|\n|\r') AS ls, regexp_extract_all(text, '\r\n|\n|\r') AS es FROM files)),
lines AS (
  SELECT *, length(line_text) AS n,
         CAST(coalesce(sum(length(line_text) + length(terminator)) OVER w, 0) AS BIGINT) AS start_char_offset,
         CAST(coalesce(sum(strlen(line_text) + strlen(terminator)) OVER w, 0) AS BIGINT) AS start_byte
  FROM l0 WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
OCC = LINES + r""",
words AS (SELECT *, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT *, string_split(line_text, ' ') AS t FROM lines)),
placed AS (SELECT *, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM words),
occ AS (SELECT doc_id, uri, scope_id, language, lower(token) AS symbol_id, token, line, start_char, start_char + length(token) AS end_char, sha256 AS source_hash FROM placed WHERE token <> '')"""
DEF = OCC + r""",
def AS (SELECT scope_id, symbol_id, d.* , uses FROM (
  SELECT scope_id, symbol_id, min({'doc_id': doc_id, 'line': line, 'start_char': start_char, 'end_char': end_char, 'uri': uri, 'token': token, 'language': language}) AS d, count(*) AS uses FROM occ GROUP BY ALL)),
sym AS (SELECT scope_id, symbol_id AS id, token AS name, language, uses, uri, line, start_char, end_char,
  CASE WHEN length(token) = 1 THEN 'module_graph_node' WHEN regexp_matches(token, '^\p{Lu}') THEN 'class' WHEN regexp_matches(token, '[0-9]') THEN 'constant' ELSE 'function' END AS kind FROM def),
roles AS (SELECT o.*, CASE WHEN o.doc_id = d.doc_id AND o.line = d.line AND o.start_char = d.start_char THEN 'definition' ELSE 'reference' END AS role FROM occ o JOIN def d USING (scope_id, symbol_id))"""
CALLS = OCC + r""",
calls AS (SELECT * FROM (SELECT scope_id, uri, symbol_id AS "from", start_char, lead(symbol_id) OVER (PARTITION BY doc_id, line ORDER BY start_char) AS "to" FROM occ) WHERE "to" IS NOT NULL)"""
VERSIONS = FILES + r""",
before AS (SELECT uri AS path, size, sha256 FROM files),
changed AS (SELECT CASE WHEN language = 'de' THEN uri || '.moved' ELSE uri END AS path, CASE WHEN language = 'fr' THEN text || '!' ELSE text END AS text FROM files),
after AS (SELECT path, CAST(strlen(text) AS BIGINT) AS size, 'sha256:' || sha256(text) AS sha256 FROM changed),
diff AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM before b FULL JOIN after a ON a.path = b.path WHERE b.sha256 IS DISTINCT FROM a.sha256 OR b.size IS DISTINCT FROM a.size)"""
TARGETS = DEF + r""",
target AS (SELECT f.doc_id AS query_id, o.scope_id, o.symbol_id FROM files f JOIN occ o ON o.doc_id = f.doc_id AND o.line = 0 AND o.start_char = 0)"""
FACTS = "['symbol','declaration','definition','reference','implementation','type_relation','call','import','include','module','generated_source']"
COVERAGE = FILES + rf""",
scopes AS (SELECT DISTINCT scope_id FROM files),
coverage AS (SELECT scope_id, fact, CASE WHEN right(scope_id, 1) IN ('0','2','4','6','8') THEN 'complete' WHEN fact = 'include' THEN 'unavailable' ELSE 'unknown' END AS state FROM (SELECT scope_id, unnest({FACTS}) AS fact FROM scopes))"""
LOG = "log AS (SELECT event_id AS request_id, ts AS \"at\", user_id AS client, event_type AS method, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
DAYS = """days AS (SELECT date_trunc('day', ts) AS "window", count(*) AS n, arg_min(value, {'at': ts, 'id': event_id}) AS first, arg_max(value, {'at': ts, 'id': event_id}) AS last,
  quantile_disc(value, 0.5) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1),
points AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST("window" AS DATE)) AS DOUBLE) AS x, median AS y FROM days)"""
MODULES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
KPI = """
c AS (SELECT lang AS language, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn,
  count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) AS n, count(*) FILTER (toxic = 1) AS refusals FROM labels JOIN documents USING (doc_id) GROUP BY lang),
m AS (
  SELECT language, 'precision' AS metric, tp AS numerator, tp + fp AS denominator FROM c UNION ALL SELECT language, 'recall', tp, tp + fn FROM c
  UNION ALL SELECT language, 'false_positive_rate', fp, fp + tn FROM c UNION ALL SELECT language, 'false_negative_rate', fn, fn + tp FROM c
  UNION ALL SELECT language, 'refusal_rate', refusals, n FROM c UNION ALL SELECT language, 'stale_rejection_rate', 0, 0 FROM c
  UNION ALL SELECT language, 'wrong_file_rate', NULL, NULL FROM c UNION ALL SELECT language, 'mapping_failure_rate', n + 1, n FROM c UNION ALL SELECT language, 'edit_failure_rate', NULL, NULL FROM c),
k AS (SELECT language, metric, CASE WHEN numerator IS NULL OR denominator IS NULL THEN 'not_verified' WHEN numerator > denominator THEN 'invalid' WHEN denominator = 0 THEN 'not_verified' ELSE 'observed' END AS status, numerator, denominator FROM m)"""
CHECKS = """
checks AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'core' ELSE 'later-' || o_orderstatus END AS domain,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Y0' WHEN '2-HIGH' THEN 'Y1' WHEN '3-MEDIUM' THEN 'Y2' WHEN '4-NOT SPECIFIED' THEN 'Y3' WHEN '5-LOW' THEN 'PERF' ELSE 'other' END AS category,
  CAST(1 + o_orderkey % 3 AS DOUBLE) AS weight, o_custkey % 10 AS k FROM orders),
credited AS (SELECT domain, category, CASE WHEN NOT (domain = 'core' AND k = 9) THEN weight END AS w, CASE WHEN k < 5 THEN 1.0 WHEN k < 8 THEN 0.5 ELSE 0.0 END AS credit FROM checks),
cat AS (SELECT domain, category, count(w) AS items, CASE WHEN sum(w) > 0 THEN CAST(sum(w * credit) AS DOUBLE) / sum(w) ELSE 1.0 END AS score,
  CASE WHEN coalesce(sum(w), 0) > 0 THEN CASE WHEN domain <> 'core' THEN CAST(count(w) AS DOUBLE) ELSE CASE category WHEN 'Y0' THEN 0.24 WHEN 'Y3' THEN 0.18 WHEN 'Y1' THEN 0.18 WHEN 'Y2' THEN 0.13 WHEN 'Y4' THEN 0.09 WHEN 'Y5' THEN 0.09 WHEN 'PERF' THEN 0.09 ELSE 0.0 END END END AS counts FROM credited GROUP BY domain, category),
scores AS (SELECT domain, category, items, CAST(score AS DOUBLE) AS score FROM cat WHERE items > 0
  UNION ALL SELECT domain, NULL, CAST(sum(items) AS BIGINT), CAST(sum(counts * score) / nullif(sum(counts), 0) AS DOUBLE) FROM cat GROUP BY domain)"""
FLOOR = "list_extract(list_sort(list({v})), CAST(floor((count({v}) - 1) * {q}) AS BIGINT) + 1) AS {n}"
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def floors(v: str) -> str:
    return ", ".join(FLOOR.format(v=v, q=q, n=n) for n, q in QUANTILES.items())


def discs(v: str) -> str:
    return ", ".join(f"quantile_disc({v}, {q}) AS {n}" for n, q in QUANTILES.items())


def leaves(hash_: str, order: str, item: str) -> str:
    return f"substr({hash_}, 1, 4) AS leaf, sha256(string_agg({item}, chr(10) ORDER BY {order})) AS h, count(*) AS n"


SECRET = r"""("?[a-z0-9_.-]*(?:token|password|secret|authorization|api[_-]?key|bearer)[a-z0-9_.-]*"?)\s*[=:]\s*(?:bearer\s+)?(?:\[[^\[\]]*\]|"[^"]*"|[^\s&;]+)"""

SQL: dict[str, str] = {
    "file_inventory": f"""WITH {FILES}, p AS (SELECT *, uri || ['.go', '.PY', '.rs', '.tsx', '.xyz'][doc_id % 5 + 1] AS path FROM files)
        SELECT path, language, size, sha256, ['go', 'python', 'rust', 'typescriptreact', ''][doc_id % 5 + 1] AS by_extension FROM p""",
    "tree_digest": f"""WITH {FILES}, leaf AS (SELECT scope_id, {leaves("sha256(uri)", "uri", "uri || '|' || size || '|' || sha256")} FROM files GROUP BY scope_id, leaf)
        SELECT scope_id, sha256(string_agg(h, chr(10) ORDER BY leaf)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM leaf GROUP BY scope_id""",
    "overlay_scan": f"""WITH {VERSIONS} SELECT coalesce(a.path, b.path) AS uri, CASE WHEN a.path IS NULL THEN b.size ELSE a.size END AS size, CASE WHEN a.path IS NULL THEN b.sha256 ELSE a.sha256 END AS sha256, a.path IS NOT NULL AS from_overlay
        FROM before b FULL JOIN after a ON a.path = b.path""",
    "snapshot_diff": f"WITH {VERSIONS} SELECT * FROM diff",
    "first_inventory_change": f"WITH {VERSIONS} SELECT * FROM diff ORDER BY path LIMIT 1",
    "scans_unchanged": f"""WITH {VERSIONS}, g AS (SELECT count(*) AS gone FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after)), n AS (SELECT count(*) AS new FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before))
        SELECT gone, new, gone = 0 AND new = 0 AS unchanged FROM g, n""",
    "merged_file_lists": f"WITH {VERSIONS} SELECT path, min(sha256) AS sha256, count(DISTINCT sha256) > 1 AS conflict FROM (SELECT * FROM before UNION ALL SELECT * FROM after) GROUP BY path",
    "line_table": f"WITH {LINES} SELECT uri, line, start_char_offset, start_byte, n AS n_chars, length(terminator) AS end_chars FROM lines",
    "encoding_widths": f"WITH {FILES} SELECT uri, size AS utf8, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS utf16, length(text) AS utf32 FROM files",
    "offset_to_position": f"""WITH {LINES}, o AS (SELECT uri, unnest(list_distinct([0, length(text) // 3, length(text) // 2, length(text)])) AS "offset" FROM files)
        SELECT o.uri, o."offset", line, least(o."offset" - start_char_offset, n) AS char FROM o JOIN lines l ON l.uri = o.uri AND o."offset" >= start_char_offset
        AND (o."offset" < start_char_offset + n + length(terminator) OR terminator = '' AND o."offset" = start_char_offset + n)""",
    "position_to_offset": f"""WITH {LINES}, a AS (SELECT *, unnest(list_distinct([n // 2, n, n + 1])) AS char FROM lines)
        SELECT uri, line, char, CASE WHEN char <= n THEN start_char_offset + char END AS strict_offset, start_char_offset + least(char, n) AS clamped_offset FROM a""",
    "occurrence_facts": f"WITH {OCC} SELECT uri, line, count(*) AS words, CAST(sum(start_char) AS BIGINT) AS starts, max(end_char) AS last_end, min(symbol_id) AS first_symbol FROM occ GROUP BY uri, line",
    "symbol_facts": f"WITH {DEF} SELECT scope_id, id, name, kind, language, uses FROM sym",
    "workspace_symbols": f"""WITH {DEF} SELECT name, language, kind, scope_id, id, uri, line, start_char, end_char, 'exact' AS status
        FROM sym WHERE kind <> 'module_graph_node' AND contains(lower(name), 'tion') ORDER BY lower(name), language, name, scope_id, id LIMIT 100""",
    "overlay_symbols": f"""WITH {DEF} SELECT scope_id, id, name, uri, line, start_char, end_char FROM sym WHERE kind <> 'module_graph_node' AND contains(lower(name), 'tion') ORDER BY lower(name), scope_id, id LIMIT 100""",
    "symbol_search_parts": """WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS language, lower(p_type || ' ' || ['Class', 'interface class', 'METHOD', 'x'][p_partkey % 4 + 1]) AS k FROM part)
        SELECT id, name, language, CASE WHEN contains(k, 'interface') THEN 'interface' WHEN contains(k, 'class') THEN 'class' WHEN contains(k, 'method') THEN 'method' ELSE 'variable' END AS kind
        FROM p WHERE contains(lower(name), 'a') ORDER BY lower(name), language, name, id LIMIT 100""",
    "definition_at": f"WITH {TARGETS} SELECT query_id, symbol_id, uri, line, start_char, end_char FROM target JOIN roles USING (scope_id, symbol_id) WHERE role = 'definition'",
    "ambiguous_positions": f"""WITH {TARGETS}, wide AS (SELECT doc_id FROM lines WHERE line = 0 AND len(string_split(line_text, ' ')) > 40 AND n > 0)
        SELECT f.doc_id AS query_id, CASE WHEN t.symbol_id IS NOT NULL THEN CASE WHEN w.doc_id IS NOT NULL AND l.n = length(t.symbol_id) THEN NULL ELSE t.scope_id || '|' || t.symbol_id END WHEN w.doc_id IS NOT NULL THEN 'line|0' END AS narrowest,
          CASE WHEN t.symbol_id IS NULL AND w.doc_id IS NULL THEN 'unknown' ELSE 'exact' END AS narrowest_status,
          CASE WHEN (t.symbol_id IS NULL) = (w.doc_id IS NULL) THEN 'unknown' ELSE 'exact' END AS strict_status
        FROM files f JOIN lines l ON l.doc_id = f.doc_id AND l.line = 0 LEFT JOIN target t ON t.query_id = f.doc_id LEFT JOIN wide w ON w.doc_id = f.doc_id""",
    "document_symbols_parent": f"""WITH {LINES}, p AS (SELECT uri, line * 3 AS i, unnest([1, 2, 3]) AS k FROM lines WHERE n >= 8)
        SELECT uri, i + k AS node_id, CASE WHEN k = 1 THEN 0 ELSE i + 1 END AS parent_id FROM p UNION ALL SELECT uri, 0, NULL FROM files""",
    "token_delta_encoding": f"""WITH {OCC}, d AS (SELECT uri, line - coalesce(lag(line) OVER w, 0) AS dl, CASE WHEN lag(line) OVER w = line THEN start_char - lag(start_char) OVER w ELSE start_char END AS ds FROM occ WINDOW w AS (PARTITION BY uri ORDER BY line, start_char))
        SELECT uri, count(*) AS tokens, CAST(sum(dl) AS BIGINT) AS lines, CAST(sum(ds) AS BIGINT) AS starts, max(ds) AS widest FROM d GROUP BY uri""",
    "edit_set_conflicts": f"""WITH {LINES}, e AS (SELECT uri, x.* FROM (SELECT uri, unnest([{{'edit_id': line * 3, 's': start_char_offset, 'e': start_char_offset + least(n, 10)}}, {{'edit_id': line * 3 + 1, 's': start_char_offset + n // 2, 'e': start_char_offset + n // 2 + 3}}, {{'edit_id': line * 3 + 2, 's': start_char_offset + n, 'e': start_char_offset + n}}]) AS x FROM lines))
        SELECT a.uri, a.edit_id AS first_edit, b.edit_id AS second_edit FROM e a JOIN e b ON a.uri = b.uri AND a.edit_id < b.edit_id AND (a.s < b.e AND b.s < a.e OR a.s = a.e AND b.s = b.e AND a.s = b.s)""",
    "virtual_to_host": f"""WITH {LINES}, s AS (SELECT uri AS key, line, start_char_offset AS hs, start_char_offset + CASE WHEN line % 3 = 2 THEN n // 2 ELSE n END AS he, n,
          CAST(coalesce(sum(n) OVER (PARTITION BY uri ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS vs FROM lines WHERE n > 0),
        m AS (SELECT key, max(vs + n) AS m FROM s GROUP BY key), p AS (SELECT key, unnest(list_distinct([m // 4, m // 2, m - 1, m])) AS "offset" FROM m)
        SELECT p.key, p."offset", least(hs + p."offset" - vs, he) AS host_offset, CASE WHEN s.key IS NULL THEN 'unmapped' WHEN he - hs = n THEN 'exact' ELSE 'many-to-one' END AS quality
        FROM p LEFT JOIN s ON s.key = p.key AND p."offset" >= vs AND p."offset" < vs + n""",
    "stale_occurrences": f"""WITH {OCC} SELECT uri, CASE WHEN language = 'de' THEN 'missing file' ELSE 'content changed' END AS reason, count(*) AS n FROM occ WHERE language IN ('de', 'fr') GROUP BY ALL""",
    "coverage_gaps": f"WITH {COVERAGE} SELECT scope_id, fact FROM coverage WHERE fact IN ('symbol', 'definition', 'reference', 'include') AND state <> 'complete'",
    "missing_facts": f"WITH {COVERAGE} SELECT scope_id, fact FROM coverage WHERE state <> 'complete'",
    "coverage_state": f"""WITH {FILES}, r AS (SELECT scope_id, unnest(['call', 'include']) AS fact, max(CASE language WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END) AS k FROM files GROUP BY scope_id)
        SELECT scope_id, fact, CASE WHEN fact = 'include' THEN 'unavailable' ELSE ['complete', 'incomplete_known_subset', 'unknown', 'unavailable'][k + 1] END AS state, ['en', 'de', 'fr', 'es'][k + 1] AS reason FROM r""",
    "coverage_folded": f"""WITH {FILES}, e AS (SELECT scope_id, language, min(doc_id) AS seq FROM files WHERE language IN ('de', 'fr') GROUP BY ALL)
        SELECT scope_id, 'call' AS fact, CASE arg_min(language, seq) WHEN 'de' THEN 'incomplete_known_subset' ELSE 'unknown' END AS state, arg_min(language, seq) AS reasons FROM e GROUP BY scope_id""",
    "pinned_tools_division": "SELECT l_orderkey AS order_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)",
    "unresolved_references": "WITH " + DEF + """, u AS (SELECT scope_id, symbol_id, count(*) AS n FROM occ GROUP BY ALL)
        SELECT scope_id, symbol_id, n, right(scope_id, 1) IN ('0','2','4','6','8') AS is_error FROM u WHERE symbol_id NOT IN (SELECT id FROM sym WHERE kind <> 'constant' AND uses > 2)""",
    "duplicate_declarations": f"WITH {DEF} SELECT id, count(DISTINCT scope_id) AS scopes, min(scope_id) AS first_scope FROM sym GROUP BY id HAVING count(DISTINCT scope_id) > 1",
    "call_edges": f'WITH {CALLS} SELECT uri AS source_uri, count(*) AS calls, count(DISTINCT "to") AS callees, CAST(sum(start_char) AS BIGINT) AS starts FROM calls GROUP BY uri',
    "caller_counts": f'WITH {CALLS} SELECT scope_id, "to", count(*) AS calls, count(DISTINCT "from") AS callers FROM calls GROUP BY ALL',
    "symbol_documents": f"WITH {DEF} SELECT scope_id, id, uri AS document, false AS external FROM sym",
    "module_closure": f"WITH {MODULES} SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM edges UNION SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src",
    "project_references": f"""WITH {MODULES}, reach AS (SELECT DISTINCT src AS root, dst AS node FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src)
        SELECT root, count(*) AS reached, bool_or(node NOT IN (SELECT src FROM edges)) AS dangling, false AS cyclic, CASE WHEN bool_or(node NOT IN (SELECT src FROM edges)) THEN 'unknown' ELSE 'exact' END AS status FROM reach GROUP BY root""",
    "interface_implementations": """WITH m AS (SELECT DISTINCT l_suppkey AS type, l_returnflag AS f, l_linestatus AS s FROM lineitem), i AS (SELECT DISTINCT l_linestatus AS interface, l_returnflag AS f, l_linestatus AS s FROM lineitem)
        SELECT type, interface FROM m JOIN i USING (f, s) JOIN (SELECT interface, count(*) AS need FROM i GROUP BY 1) USING (interface) GROUP BY type, interface, need HAVING count(*) = need""",
    "loss_counts": f"WITH {CALLS} SELECT 'call' AS kind, count(*) AS lost FROM calls UNION ALL SELECT 'module', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) UNION ALL SELECT 'import', count(*) FROM lineitem",
    "record_violations": f"""WITH {OCC}, v AS (SELECT uri, 'symbol_id is not valid text' AS violation FROM occ WHERE length(symbol_id) = 1
        UNION ALL SELECT uri, 'range is not in order' FROM occ WHERE start_char = 0 UNION ALL SELECT uri, 'source_hash is not a digest' FROM occ WHERE language = 'fr'
        UNION ALL SELECT uri, 'role is unknown' FROM occ WHERE language = 'es') SELECT violation, count(*) AS n, count(DISTINCT uri) AS documents FROM v GROUP BY violation""",
    "generation_gates": f"""WITH {DEF}, dup AS (SELECT id FROM sym WHERE uses > 1 GROUP BY id HAVING count(DISTINCT scope_id) > 1)
        SELECT 'repeated_scope' AS gate, 0 AS violations UNION ALL SELECT 'coverage', 0 UNION ALL SELECT 'coverage_state', 0 UNION ALL SELECT 'declared_twice', (SELECT count(*) FROM dup)
        UNION ALL SELECT 'unresolved', (SELECT count(*) FROM roles WHERE role = 'reference' AND right(scope_id, 1) IN ('0','2','4','6','8') AND symbol_id NOT IN (SELECT id FROM sym WHERE uses > 1))
        UNION ALL SELECT 'unknown_scope', 0 UNION ALL SELECT 'source_hash', 0""",
    "kpi_by_language": f"WITH {KPI} SELECT *, CASE WHEN status = 'observed' THEN CAST(numerator AS DOUBLE) / denominator END AS value FROM k",
    "kpi_records": f"WITH {KPI} SELECT language, bool_and(status = 'observed') AS complete, bool_or(status = 'invalid') AS invalid FROM k GROUP BY language",
    "error_buckets": f"""WITH {LOG}, b AS (SELECT method AS event_type, CASE WHEN k % 5 <> 0 AND (k % 3 = 0 OR method = 'purchase' AND k % 11 = 0) THEN 1 ELSE 0 END AS wrong_edit, CASE WHEN NOT latency_ms < 50 THEN 1 ELSE 0 END AS stale,
          CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS wrong_file, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS unmapped, CASE WHEN method = 'error' THEN 1 ELSE 0 END AS invalid FROM log),
        s AS (SELECT event_type, CAST(sum(wrong_edit) AS BIGINT) AS wrong_edit, CAST(sum(stale) AS BIGINT) AS stale_edit, CAST(sum(wrong_file) AS BIGINT) AS wrong_file_location, CAST(sum(unmapped) AS BIGINT) AS position_mapping_error, CAST(sum(invalid) AS BIGINT) AS protocol_invalid_response, CAST(sum(stale) AS BIGINT) AS snapshot_mixing FROM b GROUP BY 1)
        SELECT *, wrong_edit + stale_edit + wrong_file_location + position_mapping_error + protocol_invalid_response + snapshot_mixing AS total FROM s""",
    "conformance_score": f"WITH {CHECKS} SELECT domain, category, items, round(score, 9) AS score FROM scores",
    "conformance_regressions": f"WITH {CHECKS} SELECT domain, category, round(score, 9) AS score, round(score + 0.1, 9) AS base FROM scores WHERE category = 'Y1'",
    "report_decision": """SELECT o_orderpriority, o_custkey % 50 AS g, CASE WHEN bool_or(o_orderstatus NOT IN ('F', 'O')) THEN 'running' WHEN bool_or(o_orderstatus = 'O') THEN 'not_verified' ELSE 'passed' END AS decision FROM orders GROUP BY ALL""",
    "triage_classes": f"WITH {LOG} SELECT method AS event_type, ['upstream_bug', 'build_context', 'semantic_difference', 'engine_bug', 'upstream_bug'][k % 5 + 1] AS class, count(*) AS n FROM log GROUP BY ALL",
    "evidence_last_64": f"""WITH {LOG} SELECT request_id AS id, "at", method, client FROM log ORDER BY "at" DESC, request_id DESC LIMIT 64""",
    "evidence_by_method": f"WITH {LOG} SELECT method, count(*) AS n, round(sum(latency_ms), 4) AS total_ms, max(latency_ms) AS max_ms FROM log GROUP BY method",
    "latency_nearest_rank": f"WITH {LOG} SELECT method, count(latency_ms) AS n, {discs('latency_ms')} FROM log GROUP BY method",
    "latency_floor_rank": f"WITH {LOG} SELECT method, count(latency_ms) AS n, {floors('latency_ms')} FROM log GROUP BY method",
    "latency_all_windows": f"WITH {LOG} SELECT client, method, count(latency_ms) AS n, {floors('latency_ms')} FROM log GROUP BY client, method",
    "latency_minute_windows": f"""WITH {LOG} SELECT date_trunc('minute', "at") AS minute, method, count(*) AS n, round(sum(latency_ms), 4) AS total_ms, max(latency_ms) AS max_ms FROM log GROUP BY ALL""",
    "resource_windows": f"WITH {DAYS} SELECT * FROM days",
    "theil_sen_trend": f"WITH {DAYS} SELECT round(median((b.y - a.y) / (b.x - a.x)), 9) AS slope, count(*) AS pairs FROM points a JOIN points b ON a.x < b.x",
    "rolling_trends": f"""WITH {DAYS}, r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, y FROM points), t AS (SELECT c.x, c.i, (SELECT median((b.y - a.y) / (b.x - a.x)) FROM r a JOIN r b ON a.x < b.x WHERE a.i > c.i - 10 AND b.i <= c.i) AS slope, (SELECT min(x) FROM r a WHERE a.i > c.i - 10) AS low FROM r c)
        SELECT x, round(slope, 9) AS slope, round(slope * (x - low), 9) AS growth, least(i, 10) AS windows, coalesce(i >= 10 AND slope * (x - low) >= 5.0, false) AS trips FROM t""",
    "slo_exceptions": f"""WITH {LOG}, q AS (SELECT method AS key, {discs('latency_ms')} FROM log GROUP BY method) SELECT key, p50 <= 40 AND p95 <= 90 AND p99 <= 300 AS eligible, 3 AS measured FROM q""",
    "scaling_curve": """WITH p AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS size, sum(o_totalprice) AS elapsed FROM orders GROUP BY 1), f AS (SELECT size, elapsed / lag(elapsed) OVER (ORDER BY size) AS factor FROM p)
        SELECT size, round(factor, 6) AS factor, coalesce(factor <= 1.05, true) AS within FROM f""",
    "gap_detection": """WITH g AS (SELECT user_id, event_id AS id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS gap_us FROM events) SELECT * FROM g WHERE gap_us < 0 OR gap_us > 86400000000""",
    "progress_stalls": """WITH p AS (SELECT user_id, ts, event_id, floor(value / 10) AS done FROM events), r AS (SELECT *, CASE WHEN done > coalesce(lag(done) OVER w, -1) THEN ts END AS grew FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        x AS (SELECT *, max(grew) OVER w AS last_growth, min(ts) OVER w AS since FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT user_id, event_id AS id, last_growth FROM x WHERE epoch_us(ts) - epoch_us(last_growth) > 86400000000 AND epoch_us(ts) - epoch_us(since) >= 86400000000""",
    "cost_class_caps": """WITH m AS (SELECT user_id % 9 AS workers, event_type FROM events), t(event_type, method, cost, priority, share) AS (VALUES ('click', 'textDocument/hover', 'tiny', 'P1-hover', 1.0), ('purchase', 'textDocument/rename', 'medium', 'P1-references', 0.75),
        ('error', 'workspace/symbol', 'large', 'P5-maintenance', 0.5), ('signup', 'server/reindex', 'very_large', 'P5-maintenance', 0.25), ('view', 'textDocument/definition', 'small', 'P1-definition', 1.0))
        SELECT method, cost, priority, workers, count(*) AS n, CAST(greatest(1, floor(greatest(workers, 1) * share)) AS BIGINT) AS cap FROM m JOIN t USING (event_type) GROUP BY method, cost, priority, workers, share""",
    "coalesced_requests": f"""WITH RECURSIVE {LOG}, r AS (SELECT *, epoch_us("at") AS t, row_number() OVER (PARTITION BY client, method ORDER BY "at", request_id) AS i FROM log),
        l AS (SELECT client, method, i, request_id, request_id AS leader_id, t + 129600000000 AS until FROM r WHERE i = 1
          UNION ALL SELECT r.client, r.method, r.i, r.request_id, CASE WHEN r.t < l.until THEN l.leader_id ELSE r.request_id END, CASE WHEN r.t < l.until THEN l.until ELSE r.t + 129600000000 END FROM l JOIN r ON r.client = l.client AND r.method = l.method AND r.i = l.i + 1)
        SELECT request_id, leader_id FROM l""",
    "token_bucket": f"""WITH RECURSIVE {LOG}, r AS (SELECT *, epoch_us("at") AS t, row_number() OVER (PARTITION BY client ORDER BY "at", request_id) AS i FROM log),
        l AS (SELECT client, i, request_id, t, CAST(1.0 AS DOUBLE) AS left_, true AS allowed FROM r WHERE i = 1
          UNION ALL SELECT client, i, request_id, t, CASE WHEN f >= 1 THEN f - 1 ELSE f END, f >= 1 FROM (SELECT r.client, r.i, r.request_id, r.t, least(CAST(2 AS DOUBLE), l.left_ + CAST(r.t - l.t AS DOUBLE) / 1e6 * (CAST(1 AS DOUBLE) / 43200)) AS f FROM l JOIN r ON r.client = l.client AND r.i = l.i + 1))
        SELECT request_id, allowed FROM l""",
    "stale_results": f"""WITH {LOG}, s AS (SELECT request_id AS id, k AS revision, max(k) OVER (PARTITION BY client ORDER BY "at", request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM log) SELECT *, coalesce(revision >= seen, true) AS accepted FROM s""",
    "latest_snapshot": f"""WITH {LOG} SELECT client, arg_max(request_id, {{'a': "at", 'i': request_id}}) AS id, arg_max(method, {{'a': "at", 'i': request_id}}) AS method FROM log GROUP BY client""",
    "debounced_diagnostics": f"""WITH {LOG}, g AS (SELECT *, CASE WHEN epoch_us("at") - epoch_us(lag("at") OVER w) < 43200000000 THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY client ORDER BY "at", request_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY client ORDER BY "at", request_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT client, count(*) AS n, arg_max(request_id, {{'a': "at", 'i': request_id}}) AS last_id FROM s GROUP BY client, run""",
    "quiet_memo": f"""WITH {LOG}, g AS (SELECT *, CASE WHEN method IS NOT DISTINCT FROM lag(method) OVER w THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY client ORDER BY "at", request_id)),
        s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY client ORDER BY "at", request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g)
        SELECT client, run, min(method) AS value, count(*) AS n, count(*) >= 2 AND epoch_us(max("at")) - epoch_us(min("at")) >= 3600000000 AS admitted FROM s GROUP BY client, run""",
    "concurrent_requests": f"""WITH {LOG}, p AS (SELECT epoch_us("at") AS t, 1 AS d, request_id FROM log UNION ALL SELECT epoch_us("at") + 600000000, -1, request_id FROM log), s AS (SELECT *, CAST(sum(d) OVER (ORDER BY t, d, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM p)
        SELECT request_id, running, running <= 3 AS admitted FROM s WHERE d = 1""",
    "memory_ladder": """WITH u AS (SELECT user_id, sum(value) AS used FROM events GROUP BY 1), b AS (SELECT used / ((SELECT max(used) FROM u) * 0.95) AS s FROM u)
        SELECT CASE WHEN s >= 1 THEN 'critical' WHEN s >= 0.9 THEN 'reject' WHEN s >= 0.8 THEN 'throttle' WHEN s >= 0.7 THEN 'evict' ELSE 'normal' END AS band, count(*) AS n FROM b GROUP BY 1""",
    "retained_generations": """SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS generation, count(*) AS rows FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 3""",
    "lru_cache": """WITH e AS (SELECT user_id AS key, count(*) AS bytes, max(epoch_us(ts)) AS last_used FROM events GROUP BY 1), s AS (SELECT *, sum(bytes) OVER w AS upto, row_number() OVER w AS place FROM e WINDOW w AS (ORDER BY last_used DESC, key ROWS UNBOUNDED PRECEDING))
        SELECT key, bytes, place FROM s WHERE upto <= 500 AND place <= 20""",
    "uri_canonical": f"""WITH {FILES} SELECT upper(substr(url, 1, 4)) || substr(url, 5) AS raw, lower(substr(url, 1, 4)) || substr(url, 5) AS canonical FROM pages
        UNION ALL SELECT 'FILE:///C:/Src%7E' || doc_id || '/a%2fb%41.py', 'file:///c:/Src~' || doc_id || '/a%2FbA.py' FROM files UNION ALL SELECT 'file://Host' || doc_id || '/x%20y?Q', 'file://host' || doc_id || '/x%20y?Q' FROM files""",
    "uri_containment": f"""WITH {FILES}, r AS (SELECT uri, ['doc:///src1', 'DOC:///src1/', 'doc:///src', 'doc:///'][doc_id % 4 + 1] AS root FROM files), b AS (SELECT *, rtrim(lower(substr(root, 1, 3)) || substr(root, 4), '/') AS base FROM r)
        SELECT uri, root, uri = base OR starts_with(uri, base || '/') AS inside FROM b""",
    "redacted_text": f"""WITH t AS (SELECT 'document' AS kind, doc_id AS id, regexp_replace(text, '{SECRET}', '\\1=[REDACTED]', 'gi') AS t FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, regexp_replace(text, '{SECRET}', '\\1=[REDACTED]', 'gi') FROM conversations)
        SELECT kind, id, (length(t) - length(replace(t, '[REDACTED]', ''))) // 10 AS hidden, sha256(t) AS sha256 FROM t""",
    "diagnostic_set_digest": f"""WITH h0 AS (SELECT user_id, sha256(event_type || '|' || event_id) AS x FROM events), leaf AS (SELECT user_id, {leaves("x", "x", "x")} FROM h0 GROUP BY user_id, leaf)
        SELECT user_id, substr(sha256(string_agg(h, chr(10) ORDER BY leaf)), 1, 24) AS digest, CAST(sum(n) AS BIGINT) AS items FROM leaf GROUP BY user_id""",
    "replay_binding": """WITH e AS (SELECT conv_id AS session, turn AS seq, CASE role WHEN 'user' THEN 'in' ELSE 'out' END AS dir, turn // 4 AS request_id FROM conversations WHERE role IN ('user', 'assistant')),
        w AS (SELECT *, lag(dir) OVER x AS b, lead(dir) OVER x AS a, lead(seq) OVER x AS an FROM e WINDOW x AS (PARTITION BY session, request_id ORDER BY seq)),
        s AS (SELECT *, CASE WHEN dir = 'in' AND b = 'in' THEN 'reused' WHEN dir = 'in' AND a = 'out' THEN 'answered' WHEN dir = 'in' THEN 'unanswered' WHEN coalesce(b, '') <> 'in' THEN 'unrequested' END AS status FROM w)
        SELECT session, request_id, seq, status, CASE WHEN status = 'answered' THEN an END AS response_seq FROM s WHERE status IS NOT NULL""",
    "replay_zip_compare": """WITH a AS (SELECT conv_id AS session, turn AS seq, text AS payload FROM conversations WHERE role = 'assistant'), b AS (SELECT session, seq, CASE WHEN length(payload) > 700 THEN regexp_replace(payload, '[aeiou]', '', 'g') ELSE payload END AS payload FROM a WHERE seq < 7),
        l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM b),
        z AS (SELECT coalesce(l.session, r.session) AS session, count(l.i) AS n_left, count(r.i) AS n_right, min(CASE WHEN l.payload <> r.payload THEN l.i END) AS d FROM l FULL JOIN r ON l.session = r.session AND l.i = r.i GROUP BY 1)
        SELECT session, n_left, n_right, CASE WHEN n_left <> n_right THEN 'count_mismatch' WHEN d IS NOT NULL THEN 'diverged' ELSE 'equal' END AS status, CASE WHEN n_left = n_right THEN d END AS first_difference FROM z""",
    "union_distinct_symbols": f"WITH {OCC} SELECT DISTINCT symbol_id AS name FROM occ UNION SELECT name FROM (SELECT unnest(string_split(lower(text), ' ')) AS name FROM benchmark) WHERE name <> ''",
    "merged_diagnostics": """WITH d AS (SELECT 0 AS source_rank, '' AS plugin_id, lang AS message, doc_id AS id FROM documents UNION ALL SELECT 1, 'b', 'benchmark', item_id FROM benchmark UNION ALL SELECT 1, 'a', 'label', doc_id FROM labels)
        SELECT source_rank, plugin_id, message, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM d GROUP BY ALL""",
    "files_outside_projects": f"WITH {FILES} SELECT uri FROM files f WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE 'doc:///src' || n_nationkey LIKE '%1%' AND starts_with(f.uri, 'doc:///src' || n_nationkey || '/'))",
    "scip_roundtrip": f"""WITH {DEF} SELECT uri, count(*) AS n, count(*) FILTER (role = 'definition') AS definitions, CAST(sum(start_char) AS BIGINT) AS starts, max(scope_id || '/' || symbol_id) AS last_symbol FROM roles GROUP BY uri""",
    "scip_documents": f"WITH {DEF} SELECT uri AS relative_path, language, count(*) AS occurrences, count(*) FILTER (role = 'definition') AS symbols FROM roles GROUP BY uri, language",
    "completeness_witness": f"""WITH {OCC}, c AS (SELECT count(DISTINCT uri) AS documents, count(DISTINCT (scope_id, symbol_id)) AS symbols, count(*) AS occurrences FROM occ)
        SELECT *, (SELECT count(*) FROM documents) AS claimed_documents, 0 AS claimed_symbols, 0 AS claimed_occurrences, (SELECT count(*) FROM labels WHERE quality > 1) AS blockers, false AS complete FROM c""",
}

_REFERENCES = """SELECT query_id, count(*) AS places, count(DISTINCT uri) AS documents, min(line) AS least_line, CAST(sum(start_char) AS BIGINT) AS starts FROM target JOIN roles USING (scope_id, symbol_id) WHERE role IN ({roles}) GROUP BY query_id"""
SQL["references_at"] = f"WITH {TARGETS} " + _REFERENCES.format(roles="'reference'")
SQL["references_at_with_decl"] = f"WITH {TARGETS} " + _REFERENCES.format(roles="'reference', 'definition', 'declaration'")
_STREAKS = """r AS (SELECT user_id, ts, event_id, event_type IN ('error', 'click') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r WHERE bad), s AS (SELECT user_id, min(event_id) AS first_id, count(*) AS length FROM b GROUP BY user_id, island)"""
SQL["crash_streaks"] = f"WITH {_STREAKS} SELECT user_id, first_id, length, length >= 4 AS quarantined FROM s"
SQL["restart_waits"] = f"WITH {_STREAKS} SELECT user_id, first_id, CAST(least(10000, 100 * pow(2, least(length - 1, 30))) AS BIGINT) AS wait_ms FROM s"
