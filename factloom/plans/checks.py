"""Further registered queries, each beside its SQL: gates, memos, schedules, columns, digests and paths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import positions, text, uri
from factloom.operators import diff, facts, filters, gates, intervals, sets, telemetry
from factloom.plans import oracle
from factloom.plans.queries import _indexed_targets, files_of, load, log_of, occurrences_of, replay_zip_compare, versions, with_roles_of
from factloom.plans.store import FactStore
from factloom.sources import tables, workspace
from factloom.storage import fixed, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def pick(values: list, number) -> F.Column:
    """One of the values, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


# ---- rows of records


@query(f"WITH {oracle.OCC} SELECT uri, count(*) AS n FROM occ WHERE language = 'es' OR language IS NULL AND line = 0 GROUP BY uri")
def unknown_roles(spark, d):
    role = F.when(F.col("language") == "es", "use").when(F.col("language").isNull() & (F.col("line") == 0), F.lit(None)).otherwise("reference")
    return filters.unknown_roles(occurrences_of(spark, d).withColumn("role", role)).groupBy("uri").agg(F.count("*").alias("n"))


@query(f"WITH {oracle.LINES} SELECT uri, count(*) AS n, min(line) AS least FROM lines WHERE line + line % 3 >= 2 AND line <= 5 GROUP BY uri")
def diagnostics_in_lines(spark, d):
    lines = positions.line_table(files_of(spark, d))
    rows = lines.select("uri", "line", F.struct(F.col("line").alias("start_line"), (F.col("line") + F.col("line") % 3).alias("end_line")).alias("range"))
    return filters.in_lines(rows, 2, 5).groupBy("uri").agg(F.count("*").alias("n"), F.min("line").alias("least"))


@query("SELECT event_id AS id FROM events WHERE user_id = 7 AND event_type = 'click'")
def evidence_of_a_file(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("doc:///"), F.col("user_id").cast("string")).alias("uri"), F.col("event_type").alias("method"))
    return filters.by_uri_and_method(rows, "doc:///7", "click").select("id")


@query("SELECT o_custkey AS owner, o_orderkey AS id, o_orderstatus AS mark FROM orders")
def exploded_evidence(spark, d):
    results = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("mark"))).alias("evidence"))
    return filters.each_evidence(results).select("owner", "evidence.id", "evidence.mark")


@query(r"""WITH p AS (SELECT doc_id, source || '/' || coalesce(lang, '') AS package FROM documents)
    SELECT doc_id, regexp_matches(package, '^src1.*/en$') AS inner_dots, regexp_matches(package, '^src2(/.*)?$') AS trailing_dots, package = 'src3/de' AS plain FROM p""")
def package_patterns(spark, d):
    p = F.concat(F.col("source"), F.lit("/"), F.coalesce("lang", F.lit("")))
    return load(spark, d, "documents").select("doc_id", filters.package_matches(p, "src1.../en").alias("inner_dots"), filters.package_matches(p, "src2/...").alias("trailing_dots"), filters.package_matches(p, "src3/de").alias("plain"))


@query("SELECT event_id AS id, 0::BIGINT AS snapshot_rev FROM events")
def persisted_identity(spark, d):
    return filters.without_local_revision(load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("snapshot_rev")))


@query("""SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'unregistered' ELSE 'expired' END AS reason
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_nationkey < 10""")
def unregistered_flags(spark, d):
    flags = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("flag"))
    registry = load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("flag"), F.col("c_nationkey").alias("expires"))
    return filters.unregistered_flags(flags, registry, F.lit(10)).select("id", "reason")


@query("""WITH have AS (SELECT DISTINCT p_type AS package, 'Test' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS name FROM part WHERE p_brand NOT LIKE '%3')
    SELECT DISTINCT p_type AS package, 'Test' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS name FROM part EXCEPT SELECT * FROM have""")
def missing_tests(spark, d):
    name = F.concat(F.lit("Test"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    parts = load(spark, d, "part").select(F.col("p_type").alias("package"), name.alias("name"), "p_brand")
    lines = parts.select("package", F.concat(F.when(F.col("p_brand").endswith("3"), "// func ").otherwise("func "), "name", F.lit("(t *testing.T) {")).alias("line_text"))
    return filters.missing_tests(parts.select("package", "name").distinct(), lines)


@query(f"""WITH {oracle.LINES}, s AS (SELECT uri, line, start_char_offset AS a, start_char_offset + n AS b FROM lines WHERE n >= 8),
    t AS (SELECT uri, unnest([{{'x': a + 1, 'y': a + 4}}, {{'x': b - 2, 'y': b + 3}}]) AS p FROM s), u AS (SELECT DISTINCT uri, p.x, p.y FROM t)
    SELECT u.uri AS key, x AS start, y AS "end", count(s.uri) = 1 AND count(*) FILTER (line % 2 = 0) = 1 AS safe FROM u LEFT JOIN s ON u.uri = s.uri AND a <= x AND y <= b GROUP BY ALL""")
def safe_spans(spark, d):
    lines = positions.line_table(files_of(spark, d)).withColumn("n", F.char_length("line_text").cast("long")).where("n >= 8")
    a, b = F.col("start_char_offset"), F.col("start_char_offset") + F.col("n")
    segments = lines.select(F.col("uri").alias("key"), a.alias("host_start"), b.alias("host_end"), F.when(F.col("line") % 2 == 0, "exact").otherwise("many-to-one").alias("quality"))
    spans = lines.select(F.col("uri").alias("key"), F.explode(F.array(F.struct((a + 1).alias("start"), (a + 4).alias("end")), F.struct((b - 2).alias("start"), (b + 3).alias("end")))).alias("p")).select("key", "p.*").distinct()
    return filters.safe_spans(spans, segments)


# ---- memos, tools and diagnostics

_DEPENDENTS = "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"


def _memo(spark, d):
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    keys = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 100).alias("revision"), F.array(one("customer", "o_custkey"), one("order", "o_orderkey")).alias("deps"))
    changed = load(spark, d, "customer").where("c_nationkey = 3").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return keys, changed


@query(f"SELECT DISTINCT o_orderkey AS key FROM ({_DEPENDENTS})")
def memo_dependents(spark, d):
    return sets.memo_dependents(*_memo(spark, d))


@query(f"SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 100 > 40 AND o_orderkey NOT IN ({_DEPENDENTS})")
def valid_memo(spark, d):
    return sets.valid_memo(*_memo(spark, d), 40).select("key")


@query("""WITH t AS (SELECT l_suppkey AS path, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS h FROM lineitem WHERE l_quantity > 48 GROUP BY 1)
    SELECT t.path, coalesce(n = 1 AND h = CASE WHEN s_suppkey % 2 = 0 THEN 'O' ELSE 'F' END, false) AS stable FROM t LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) s ON s_suppkey = t.path""")
def tools_by_path(spark, d):
    tools = load(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("path"), F.col("l_linestatus").alias("sha256"))
    current = load(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, "O").otherwise("F").alias("sha256"))
    return sets.tools_by_path(tools, current).select("path", "stable")


@query("""WITH o AS (SELECT o_custkey AS uri, o_orderkey AS id, year(o_orderdate) AS version, month(o_orderdate) AS epoch FROM orders),
    m AS (SELECT uri, max({'v': version, 'e': epoch}) AS m FROM o GROUP BY uri) SELECT id FROM o JOIN m ON o.uri = m.uri AND version = m.v AND epoch = m.e""")
def current_diagnostics(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("uri"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("version"), F.month("o_orderdate").alias("epoch"))
    return sets.current_diagnostics(rows, rows.select("uri", "version", "epoch")).select("id")


@query("SELECT event_type AS method, count(*) AS n FROM events WHERE value > 90 GROUP BY 1")
def overdue_requests(spark, d):
    return sets.overdue(log_of(spark, d), 90.0).groupBy("method").agg(F.count("*").alias("n"))


# ---- gates


@query("""SELECT c_custkey AS scope_id FROM customer WHERE NOT (c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0)""")
def wrong_build_context(spark, d):
    context = text.build_context_id(F.col("c_mktsegment"), F.col("c_name"))
    rows = load(spark, d, "customer").withColumn("own", F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(context))
    scopes = rows.select(F.col("c_custkey").alias("scope_id"), F.col("c_mktsegment").alias("language"), F.col("c_name").alias("canonical"), F.col("own").alias("build_context"))
    provenance = rows.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("scope_id"), F.when(F.col("c_custkey") % 11 == 0, "stale").otherwise(F.col("own")).alias("build_context"))
    return gates.wrong_build_context(scopes, provenance).select("scope_id")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0")
def fingerprint_changed(spark, d):
    before = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("fingerprint"))
    after = before.where("key % 10 <> 0").withColumn("fingerprint", F.when(F.col("key") % 7 == 0, "new").otherwise(F.col("fingerprint")))
    return gates.fingerprint_changed(before, after, ["key"]).select("key")


@query(f"WITH {oracle.VERSIONS} SELECT path AS uri FROM after WHERE path || sha256 NOT IN (SELECT path || sha256 FROM before)")
def identity_mismatch(spark, d):
    before, after = versions(spark, d)
    return gates.identity_mismatch(after.withColumnRenamed("path", "uri"), before.withColumnRenamed("path", "uri")).select("uri")


@query(f"WITH {oracle.VERSIONS} SELECT path AS uri FROM after WHERE path || sha256 NOT IN (SELECT path || sha256 FROM before)")
def overlay_mismatches(spark, d):
    before, after = versions(spark, d)
    language = F.lit("text").alias("language")
    return diff.overlay_mismatches(after.select(F.col("path").alias("uri"), language, "sha256"), before.select(F.col("path").alias("uri"), language, "sha256")).select("uri")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 3 OR o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""")
def triage_faults(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "engine_bug").when(k % 4 == 1, "upstream_bug").when(k % 4 == 2, "build_context").when(k % 8 == 3, "guess")
    reports = load(spark, d, "orders").select(k.alias("id"), kind.alias("classification"), F.when(k % 3 == 0, "TestIt").alias("regression_test"), F.when(k % 5 == 0, "waived").otherwise("").alias("waiver"))
    return gates.triage_faults(reports).select("id")


@query(f"""WITH z AS ({oracle.SQL['replay_zip_compare']}), c AS (SELECT DISTINCT conv_id AS session FROM conversations)
    SELECT session, CASE WHEN session % 5 = 0 THEN 'unbound' WHEN session % 7 = 0 THEN 'backend_changed' WHEN coalesce(status, '') <> 'equal' THEN 'diverged' ELSE 'reproduced' END AS status FROM c LEFT JOIN z USING (session)""")
def reproduction_status(spark, d):
    k = F.col("session")
    sessions = load(spark, d, "conversations").select(F.col("conv_id").alias("session")).distinct()
    bindings = sessions.select("session", F.when(k % 5 != 0, "one").alias("recorded"), F.when(k % 7 == 0, "two").otherwise("one").alias("current"))
    return gates.reproduction_status(bindings, replay_zip_compare(spark, d))


@query(r"""SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '^\p{Lu}') THEN 'exported symbol' WHEN p_size % 3 = 0 THEN 'name is taken' WHEN p_size % 5 = 0 THEN 'incomplete references' WHEN p_size % 7 = 0 THEN 'stale content' END AS refusal FROM part""")
def rename_refusals(spark, d):
    n = F.col("p_size")
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), gates.rename_refusals(text.exported(F.col("p_name")), n % 3 == 0, n % 5 != 0, n % 7 != 0).alias("refusal"))


@query(f"""WITH {oracle.VERSIONS} SELECT path, 'not captured' AS reason FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.path = b.path AND a.sha256 = b.sha256)
    UNION ALL SELECT path, 'outside the manifest' FROM after WHERE path NOT IN (SELECT path FROM before)""")
def witness_gaps(spark, d):
    before, after = versions(spark, d)
    return gates.witness_gaps(before, after, after.select("path"))


# ---- ranges and edits


@query("""SELECT o_orderkey AS round, leg, l_linenumber AS index, l_quantity AS quantity FROM (SELECT o_orderkey, unnest([{'leg': 0, 'a': 1, 'n': 2}, {'leg': 1, 'a': 3, 'n': 3}], recursive := true) FROM orders)
    JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber >= a AND l_linenumber < a + n""")
def sample_slices(spark, d):
    leg = lambda k, a, n: F.struct(F.lit(k).alias("leg"), F.lit(a).alias("sample_start"), F.lit(n).alias("sample_count"))
    legs = load(spark, d, "orders").select(F.col("o_orderkey").alias("round"), F.explode(F.array(leg(0, 1, 2), leg(1, 3, 3))).alias("x")).select("round", "x.*")
    samples = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("round"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("quantity"))
    return intervals.sample_slices(legs, samples)


@query(f"""WITH {oracle.LINES}, s AS (SELECT uri, length(text) // 2 AS half FROM files)
    SELECT l.uri, line, CASE WHEN start_char_offset + n <= half THEN start_char_offset + 100 END AS source_range_start, CASE WHEN start_char_offset + n <= half THEN start_char_offset + n + 100 END AS source_range_end FROM lines l JOIN s USING (uri)""")
def remapped_ranges(spark, d):
    files = files_of(spark, d)
    lines = positions.line_table(files)
    ranges = lines.select("uri", "line", F.col("start_char_offset").alias("start"), (F.col("start_char_offset") + F.char_length("line_text")).alias("end"))
    spans = files.select("uri", F.lit(0).cast("long").alias("gen_start"), F.floor(F.char_length("text") / 2).alias("gen_end"), F.concat("uri", F.lit(".source")).alias("source_uri"), F.lit(100).cast("long").alias("source_start"))
    return intervals.remapped(ranges, spans).select("uri", "line", "source_range_start", "source_range_end")


@query(f"WITH {oracle.TARGETS}, u AS (SELECT scope_id, symbol_id, count(*) AS edits FROM occ GROUP BY ALL) SELECT query_id, edits, 'renamed' AS new_text FROM target JOIN u USING (scope_id, symbol_id)")
def rename_edits(spark, d):
    """The symbol at the start of every document, renamed: the edits of a symbol are made once, whoever asks for them."""
    index, targets = _indexed_targets(spark, d)
    targets = fixed(targets)
    once = targets.groupBy(*facts.KEY).agg(F.min("query_id").alias("query_id"))
    edits = index.edits(once, "renamed").groupBy("query_id").agg(F.count("*").alias("edits"), F.min("new_text").alias("new_text"))
    return targets.select("query_id", *facts.KEY).join(once.join(edits, "query_id").drop("query_id"), facts.KEY).select("query_id", "edits", "new_text")


@query(f"""WITH {oracle.LINES}, x AS (SELECT uri, line, '😀é' || line_text AS t, n // 2 AS k, ['"unused-import"', '7', 'null', ' [1, 2] ', '"a\\"b"'][line % 5 + 1] AS raw FROM lines WHERE line BETWEEN 1 AND 6),
    c AS (SELECT *, CASE line % 5 WHEN 0 THEN 'unused-import' WHEN 1 THEN '7' WHEN 2 THEN '' WHEN 3 THEN '[1, 2]' ELSE 'a"b' END AS code FROM x)
    SELECT uri, line, code, CASE WHEN line = 5 THEN 'Remove unused import' ELSE 'About this diagnostic: ' || raw END AS title, CASE WHEN line = 5 THEN '' END AS new_text, line <> 5 AS explanation_only, 6 AS start_char, 6 + strlen(substr(t, 3, k)) AS end_char FROM c""")
def code_actions(spark, d):
    """A diagnostic on each line, its code as JSON of several kinds: actions for those in lines 1 to 6, in another encoding."""
    lines = positions.line_table(files_of(spark, d)).withColumn("line_text", F.concat(F.lit("😀é"), "line_text"))
    raw = F.element_at(F.array(*map(F.lit, ['"unused-import"', "7", "null", " [1, 2] ", '"a\\"b"'])), (F.col("line") % 5 + 1).cast("int"))
    start = F.lit(3).cast("long")
    span = F.struct(F.col("line").alias("start_line"), start.alias("start_char"), F.col("line").alias("end_line"), (start + F.floor((F.char_length("line_text") - 2) / 2)).alias("end_char"))
    diagnostics = lines.select("uri", span.alias("range"), text.diagnostic_code(raw).alias("code"), raw.alias("message"))
    found = positions.diagnostics_in(filters.code_actions(diagnostics, 1, 6), lines, "utf-8")
    return found.select("uri", F.col("range.start_line").alias("line"), "code", "title", "new_text", "explanation_only", "range.start_char", "range.end_char")


@query("""WITH u AS (SELECT CAST(l_linenumber AS VARCHAR) AS category, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used, CAST(CASE WHEN l_linenumber <= 2 THEN 0 ELSE 55 * count(*) END AS BIGINT) AS most FROM lineitem GROUP BY l_linenumber),
    t AS (SELECT CAST(sum(used) AS BIGINT) AS used, CAST(sum(most) AS BIGINT) AS most FROM u),
    a AS (SELECT l_returnflag AS asked_by, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY 1)
    SELECT category AS name, used, most, round(CASE WHEN most = 0 THEN 0.0 ELSE used / most END, 9) AS share, CAST(NULL AS VARCHAR) AS band, CAST(NULL AS BOOLEAN) AS admitted FROM u
    UNION ALL SELECT 'total', used, most, round(used / most, 9), CASE WHEN used / most >= 1 THEN 'critical' WHEN used / most >= 0.9 THEN 'reject' WHEN used / most >= 0.8 THEN 'throttle' WHEN used / most >= 0.7 THEN 'evict' ELSE 'normal' END, NULL FROM t
    UNION ALL SELECT 'ask ' || asked_by, bytes, NULL, NULL, NULL, (t.used + bytes) / t.most < 0.9 FROM a, t""")
def memory_by_category(spark, d):
    """Line numbers as categories of memory, one without a limit and one with a limit of 0: shares, the total's band, and what may still be had."""
    rows = load(spark, d, "lineitem")
    category = F.col("l_linenumber").cast("string").alias("category")
    limits = rows.where("l_linenumber > 1").groupBy(category).agg(F.when(F.min("l_linenumber") == 2, 0).otherwise(55 * F.count("*")).alias("most"))
    held = fixed(telemetry.memory(rows.select(category, F.col("l_quantity").cast("long").alias("bytes")), limits))
    asks = telemetry.admitted(rows.groupBy("l_returnflag").agg(F.sum(F.col("l_linenumber").cast("long")).alias("bytes")), held)
    none = lambda t: F.lit(None).cast(t)
    shown = held.select(F.coalesce("category", F.lit("total")).alias("name"), "used", "most", F.round("share", 9).alias("share"), "band", none("boolean").alias("admitted"))
    return shown.unionByName(asks.select(F.concat(F.lit("ask "), "l_returnflag").alias("name"), F.col("bytes").alias("used"), none("long").alias("most"), none("double").alias("share"), none("string").alias("band"), "admitted"))


@query(f"""WITH {oracle.LINES}, x AS (SELECT uri, line, '😀é' || line_text AS t, n, n // 2 AS k FROM lines)
    SELECT uri, line, 6 + strlen(substr(t, 3, k)) AS utf8, 2 + k AS utf32, CAST(NULL AS BIGINT) AS inside, CAST(NULL AS BIGINT) AS beyond FROM x""")
def columns_in_encodings(spark, d):
    """Lines behind a character outside the basic plane: the middle of each, a place inside the character, and one past the end."""
    lines = positions.line_table(files_of(spark, d)).withColumn("t", F.concat(F.lit("😀é"), "line_text"))
    n = F.char_length("line_text")
    at = lambda c, to: positions.convert_column(F.col("t"), c, to)
    middle = F.floor(n / 2) + 3
    return lines.select("uri", "line", at(middle, "utf-8").alias("utf8"), at(middle, "utf-32").alias("utf32"), at(F.lit(1), "utf-8").alias("inside"), at(n + 4, "utf-8").alias("beyond"))


@query(f"""WITH {oracle.FILES}, x AS (SELECT uri, text, length(text) AS n FROM files)
    SELECT uri, sha256(CASE WHEN n >= 20 THEN substr(text, 4, 10) ELSE '' END) AS part, sha256(substr(text, 1, n // 2) || '<😀>' || substr(text, n // 2 + least(3, n - n // 2) + 1)) AS one_edit,
      sha256(substr('ab' || text, 1, 1) || 'é' || substr('ab' || text, 2)) AS two_edits FROM x""")
def applied_edits(spark, d):
    t, n = F.col("text"), F.char_length("text")
    half = F.floor(n / 2)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    edit = lambda a, b, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new_text"))
    part = F.coalesce(positions.range_text(t, F.lit(3), F.when(n >= 20, 13).otherwise(n + 1)), F.lit(""))
    one = positions.spliced(t, half, half + F.least(F.lit(3), n - half), F.lit("<😀>"))
    two = positions.folded(t, F.array(edit(0, 0, "ab"), edit(1, 1, "é")))
    return files_of(spark, d).select("uri", sha(part).alias("part"), sha(one).alias("one_edit"), sha(two).alias("two_edits"))


@query(rf"""WITH {oracle.LINES} SELECT uri, line, nullif(regexp_extract(substr(line_text, 1, n // 2), '([\p{{L}}\p{{N}}_]*)$', 1) || regexp_extract(substr(line_text, n // 2 + 1), '^([\p{{L}}\p{{N}}_]*)', 1), '') AS name FROM lines""")
def identifiers_at(spark, d):
    lines = positions.line_table(files_of(spark, d))
    return lines.select("uri", "line", positions.identifier_at(F.col("line_text"), F.floor(F.char_length("line_text") / 2)).alias("name"))


# ---- telemetry


@query(f"WITH {oracle.DAYS} SELECT CAST(x AS BIGINT) AS minute, coalesce(x - lag(x) OVER (ORDER BY x) = 1, true) AS follows FROM points WHERE CAST(x AS BIGINT) % 9 <> 0")
def continuous_windows(spark, d):
    days = load(spark, d, "events").select(F.expr("unix_date(cast(ts as date))").cast("long").alias("minute")).distinct().where("minute % 9 <> 0")
    return telemetry.continuous(days)


@query("SELECT c_custkey AS key, c_nationkey AS inserted FROM customer ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 64")
def fifo_memo(spark, d):
    return telemetry.fifo(load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("inserted")), 64)


@query("""WITH m AS (SELECT user_id AS session, event_id % 5 AS token, min(event_id) FILTER (event_type = 'click') AS b, min(event_id) FILTER (event_type = 'view') AS e, min(event_id) FILTER (event_type NOT IN ('click', 'view')) AS r FROM events GROUP BY ALL)
    SELECT session, token FROM m WHERE NOT coalesce(b < e AND e < r, false)""")
def progress_faults(spark, d):
    kind = F.when(F.col("event_type") == "click", "begin").when(F.col("event_type") == "view", "end").otherwise("response")
    messages = load(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 5).alias("token"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return telemetry.progress_faults(messages).select("session", "token")


@query("""SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS request_id, unnest([{'phase': 'queue', 'ms': l_quantity}, {'phase': 'run', 'ms': CASE WHEN l_tax > 0.02 THEN l_tax END}], recursive := true) FROM lineitem) WHERE ms IS NOT NULL""")
def request_phases(spark, d):
    trace = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_quantity").alias("queue"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("run"))
    return telemetry.phases(trace, ["queue", "run"])


# ---- digests, names and paths


@query("""SELECT p_partkey AS id, substr(sha256(p_name || chr(0) || p_brand), 1, 24) AS short, p_brand || ':sha256:' || substr(sha256(p_name), 1, 32) AS build, sha256(CAST(to_json(list_sort([p_name, p_brand, p_type])) AS VARCHAR)) AS tools,
      sha256(CAST(to_json(list_sort([{'key': 'type', 'value': p_type}, {'key': 'brand', 'value': p_brand}])) AS VARCHAR)) AS config, p_partkey || '|' || p_name || '|' AS memo, p_size * 4294967296 + p_partkey AS packed, p_size - p_partkey AS delta FROM part""")
def value_digests(spark, d):
    c = F.col
    config = F.create_map(F.lit("type"), c("p_type"), F.lit("brand"), c("p_brand"))
    return load(spark, d, "part").select(
        c("p_partkey").alias("id"), text.short_digest([c("p_name"), c("p_brand")]).alias("short"), text.build_context_id(c("p_brand"), c("p_name")).alias("build"), text.tools_digest(F.array("p_type", "p_name", "p_brand")).alias("tools"),
        text.config_hash(config).alias("config"), text.memo_key(c("p_partkey"), c("p_name"), F.lit(None)).alias("memo"), text.packed_position(c("p_size"), c("p_partkey")).alias("packed"), text.signed_delta(c("p_size"), c("p_partkey")).alias("delta"),
    )


_EDGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema.EDGE_FACT.items())


@query(rf"""WITH x AS (SELECT p_partkey AS id, p_name, p_type, list_extract(['call', 'generated', 'module', 'other'], CAST(p_partkey % 4 + 1 AS BIGINT)) AS edge, list_extract(['Definition', 'DECLARATION', 'import', 'reference'], CAST(p_partkey % 4 + 1 AS BIGINT)) AS role,
      p_name || ' v1.' || p_size || '.0 (' || p_size % 3 || '.1)' AS t FROM part)
    SELECT id, list_sort(string_split(p_name, ' ')) = list_sort(list_reverse(string_split(p_name, ' '))) AS same, list_sort(string_split(p_name, ' ')) = list_sort(string_split(p_type, ' ')) AS other, CASE edge {_EDGES} END AS edge_fact,
      CASE WHEN lower(role) IN ('definition', 'declaration') THEN lower(role) ELSE 'reference' END AS occurrence_fact, contains(t, '(2.1)') AS mentioned, false AS part_of_one FROM x""")
def value_classes(spark, d):
    k = F.col("p_partkey")
    t = F.concat("p_name", F.lit(" v1."), F.col("p_size").cast("string"), F.lit(".0 ("), (F.col("p_size") % 3).cast("string"), F.lit(".1)"))
    words = F.split("p_name", " ", -1)
    return load(spark, d, "part").select(
        k.alias("id"), text.same_members(words, F.reverse(words)).alias("same"), text.same_members(words, F.split("p_type", " ", -1)).alias("other"), text.edge_fact(pick(["call", "generated", "module", "other"], k)).alias("edge_fact"),
        text.occurrence_fact(pick(["Definition", "DECLARATION", "import", "reference"], k)).alias("occurrence_fact"), text.mentions_version(t, F.lit("2.1")).alias("mentioned"), text.mentions_version(t, F.lit("1.")).alias("part_of_one"),
    )


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/c:/a b/' || doc_id WHEN 1 THEN '/x+y/' || doc_id WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '/é/' || doc_id END AS path FROM documents""")
def local_paths(spark, d):
    """Escaped, drive, host, remote and foreign spellings of a place."""
    end = F.col("doc_id").cast("string")
    raw = F.concat(pick(["FILE:///C:/a%20b/", "file://localhost/x+y/", "file://far/x/", "http://h/x/", "file:///%c3%a9/"], F.col("doc_id")), end)
    return load(spark, d, "documents").select("doc_id", uri.path_of(raw).alias("path"))


@query("""SELECT doc_id, doc_id % 6 IN (0, 1) AS inside, doc_id % 4 IN (0, 2) AS scannable FROM documents""")
def scanned_paths(spark, d):
    k, end = F.col("doc_id"), F.col("doc_id").cast("string")
    path = F.when(k % 6 == 1, "src/a").otherwise(F.concat(pick(["src/a/", "", "src/ab/", "src/a/../b/", "lib/src/a/", "../src/a/"], k), end))
    file = F.concat(pick(["src/a/", "x/.git/", "src/distant/", "src/"], k), end, pick([".go", ".py", ".rs", ".PNG"], k))
    return load(spark, d, "documents").select("doc_id", text.inside(path, F.lit("src/a/")).alias("inside"), text.scannable(file).alias("scannable"))


# ---- SCIP's names, compiler output, selections, orders


@query("""SELECT p_partkey AS id, [21, 7, 7, 17, 26, 61, 61, 0, 8][p_partkey % 9 + 1] AS number, ['interface', 'class', 'class', 'function', 'method', 'variable', 'variable', '', 'constant'][p_partkey % 9 + 1] AS back,
    ['c-family', 'c-family', 'ts-js-family', 'ts-js-family', 'go', 'python', 'rust', '', 'c-family', 'ts-js-family', ''][p_partkey % 11 + 1] AS family FROM part""")
def scip_names(spark, d):
    kind = pick(["Interface", "class", "STRUCT", "function", "method", "variable", "Field", "module", "constant"], F.col("p_partkey"))
    language = pick([" C ", "c++", "TypeScript", "javascriptreact", "Go", "python", "rust", "java", "cpp", "javascript", ""], F.col("p_partkey"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.scip_kind(kind).alias("number"), text.kind_of_scip(text.scip_kind(kind)).alias("back"), text.language_family(language).alias("family"))


@query("SELECT p_partkey AS id, p_partkey % 10 IN (0, 1, 5, 7, 9) AS removable FROM part")
def import_lines(spark, d):
    lines = ['import "fmt"', '\tf "fmt" // why', '"a"; b', "", "// c", "x `y`", "import (", '  "z"  ', 'x "a" y', '"http://h"']
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.import_line_removable(pick(lines, F.col("p_partkey"))).alias("removable"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 3 AND p_size % 5 > 0 AND p_partkey > 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'a/b.go' WHEN 1 THEN 'C:/x.go' ELSE p_name END END AS file,
    CASE WHEN p_partkey % 4 <> 3 AND p_size % 5 > 0 AND p_partkey > 0 THEN p_partkey END AS line, CASE WHEN p_partkey % 4 <> 3 AND p_size % 5 > 0 AND p_partkey > 0 THEN (p_size % 5)::BIGINT END AS "column" FROM part""")
def compiler_positions(spark, d):
    end = F.concat(F.lit(":"), F.col("p_partkey").cast("string"), F.lit(":"), (F.col("p_size") % 5).cast("string"))
    raw = F.concat(F.element_at(F.array(F.lit("a/b.go"), F.lit("C:/x.go"), F.col("p_name"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")), end)
    at = text.compiler_position(raw)
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), at["file"].alias("file"), at["line"].alias("line"), at["column"].alias("column"))


@query(f"""WITH {oracle.OCC} SELECT uri, count(*) AS n, count(*) FILTER (regexp_matches(token, '^[_\\p{{L}}][_\\p{{L}}\\p{{Nd}}]*$')) AS identifiers,
    CAST(sum(CASE WHEN line % 2 = 0 THEN end_char + 1 ELSE end_char END) AS BIGINT) AS ends FROM occ GROUP BY uri""")
def selection_ends(spark, d):
    known = F.when(F.col("line") % 2 == 0, F.struct(F.col("line"), (F.col("end_char") + 1).alias("char")))
    rows = occurrences_of(spark, d).withColumn("e", text.selection_end(known, F.col("line"), F.col("start_char"), F.col("token")))
    return rows.groupBy("uri").agg(F.count("*").alias("n"), F.count_if(text.is_identifier(F.col("token"))).alias("identifiers"), F.sum("e.char").cast("long").alias("ends"))


@query(f"WITH {oracle.OCC} SELECT uri, count(*) AS n, CAST(count(*) - 1 AS BIGINT) AS ordered FROM occ GROUP BY uri")
def index_by_document(spark, d):
    """The stored order by place: of the pairs of neighbours inside a document, how many are in order (all)."""
    return _neighbours(occurrences_of(spark, d), facts.URI_ORDER, "uri")


@query(f"WITH {oracle.OCC} SELECT symbol_id, count(*) AS n, CAST(count(*) - 1 AS BIGINT) AS ordered FROM occ GROUP BY symbol_id")
def index_by_symbol(spark, d):
    return _neighbours(occurrences_of(spark, d), facts.SYMBOL_ORDER, "symbol_id")


def _runs(columns: list[str], key: str):
    """For ``mapInArrow``: rows of a stored order as runs of one key: rows, pairs of neighbours that ascend, the first row and the last."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            same, less = np.ones(n - 1, bool), np.zeros(n - 1, bool)
            for name in columns:
                x, y = b.column(name).slice(0, n - 1), b.column(name).slice(1)
                # Nulls come first and are equal to one another.
                nulls = np.asarray(pc.is_null(x)), np.asarray(pc.is_null(y))
                less |= same & (np.asarray(pc.fill_null(pc.less(x, y), False)) | (nulls[0] & ~nulls[1]))
                same &= np.asarray(pc.fill_null(pc.equal(x, y), False)) | (nulls[0] & nulls[1])
                if name == key:
                    new = np.append(True, ~same)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], n)
            within = np.append(0, np.cumsum(np.append(False, less) & ~new))
            rows = pa.StructArray.from_arrays([b.column(c) for c in columns], columns)
            counts = [pa.array(end - begin), pa.array(within[end] - within[begin])]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(begin)), *counts, rows.take(pa.array(begin)), rows.take(pa.array(end - 1))], [key, "n", "within", "first", "end"])

    return run


def _neighbours(occurrences: DataFrame, order: list[str], key: str) -> DataFrame:
    """Rows of a key, and pairs of rows that follow one another in the files of the index and ascend.

    Files are gone through in batches as they are stored, so none is ever held as a whole. ``key``
    is the first column of the order.
    """
    have = [c for c in order if c in occurrences.columns]
    with scratch(occurrences.sparkSession) as path:
        facts.index(occurrences.select(*have), order).write.parquet(path)
        stored = occurrences.sparkSession.read.parquet(path)
        kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
        row = f"struct<{', '.join(f'{c}: {kinds[c]}' for c in have)}>"
        by = stored.select(*have).mapInArrow(_runs(have, key), f"{key} {kinds[key]}, n bigint, within bigint, first {row}, end {row}")
        # A key that goes on in another run: its last row there must come before the first one here.
        across = Window.partitionBy(key).orderBy("first")
        by = by.withColumn("follows", (F.lag("end").over(across) < F.col("first")).cast("int"))
        return fixed(by.groupBy(key).agg(F.sum("n").alias("n"), (F.sum("within") + F.coalesce(F.sum("follows"), F.lit(0))).cast("long").alias("ordered")))


# ---- clocks, lanes, memos, stages


@query("""WITH g AS (SELECT user_id, event_id AS id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us, (event_id - lag(event_id) OVER w) * 60000000 AS steady FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, id, gap_us, gap_us - steady AS drift_us FROM g WHERE gap_us < 0 OR gap_us > 172800000000 OR gap_us - steady > 7200000000""")
def clock_drift(spark, d):
    ticks = load(spark, d, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_id") * 60_000_000).alias("steady"))
    return telemetry.gaps(ticks, ["user_id"], 2 * 24 * 3600, "steady", 2 * 3600).select("user_id", "id", "gap_us", "drift_us")


@query("""WITH p AS (SELECT user_id, ts, event_id, floor(value / 10) AS done, event_type = 'error' AS paused FROM events),
    r AS (SELECT *, CASE WHEN done > coalesce(lag(done) OVER w, -1) OR paused THEN ts END AS grew FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    x AS (SELECT *, max(grew) OVER w AS last_growth, min(ts) OVER w AS since FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id AS id, last_growth FROM x WHERE epoch_us(ts) - epoch_us(last_growth) > 86400000000 AND epoch_us(ts) - epoch_us(since) >= 86400000000""")
def stalls_outside_maintenance(spark, d):
    rows = load(spark, d, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.floor(F.col("value") / 10).alias("done"), (F.col("event_type") == "error").alias("paused"))
    return telemetry.stalls(rows, ["user_id"], 86_400, 86_400, "paused").select("user_id", "id", "last_growth")


@query(f"""WITH {oracle.LOG}, r AS (SELECT request_id, client % 3 AS lane, epoch_us("at") AS s, epoch_us("at") + 14400000000 AS e, epoch_us("at") + 3600000000 AS q FROM log),
    p AS (SELECT request_id, lane, s AS t, 1 AS a, 0 AS b, 1 AS d FROM r UNION ALL SELECT request_id, lane, e, -1, 0, -1 FROM r UNION ALL SELECT request_id, lane, s, 0, 1, 1 FROM r UNION ALL SELECT request_id, lane, q, 0, -1, -1 FROM r),
    x AS (SELECT request_id, a, b, CAST(sum(a) OVER (ORDER BY t, d, request_id, b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(b) OVER (PARTITION BY lane ORDER BY t, d, request_id, a ROWS UNBOUNDED PRECEDING) AS BIGINT) AS waiting FROM p),
    y AS (SELECT request_id, max(running) FILTER (a = 1) AS running, max(waiting) FILTER (b = 1) AS waiting FROM x GROUP BY request_id)
    SELECT *, CASE WHEN running > 12 THEN 'in_flight' WHEN waiting > 2 THEN 'queue' ELSE 'admitted' END AS status FROM y""")
def admission_lanes(spark, d):
    rows = log_of(spark, d).select("request_id", "at", (F.col("client") % 3).alias("lane"), F.lit(14_400_000).alias("latency_ms"), F.lit(3_600_000).alias("waits_ms"))
    return telemetry.admission(rows, ["lane"], 12, 2).drop("lane")


@query(f"""WITH RECURSIVE {oracle.LOG}, r AS (SELECT request_id, client, epoch_us("at") AS t, CASE method WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'stable' ELSE 'transient' END AS outcome, row_number() OVER (PARTITION BY client ORDER BY "at", request_id) AS i FROM log),
    l AS (SELECT client, i, request_id, 'compute' AS did, request_id AS answered_by, t + 259200000000 AS until, outcome <> 'transient' AS stays FROM r WHERE i = 1
      UNION ALL SELECT r.client, r.i, r.request_id, CASE WHEN r.t < l.until THEN 'join' WHEN l.stays THEN 'hit' ELSE 'compute' END, CASE WHEN r.t < l.until OR l.stays THEN l.answered_by ELSE r.request_id END,
        CASE WHEN r.t < l.until OR l.stays THEN l.until ELSE r.t + 259200000000 END, CASE WHEN r.t < l.until OR l.stays THEN l.stays ELSE r.outcome <> 'transient' END FROM l JOIN r ON r.client = l.client AND r.i = l.i + 1)
    SELECT client, request_id, did, answered_by FROM l""")
def memo_outcomes(spark, d):
    outcome = F.when(F.col("method") == "purchase", "ok").when(F.col("method") == "error", "stable").otherwise("transient")
    rows = log_of(spark, d).select("client", "request_id", "at", F.lit(259_200_000).alias("takes_ms"), outcome.alias("outcome"))
    return telemetry.memo_outcomes(rows, ["client"])


@query("""SELECT user_id, event_id AS seq, commit_seq FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS commit_seq FROM events)
    WHERE event_type <> 'purchase' AND commit_seq IS NOT NULL""")
def committed_evidence(spark, d):
    rows = load(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return telemetry.committed(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"), ["user_id"]).drop("event_type")


# ---- projects


@query("""WITH f AS (SELECT DISTINCT 'r' || n_regionkey || '/n' || n_nationkey AS folder, n_nationkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT 'python-config:' || folder || '/pyrightconfig.json' AS scope_id, folder AS root, 'pyrightconfig.json' AS config, CASE WHEN k % 2 = 0 THEN 'stubs' ELSE 'none' END AS stub_path, CASE WHEN k % 2 = 0 THEN 'venv' ELSE '' END AS unsupported FROM f WHERE k % 3 = 0
      UNION ALL SELECT 'python-config:' || folder || '/pyproject.toml', folder, 'pyproject.toml', 'none', 'pyproject.toml' FROM f WHERE k % 2 = 0 AND k % 3 <> 0)
    SELECT * FROM s UNION ALL SELECT 'python-default:', '', '<default>', 'none', '' WHERE (SELECT count(*) FROM f WHERE k % 2 <> 0 AND k % 3 <> 0) > 0""")
def python_scopes(spark, d):
    """A folder a nation: configured in JSON, in TOML, in both or not at all; a file a customer."""
    nation = load(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("folder"), F.col("n_nationkey").alias("k"))
    customers = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")).join(F.broadcast(nation), "k")
    sources = customers.select(F.concat("folder", F.lit("/c"), "c_custkey", F.lit(".py")).alias("path"), F.lit(None).cast("string").alias("text"))
    used = customers.select("folder", "k").distinct()
    json = used.where("k % 3 = 0").select(F.concat("folder", F.lit("/pyrightconfig.json")), F.when(F.col("k") % 2 == 0, '{"stubPath": "stubs", // where\n "venv": "x", "strict": ["a"],}').otherwise('{"pythonVersion": "3.12"}'))
    toml = used.where("k % 2 = 0").select(F.concat("folder", F.lit("/pyproject.toml")), F.lit("[tool]"))
    return workspace.python_scopes(sources.union(json).union(toml)).select("scope_id", "root", "config", "stub_path", F.array_join("unsupported", ",").alias("unsupported"))


@query("""SELECT '/w' || n_nationkey AS root, CASE WHEN n_nationkey % 5 < 3 THEN 'pkg' || n_nationkey END AS name, CASE n_nationkey % 5 WHEN 0 THEN 'a/Cargo.toml' WHEN 1 THEN NULL WHEN 2 THEN 'a/Cargo.toml' END AS manifest,
    CASE WHEN n_nationkey % 5 = 0 THEN 'src/lib.rs' END AS src, [NULL, 'outside', 'incomplete', 'no_members', 'undecodable'][n_nationkey % 5 + 1] AS fault FROM nation""")
def cargo_members(spark, d):
    """One workspace a nation: whole, with a member outside, with one without version, without members, not JSON."""
    key = F.col("n_nationkey")
    member = lambda manifest, version, src: F.concat(F.lit('{"workspace_members": ["i"], "packages": [{"id": "other", "name": "o"}, {"id": "i", "name": "pkg'), key, F.lit(f'", "version": "{version}", "manifest_path": "'), manifest, F.lit('", "targets": ['), src, F.lit("]}]}"))
    home = F.concat(F.lit("/w"), key.cast("string"))
    target = F.concat(F.lit('{"name": "t", "kind": ["lib"], "src_path": "'), home, F.lit('/src/lib.rs"}'))
    own = F.concat(home, F.lit("/a/Cargo.toml"))
    texts = F.array(member(own, "1.0", target), member(F.concat(home, F.lit("1/Cargo.toml")), "1.0", F.lit("")), member(own, "", F.lit("")), F.lit('{"workspace_members": [], "packages": []}'), F.lit("[tool"))
    rows = load(spark, d, "nation").select(home.alias("root"), F.element_at(texts, (key % 5 + 1).cast("int")).alias("text"))
    return workspace.cargo_packages(rows).select("root", "name", "manifest", "src", "fault")


# ---- the store


@query(f"WITH {oracle.DEF} SELECT scope_id, count(*) AS symbols, CAST(sum(uses) AS BIGINT) AS uses, true AS equal FROM def GROUP BY scope_id")
def compaction_equivalence(spark, d):
    """Symbols written as a generation and compacted: what is read from either, and whether it is the same."""
    rows = tables.definitions(occurrences_of(spark, d)).select("scope_id", "symbol_id", "uses")
    by = lambda t: t.groupBy("scope_id").agg(F.count("*").alias("symbols"), F.sum("uses").alias("uses"))
    with scratch(spark) as folder:
        store = FactStore(spark, folder)
        first = store.write({"symbols": rows})
        before, after = store.read("symbols", first), store.read("symbols", store.compact())
        same = (F.col("a.symbols") == F.col("b.symbols")) & (F.col("a.uses") == F.col("b.uses"))
        return fixed(by(before).alias("b").join(by(after).alias("a"), "scope_id").select("scope_id", "b.symbols", "b.uses", same.alias("equal")))
