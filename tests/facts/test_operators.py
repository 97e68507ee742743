import pytest
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import text
from factloom.operators import diff, facts, filters, gates, graph, intervals, quality, sets, telemetry


def df(spark, rows, names):
    return spark.createDataFrame(rows, names)


RANGES = "uri string, symbol_id string, start_line long, start_char long, end_line long, end_char long"


def test_narrowest_and_strict(spark):
    ranges = df(spark, [("u", "outer", 0, 0, 9, 0), ("u", "mid", 2, 0, 2, 20), ("u", "in", 2, 5, 2, 8), ("v", "a", 0, 0, 0, 9), ("v", "b", 0, 0, 0, 9), ("v", "c", 0, 2, 0, 4), ("w", "x", 1, 0, 200, 0)], RANGES)
    queries = df(spark, [(1, "u", 2, 6), (2, "u", 2, 8), (3, "u", 5, 0), (4, "v", 0, 3), (5, "u", 9, 0), (6, "w", 150, 3)], "query_id long, uri string, line long, char long")
    got = {r.query_id: (r.symbol_id, r.status) for r in intervals.narrowest(queries, ranges).collect()}
    # Query 4: two ranges tie before the narrower one is seen, so the answer is refused.
    assert got == {1: ("in", "exact"), 2: ("mid", "exact"), 3: ("outer", "exact"), 4: (None, "unknown"), 5: (None, "unknown"), 6: ("x", "exact")}
    strict = {r.query_id: r.status for r in intervals.only_symbol(queries, ranges).collect()}
    assert strict == {1: "unknown", 2: "unknown", 3: "exact", 4: "unknown", 5: "unknown", 6: "exact"}


def test_edits_segments_and_containers(spark):
    edits = df(spark, [("u", 1, 0, 5), ("u", 2, 5, 9), ("u", 3, 4, 6), ("u", 4, 9, 9), ("u", 5, 9, 9), ("u", 6, 2000, 3000), ("u", 7, 2500, 2501)], "uri string, edit_id long, start long, end long")
    assert {(r.first_edit, r.second_edit) for r in intervals.edit_conflicts(edits).collect()} == {(1, 3), (2, 3), (4, 5), (6, 7)}
    pieces = df(spark, [("k", 0, 0, 4, 4, False), ("k", 1, 4, 4, 3, True), ("k", 2, 6, 8, 5, False), ("z", 0, 5, 9, 4, False), ("z", 1, 0, 4, 4, False)], "key string, piece long, host_start long, host_end long, length long, generated boolean")
    segments = intervals.segments_of(pieces)
    assert {r.key: r.refused for r in segments.collect()} == {"k": False, "z": True}
    points = df(spark, [("k", x) for x in (0, 3, 5, 7, 11, 12)], "key string, offset long")
    assert {r.offset: (r.host_offset, r.quality) for r in intervals.to_host(points, segments).collect()} == {0: (0, "exact"), 3: (3, "exact"), 5: (None, "unmapped-generated"), 7: (6, "many-to-one"), 11: (8, "many-to-one"), 12: (None, "unmapped")}
    nodes = df(spark, [("u", 0, 0, 100), ("u", 1, 10, 50), ("u", 2, 20, 30), ("u", 3, 25, 60), ("u", 4, 10, 50)], "uri string, node_id long, start long, end long")
    assert {r.node_id: r.parent_id for r in intervals.nearest_container(nodes).collect()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 0}


def test_refusals_are_rows(spark):
    answer = df(spark, [("u", 1)], "uri string, line long")
    good = gates.violations(a=answer.limit(0))
    assert [tuple(r) for r in gates.envelope(answer, good).collect()] == [("exact", "complete", None, "u", 1)]
    bad = gates.violations(a=answer.limit(0), b=answer)
    assert [tuple(r) for r in gates.envelope(answer, bad).collect()] == [("unknown", "unknown", "b", None, None)]


def test_search_orders(spark):
    symbols = df(spark, [("s", f"id{i:04}", f"Name{i:04}", "function", "go") for i in range(300)] + [("s", "g", "name_graph", "module_graph_node", "go")], "scope_id string, id string, name string, kind string, language string")
    places = df(spark, [("s", f"id{i:04}", "u", 300 - i, 0, 3) for i in range(300)], "scope_id string, symbol_id string, uri string, line long, start_char long, end_char long")
    out = facts.workspace_symbols(symbols, places, "NAME").collect()
    assert [r.name for r in out] == [f"Name{i:04}" for i in range(100)] and {r.status for r in out} == {"exact"}
    # One chosen symbol without a place makes all unknown; the overlay search only counts those with one.
    holes = places.where("symbol_id <> 'id0007'")
    assert {r.status for r in facts.workspace_symbols(symbols, holes, "name").collect()} == {"unknown"}
    assert [r.id for r in facts.overlay_symbols(symbols, holes, "name", 8).collect()] == [f"id{i:04}" for i in range(9) if i != 7]
    assert facts.workspace_symbols(symbols, places, "n%e").count() == 0


def test_definitions_and_freshness(spark):
    occ = df(spark, [("s", "f", "b", 5, 0, 1, "definition", "h"), ("s", "f", "a", 9, 0, 1, "definition", "h"), ("s", "f", "a", 1, 0, 1, "declaration", "h"), ("s", "g", "a", 0, 0, 1, "reference", "old"), ("s", "h", "gone", 0, 0, 1, "use", "h")], "scope_id string, symbol_id string, uri string, line long, start_char long, end_char long, role string, source_hash string")
    best = facts.best_definitions(occ).collect()
    assert [(r.symbol_id, r.uri, r.line) for r in best] == [("f", "a", 9)]
    files = df(spark, [("a", "h"), ("b", "h")], "uri string, sha256 string")
    assert {(r.uri, r.reason) for r in facts.stale(occ, files).collect()} == {("a", "content changed"), ("gone", "missing file")}
    assert [r.role for r in filters.unknown_roles(occ).collect()] == ["use"]
    assert filters.with_role(occ, "references").count() == 1 and filters.with_role(occ, "references", True).count() == 4


def test_coverage(spark):
    scopes = df(spark, [("s",), ("t",)], "scope_id string")
    full = [("s", k, "complete") for k in schema.FACT_KINDS]
    coverage = df(spark, full + [("t", k, "complete") for k in schema.FACT_KINDS[1:]], "scope_id string, fact string, state string")
    assert [r.scope_id for r in facts.coverage_faults(scopes, coverage).collect()] == ["t"]
    assert [(r.scope_id, r.fact) for r in facts.coverage_gaps(scopes, coverage, ["symbol"]).collect()] == [("t", "symbol")]
    refs = df(spark, [("s", "x"), ("t", "x")], "scope_id string, symbol_id string")
    symbols = df(spark, [("y", "s"), ("y", "t"), ("z", "s")], "id string, scope_id string")
    assert {(r.scope_id, r.is_error) for r in facts.unresolved(refs, symbols, coverage).collect()} == {("s", True), ("t", False)}
    assert [r.id for r in facts.declared_twice(symbols).collect()] == ["y"]
    # The end depends on what came first: partial and unknown don't replace each other.
    events = df(spark, [("s", "call", 1, "unknown", "u"), ("s", "call", 2, "incomplete_known_subset", "p"), ("t", "call", 1, "incomplete_known_subset", "p"), ("t", "call", 2, "unknown", "u"), ("t", "call", 3, "unavailable", "n"), ("t", "call", 4, "complete", "c")], "scope_id string, fact string, seq long, state string, reason string")
    assert {r.scope_id: (r.state, r.reasons) for r in quality.coverage_fold(events).collect()} == {"s": ("unknown", ["u"]), "t": ("unavailable", ["p", "n"])}


def test_kpi(spark):
    counts = df(spark, [("a", 8, 2, 2, 0, 3, 100, 7, 10, 1, 10, 2, 20, 1, 5), ("z", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)], "k string, tp long, fp long, fn long, tn long, refusals long, requests long, stale_rejected long, stale_candidates long, wrong_file long, location_results long, mapping_failures long, mapping_samples long, edit_failures long, edit_attempts long")
    got = {(r.k, r.metric): (r.status, r.value) for r in quality.kpi(counts, ["k"]).collect()}
    assert got["a", "precision"] == ("observed", 0.8) and got["a", "recall"] == ("observed", 0.8) and got["a", "stale_rejection_rate"] == ("observed", 0.7)
    assert {v for (k, _), v in got.items() if k == "z"} == {("not_verified", None)}
    odd = df(spark, [("n", 1, None), ("i", 5, -9)], "k string, tp long, fp long")
    got = {(r.k, r.metric): r.status for r in quality.kpi(odd, ["k"]).collect()}
    assert got["n", "precision"] == "not_verified" and got["i", "precision"] == "invalid"


def test_percentiles_differ(spark):
    rows = df(spark, [("k", float(i)) for i in range(10)], "k string, v double")
    assert tuple(telemetry.nearest_rank(rows, ["k"], "v", {"a": 0.5, "b": 0.99}).first())[1:] == (10, 4.0, 9.0)
    assert tuple(telemetry.floor_rank(rows, ["k"], "v", {"a": 0.5, "b": 0.99}).first())[1:] == (10, 4.0, 8.0)


def test_trends(spark):
    up = df(spark, [(float(i), float(i * 64)) for i in range(10)], "x double, y double")
    assert telemetry.theil_sen(up, []).first().slope == 64
    spike = df(spark, [(float(i), 9000.0 if i == 4 else 1.0) for i in range(10)], "x double, y double")
    assert telemetry.theil_sen(spike, []).first().slope == 0
    assert telemetry.trends(up, 500).where("trips").count() == 1 and telemetry.trends(spike, 500).where("trips").count() == 0
    even = df(spark, [(0.0, 0.0), (1.0, 1.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert telemetry.theil_sen(even, []).first().slope == pytest.approx((5 / 3 + 2) / 2)


def test_sequences(spark):
    a = df(spark, [("s", 0, "x"), ("s", 1, "y"), ("t", 0, "x"), ("q", 5, "m")], "session string, seq long, payload string")
    b = df(spark, [("s", 7, "x"), ("s", 9, "z"), ("t", 0, "x"), ("t", 1, "x"), ("q", 1, "m")], "session string, seq long, payload string")
    assert {r.session: (r.status, r.first_difference) for r in diff.zip_compare(a, b).collect()} == {"s": ("diverged", 2), "t": ("count_mismatch", None), "q": ("equal", None)}
    log = df(spark, [("s", 1, "in", 1), ("s", 2, "in", 1), ("s", 3, "out", 1), ("s", 4, "out", 9), ("s", 5, "in", 2)], "session string, seq long, dir string, request_id long")
    assert {(r.request_id, r.seq): r.status for r in telemetry.answered(log).collect()} == {(1, 1): "unanswered", (1, 2): "reused", (9, 4): "unrequested", (2, 5): "unanswered"}


def test_digests_and_diffs(spark):
    before = df(spark, [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "path string, size long, sha256 string")
    after = df(spark, [("a", 1, "x"), ("b", 1, "w"), ("d", 1, "z")], "path string, size long, sha256 string")
    assert {tuple(r) for r in diff.snapshot_diff(before, after).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    assert diff.first_change(before, after).first().path == "b" and diff.first_change(before, before).count() == 0
    assert diff.unchanged(before, before).first().unchanged and not diff.unchanged(before, after).first().unchanged
    one = diff.tree_digest(before, []).first().digest
    assert diff.tree_digest(before.orderBy(F.desc("path")), []).first().digest == one != diff.tree_digest(after, []).first().digest


def test_graphs(spark):
    edges = df(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "x"), ("e", "f")], "src string, dst string")
    assert {r.node for r in graph.cycles(edges).collect()} == {"a", "b", "c"}
    configs = df(spark, [(x,) for x in "abcdefg"], "config string")
    assert {r.root: r.status for r in graph.reference_closure(configs, edges).collect()} == {"a": "unknown", "b": "unknown", "c": "unknown", "d": "unknown", "e": "exact", "f": "exact", "g": "exact"}
    processes = df(spark, [(2, 1), (3, 2), (9, 8)], "pid long, ppid long")
    assert {r.pid: r.descends for r in graph.is_descendant(processes, 1).collect()} == {2: True, 3: True, 9: False}
    edges.createOrReplaceTempView("edges_of_test")
    assert {r.node: r.depth for r in graph.reachable_sql(spark, "edges_of_test", "a").collect()} == {"a": 0, "b": 1, "c": 2}


def test_graphs_deeper_than_any_bound(spark):
    n = 70
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(n)]  # its last node is no project
    edges = df(spark, ring + chain, "src string, dst string")
    configs = df(spark, [(s,) for s, _ in ring + chain], "config string")
    got = {r.root: r for r in graph.reference_closure(configs, edges).collect()}
    assert {r.status for r in got.values()} == {"unknown"}
    assert all(got[f"c{i}"].reached == n - i and got[f"c{i}"].dangling for i in range(n))
    assert all(got[f"r{i}"].reached == n and got[f"r{i}"].cyclic for i in range(n))
    edges.createOrReplaceTempView("deep_edges_of_test")
    assert {r.node: r.depth for r in graph.reachable_sql(spark, "deep_edges_of_test", "c0").collect()} == {f"c{i}": i for i in range(n + 1)}


def test_conformance(spark):
    checks = df(spark, [("core", "Y0", 1.0, "done"), ("core", "Y0", 1.0, "failed"), ("core", "Y1", 2.0, "deferred"), ("core", "PERF", 1.0, "gate"), ("later", "m", 1.0, "deferred"), ("later", "m", 3.0, "done")], "domain string, category string, weight double, status string")
    got = {(r.domain, r.category): r.score for r in quality.conformance(checks).collect()}
    assert got["core", "Y0"] == 0.5 and ("core", "Y1") not in got and got["later", "m"] == 0.75
    assert got["core", None] == pytest.approx((0.24 * 0.5 + 0.09 * 0.5) / 0.33)


def test_sets_and_text(spark):
    keys = df(spark, [("k1", [("file", "a")]), ("k2", [("file", "b"), ("tool", "a")])], "key string, deps array<struct<kind:string,id:string>>")
    assert [r.key for r in sets.memo_dependents(keys, df(spark, [("tool", "a")], "kind string, id string")).collect()] == ["k2"]
    one = spark.range(1).select(
        text.redacted(F.lit('token: "a b" x=1')).alias("a"), text.triage(F.array(F.lit("By Design"), F.lit("gopls"))).alias("b"), text.symbol_kind(F.lit("interface class")).alias("c"),
        text.class_cap(F.lit("very_large"), F.lit(1)).alias("d"), text.cost_class(F.lit("nothing")).alias("e"), filters.stable_json(F.lit('{"b":{"id":1,"a":[{"pid":2}]}}')).alias("f"),
        filters.package_matches(F.lit("a/b/c"), "a/...").alias("g"), text.inside(F.lit("a/../b"), F.lit("a")).alias("h"),
    ).first()
    assert tuple(one) == ("token=[REDACTED] x=1", "upstream_bug", "interface", 1, "medium", '{"b":{"a":[{}]}}', True, False)
    with pytest.raises(Exception, match="unknown value"):
        spark.range(1).select(text.known_enum(F.lit("x"), ["y"])).collect()


def test_schedule_phases_and_reservoir(spark):
    rows = [("s", 1, 0, 10, 5, "large"), ("s", 2, 0, 10, 5, "large"), ("s", 3, 1, 10, 9, "tiny"), ("s", 4, 2, 10, 0, "tiny"), ("s", 5, 2, 10, 0, "large")]
    requests = df(spark, rows, "server string, request_id long, at_ms long, takes_ms long, priority long, cost string")
    got = {r.request_id: r.start_ms for r in telemetry.schedule(requests, 2, {"large": 1}).collect()}
    assert got == {1: 0, 3: 1, 4: 10, 5: 11, 2: 21}
    old = df(spark, [("s", 1, 0, 6000, 0, "a"), ("s", 2, 10, 10, 3, "a"), ("s", 3, 5900, 10, 2, "a")], requests.schema)
    assert {r.request_id: r.start_ms for r in telemetry.schedule(old, 1, {}).collect()} == {1: 0, 2: 6000, 3: 6010}
    trace = df(spark, [(1, 2.0, None), (2, 1.0, 3.0)], "request_id long, wait double, write double")
    assert {tuple(r) for r in telemetry.phases(trace, ["wait", "write"]).collect()} == {(1, "wait", 2.0), (2, "wait", 1.0), (2, "write", 3.0)}
    many = spark.range(1000).withColumn("k", F.col("id") % 2)
    a, b = (telemetry.reservoir(x, ["k"], "id", 10) for x in (many, many.repartition(7)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 20


def test_memo_and_diagnostics(spark):
    entries = df(spark, [("a", 1, [("file", "x")]), ("b", 5, [("file", "x")]), ("c", 5, [("file", "y")])], "key string, revision long, deps array<struct<kind:string,id:string>>")
    changed = df(spark, [("file", "x")], "kind string, id string")
    assert [r.key for r in sets.valid_memo(entries, changed, 2).collect()] == ["c"]
    docs = df(spark, [("u", 1, 9), ("u", 2, 1)], "uri string, version long, epoch long")
    found = df(spark, [("u", 1, 9, "old"), ("u", 2, 1, "new"), ("v", 2, 1, "other")], "uri string, version long, epoch long, message string")
    assert [r.message for r in sets.current_diagnostics(found, docs).collect()] == ["new"]
    assert sets.overdue(df(spark, [(1.0,), (9.0,)], "latency_ms double"), 5).count() == 1


def test_names_lines_and_positions(spark):
    rows = df(spark, [("a b.go:3:1",), ("a:b:12:+4",), ("x:0:1",), ("x:1",), (":1:2",), ("x:99999999999999999999:1",), ("",), (None,)], "raw string")
    got = [r.p and (r.p.file, r.p.line, r.p.column) for r in rows.select(text.compiler_position(F.col("raw")).alias("p")).collect()]
    assert got == [("a b.go", 3, 1), ("a:b", 12, 4), None, None, None, None, None, None]
    lines = [(' "a"', True), ("`a` // b", True), ('"a" // {', False), ('"a" b', False), ("", False), (None, False), ('import "a"\t', True)]
    assert [r.x for r in df(spark, lines, "line string, want boolean").select(text.import_line_removable(F.col("line")).alias("x")).collect()] == [w for _, w in lines]
    names = [("_a1", True), ("é9", True), ("9a", False), ("a-b", False), ("", False), (None, False), ("a\n", False)]
    assert [r.x for r in df(spark, names, "s string, want boolean").select(text.is_identifier(F.col("s")).alias("x")).collect()] == [w for _, w in names]
    r = df(spark, [(None, " Rust", "😀a")], "k string, l string, n string").select(text.scip_kind(F.col("k")).alias("k"), text.kind_of_scip(F.lit(99)).alias("b"), text.language_family(F.col("l")).alias("f"), text.selection_end(F.lit(None), F.lit(4), F.lit(2), F.col("n")).alias("e")).first()
    assert (r.k, r.b, r.f, tuple(r.e)) == (0, "", "rust", (4, 5))


def test_clocks_lanes_and_memos(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    ticks = df(spark, [("a", 1, at(0), 0), ("a", 2, at(5), 5_000_000), ("a", 3, at(35), 6_000_000), ("a", 4, at(30), 7_000_000)], "k string, id long, at string, mono long").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id for r in telemetry.gaps(ticks, ["k"], 40, "mono", 20).collect()} == {3, 4}
    work = df(spark, [("a", i, at(i * 10), d, m) for i, (d, m) in enumerate([(1, False), (1, False), (1, True), (1, False), (1, False), (1, None)])], "k string, id long, at string, done long, m boolean").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id for r in telemetry.stalls(work, ["k"], 15, 10).collect()} == {2, 3, 4, 5}
    assert {r.id for r in telemetry.stalls(work, ["k"], 15, 10, "m").collect()} == {4, 5}
    asks = df(spark, [(i, at(s), 1000 * w, 1000 * w, "x") for i, (s, w) in enumerate([(0, 0), (1, 30), (2, 30), (3, 30), (40, 5)])], "request_id long, at string, latency_ms int, waits_ms int, lane string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.request_id: (r.running, r.waiting, r.status) for r in telemetry.admission(asks, ["lane"], 2, 1).collect()}
    assert got == {0: (0, 0, "admitted"), 1: (1, 1, "admitted"), 2: (2, 2, "queue"), 3: (3, 3, "in_flight"), 4: (1, 1, "admitted")}
    memo = df(spark, [("k", i, at(s), 3000, o) for i, (s, o) in enumerate([(0, "transient"), (2, "ok"), (3, "stable"), (5, "ok"), (6, "ok"), (9, "transient")])], "key string, request_id long, at string, takes_ms int, outcome string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.request_id: (r.did, r.answered_by) for r in telemetry.memo_outcomes(memo, ["key"]).collect()} == {0: ("compute", 0), 1: ("join", 0), 2: ("compute", 2), 3: ("join", 2), 4: ("hit", 2), 5: ("hit", 2)}
    staged = df(spark, [("r", 1, "a"), ("r", 3, "b"), ("r", 6, "lost"), ("s", 2, "lost")], "request string, seq long, what string")
    done = telemetry.committed(staged, df(spark, [("r", 2), ("r", 5)], "request string, seq long"), ["request"]).collect()
    assert {(r.what, r.commit_seq) for r in done} == {("a", 2), ("b", 5)}


def test_a_second_look(spark):
    answer = gates.envelope(df(spark, [("u", 1)], "uri string, line long"), gates.violations(a=df(spark, [], "x long")))
    same = gates.rechecked(answer, df(spark, [], "uri string")).collect()
    assert [(r.status, r.line) for r in same] == [("exact", 1)]
    moved = gates.rechecked(answer, df(spark, [("u",), ("v",)], "uri string")).collect()
    assert [(r.status, r.reason, r.line) for r in moved] == [("unknown", "changed_meanwhile", None)]
