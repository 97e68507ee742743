"""The store, the facade, sources, interchange and streams."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import filters
from factloom.plans import api
from factloom.plans.store import FactStore, StoreError
from factloom.sources import interop, replay, tables, workspace
from factloom.streaming import operators as streams

DOCS = [(1, "alpha beta\ngamma beta alpha", "en", "s"), (2, "beta Delta", "en", "s"), (3, None, "de", "t"), (4, "😀 alpha", "de", "t")]


def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")


def test_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.current() is None and store.recover() is None
    one = store.write({"t": spark.range(100).repartition(5)})
    two = store.write({"t": spark.range(50)})
    assert store.current() == two and store.history() == [two, one]
    assert store.read("t").count() == 50 and store.read("t", one, verify=True).count() == 100
    bad = lambda t: t["t"].agg(F.count("*").alias("violations")).select(F.lit("rows").alias("gate"), "violations")
    with pytest.raises(StoreError, match="rows"):
        store.write({"t": spark.range(3)}, bad)
    assert store.current() == two
    # A broken newest generation is set aside; its number isn't used again.
    spark.range(7).write.mode("append").parquet(f"{store.root}/gen={two}/t")
    assert not store.verified(two) and store.recover() == one and store.history() == [one]
    three = store.compact()
    assert three > two and len(store.read("t", three).inputFiles()) <= 5 and store.read("t", three).count() == 100
    spark.range(1).write.parquet(f"{store.root}/gen=77/t")
    assert "gen=77" in store.reclaim() and store.bytes_used(three) > 0
    for _ in range(3):
        last = store.write({"t": spark.range(1)})
    with store.lease():
        with pytest.raises(StoreError, match="leased"):
            with store.lease():
                pass
    with store.lease():
        pass
    assert store.prune(2) and store.history()[0] == last and len(store.history()) == 2


def test_store_between_steps(spark, tmp_path, monkeypatch):
    """A crash before the manifest, two writers, an expired lease, and a reader of an old generation."""
    store, other = (FactStore(spark, str(tmp_path / "store")) for _ in range(2))
    one = store.write({"t": spark.range(5)})
    with monkeypatch.context() as m:
        m.setattr(store, "_write", lambda name, text: (_ for _ in ()).throw(KeyboardInterrupt()) if name.startswith("manifest") else FactStore._write(store, name, text))
        with pytest.raises(KeyboardInterrupt):
            store.write({"t": spark.range(9)})
    assert other.current() == one and other.read("t").count() == 5
    with store.lease():
        with pytest.raises(StoreError, match="leased"):
            other.write({"t": spark.range(2)})
    with store.lease(seconds=-1):
        two = other.write({"t": spark.range(2)})
    assert store.current() == two and [r.id for r in other.generation()["t"].orderBy("id").collect()] == [0, 1]
    with other.reading(one):
        assert store.prune(1) == []
    assert store.prune(1) == [one] and store.history() == [two]
    with pytest.raises(StoreError):
        store._write(f"manifest-{two}.json", "{}")


def test_reindex_and_facade(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    api.reindex(store, documents(spark))
    assert store.generation(gates=api.generation_checks)["provenance"].count() == 2
    read = store.read
    files = tables.files(documents(spark))
    w = api.Workspace(files, read("symbols"), read("occurrences"), read("coverage"), read("scopes"))
    at = ("doc:///s/1", 1, 7)  # the second beta of the first document
    assert [(r.status, r.line, r.start_char) for r in w.definition(*at).collect()] == [("exact", 0, 6)]
    assert sorted((r.uri, r.line) for r in w.references(*at).collect()) == [("doc:///s/1", 1), ("doc:///s/2", 0)]
    assert w.references(*at, include_declaration=True).count() == 3
    assert w.hover(*at).first().name == "beta"
    assert [(r.status, r.reason) for r in w.definition("doc:///s/1", 9, 9).collect()] == [("unknown", "no_single_symbol")]
    assert w.declaration(*at).first().status == "unknown"  # declarations aren't covered
    stale = api.Workspace(files.withColumn("sha256", F.lit("sha256:0")), w.symbols, w.occurrences, w.coverage, w.scopes)
    assert stale.definition(*at).first().reason == "stale_source" and not stale.status().first().fresh
    assert [r.name for r in w.workspace_symbols("A").where("status = 'exact'").collect()] == ["alpha", "alpha", "beta", "Delta", "gamma"]
    assert {r.new_text for r in w.rename(*at, "omega").collect()} == {"omega"} and w.rename(*at, "omega").count() == 3
    assert w.rename("doc:///s/2", 0, 6, "omega").first().reason == "exported_symbol"
    assert w.rename(*at, "gamma").first().reason == "name_is_taken"
    assert w.call("status").first().documents == 3
    assert w.semantic_tokens("doc:///s/1").count() == 5
    with pytest.raises(ValueError):
        w.call("rename")


def test_workspace(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "pkg" / "node_modules").mkdir(parents=True)
    (root / "pkg" / "a.py").write_text("x = 1\n")
    (root / "b.go").write_text("package b")
    (root / "big.c").write_text("x" * 3000)
    (root / "pkg" / "node_modules" / "n.js").write_text("no")
    rows = workspace.scan(spark, str(root), most_bytes=2000).orderBy("path").collect()
    assert [(r.path, r.language) for r in rows] == [("b.go", "go"), ("pkg/a.py", "python")]
    assert "content" not in workspace.scan(spark, str(root), content=False).columns
    assert [r.path for r in workspace.within_budget(workspace.scan(spark, str(root), content=False), 20).collect()] == ["b.go"]
    base = tmp_path / "db.json"
    base.write_text(json.dumps([{"directory": "/d", "file": "a.c", "command": "cc -DX=1 -I'inc dir' a.c"}, {"directory": "/d", "file": "b.c", "arguments": ["cc", "-DY", "b.c"]}]))
    got = {r.file: (r.defines, r.includes) for r in workspace.compilation_database(spark, str(base)).collect()}
    assert got == {"a.c": (["X=1"], ["inc dir"]), "b.c": (["Y"], [])}
    configs = spark.createDataFrame([("a", '{ // c\n "extends": "b", "references": [{"path": "c"},], }'), ("b", "{}")], "config string, text string")
    assert {(r.src, r.dst) for r in workspace.project_references(configs).collect()} == {("a", "b"), ("a", "c")}
    need = spark.createDataFrame([("require (",), ("\tx/y v1.2 // indirect",)], "line string")
    sums = spark.createDataFrame([("x/y v1.2 h1:abc",), ("x/y v1.2/go.mod h1:def",)], "line string")
    assert [tuple(r) for r in workspace.bill_of_materials(need, sums).collect()] == [("x/y", "v1.2", True, "h1:abc")]
    assert workspace.bundle(tables.files(documents(spark)), "metadata").columns == ["uri", "language", "size", "sha256"]
    assert workspace.configuration({"a": 1, "b": False}, environment={"FACTLOOM_A": "3", "FACTLOOM_B": "yes"}) == {"a": 3, "b": True}
    with pytest.raises(ValueError):
        workspace.configuration({"a": 1}, environment={"FACTLOOM_C": "3"})


def facts(spark):
    files = tables.files(documents(spark))
    occ = tables.occurrences(files)
    definitions = tables.definitions(occ)
    return files, tables.with_roles(occ, definitions), tables.symbols(definitions)


def test_lsif_there_and_back(spark, tmp_path):
    files, occ, _ = facts(spark)
    occ = occ.withColumn("symbol_id", F.concat_ws("/", "scope_id", "symbol_id"))
    dump, lost = interop.export_lsif(occ)
    path = str(tmp_path / "dump")
    dump.orderBy("group", "number").select("json").coalesce(1).write.text(path)
    elements = interop.read_lsif(spark, path)
    back = interop.lsif_occurrences(elements)
    names = ["uri", "line", "start_char", "symbol_id", "role"]
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, occ.select(*names).collect()))
    assert interop.lsif_faults(elements, files).count() == 0 and lost.count() == 0
    assert interop.lsif_faults(elements, files.limit(0)).count() == 3
    assert interop.lsif_to_scip(elements).count() == 3
    edges = spark.createDataFrame([("call",), ("call",)], "kind string")
    with pytest.raises(ValueError):
        interop.export_lsif(occ, edges)
    assert interop.export_lsif(occ, edges, strict=False)[1].first().lost == 2
    assert {r.state for r in interop.imported_coverage(files.select("scope_id").distinct()).where("fact = 'call'").collect()} == {"unknown"}
    broken = elements.where("label <> 'item'")
    assert {r.fault for r in interop.lsif_faults(broken, files).collect()} == {"range without item"}


def test_scip_there_and_back(spark):
    files, occ, symbols = facts(spark)
    back = interop.scip_facts(interop.scip_documents(occ, symbols, files))
    names = ["uri", "line", "start_char", "end_char", "role"]
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, occ.select(*names).collect()))


def test_replay(spark, tmp_path):
    header = spark.createDataFrame([("s", "h", {"go": "1"}, {})], "session string, config_hash string, backends map<string,string>, toolchain map<string,string>")
    entries = spark.createDataFrame([("s", i, "out" if i % 2 else "in", 0, "b", str(i), "{}") for i in range(6)], replay.ENTRY)
    path = str(tmp_path / "log")
    replay.save(header, entries, path)
    h, e = replay.load(spark, path)
    assert h.first().format_version == 2 and sorted(map(tuple, e.collect())) == sorted(map(tuple, entries.collect()))
    assert replay.outputs(e).count() == 3


def run_stream(spark, tmp_path, rows, schema, operator, parts=3):
    """Rows as a stream in several micro-batches, in the order given."""
    source = tmp_path / "in"
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    return [tuple(r) for r in streams.to_completion(operator(stream), str(tmp_path / "cp"), str(tmp_path / "out")).collect()]


def test_document_stream(spark, tmp_path):
    rows = [("u", 1, "open", "abc", None, None, 1), ("u", 2, "change", "X", 1, 2, 2), ("u", 3, "change", "Y", 0, 1, 2), ("u", 4, "open", "zzz", None, None, 3), ("u", 5, "change", "new", None, None, 5), ("u", 6, "change", "q", 9, 10, 6), ("u", 7, "close", None, None, None, None), ("u", 8, "change", "q", 0, 0, 9)]
    got = run_stream(spark, tmp_path, rows, "uri string, seq long, kind string, text string, start long, end long, version long", streams.documents)
    by = {r[1]: (r[2], r[4]) for r in got}
    assert by == {1: ("accepted", "abc"), 2: ("accepted", "aXc"), 3: ("refused: old version", "aXc"), 4: ("refused: open with another text", "aXc"), 5: ("accepted", "new"), 6: ("refused: range", "new"), 7: ("accepted", "new"), 8: ("refused: not open", "new")}


def test_other_streams(spark, tmp_path):
    got = run_stream(spark, tmp_path / "a", [("k", i, r) for i, r in enumerate([3, 5, 4, 5, 2, 9])], "key string, seq long, revision long", streams.stale_results)
    assert [r[3] for r in sorted(got, key=lambda r: r[1])] == [True, True, False, True, False, True]
    got = run_stream(spark, tmp_path / "b", [("k", 1, 0, 10), ("k", 2, 5, 10), ("k", 3, 10, 5), ("k", 4, 12, 1)], "key string, request_id long, start_ms long, takes_ms long", streams.coalesced, 2)
    assert {r[1]: r[2] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3}
    got = run_stream(spark, tmp_path / "c", [("k", 1, "get", 1, None), ("k", 2, "put", 1, "v"), ("k", 3, "get", 1, None), ("k", 4, "put", 0, "old"), ("k", 5, "invalidate", 1, None), ("k", 6, "get", 1, None)], "key string, seq long, kind string, revision long, value string", streams.memo)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == ["miss", "stored", "hit", "stale", "invalidated", "miss"]
    got = run_stream(spark, tmp_path / "d", [("p", 0, "x"), ("q", 1, "y"), ("p", 1, "z"), ("p", 2, None), ("p", 3, "z")], "path string, scan long, sha256 string", streams.file_changes)
    assert sorted((r[0], r[1], r[2]) for r in got) == [("p", 1, "modified"), ("p", 2, "deleted"), ("p", 3, "created"), ("q", 1, "created")]
    got = run_stream(spark, tmp_path / "e", [("b", i, k) for i, k in enumerate(["start", "crash", "start", "crash", "start", "healthy", "crash", "stop"])], "backend string, seq long, kind string", streams.backend_states)
    assert [(r[2], r[4]) for r in sorted(got, key=lambda r: r[1])] == [("running", 0), ("backoff", 100), ("running", 0), ("backoff", 200), ("running", 0), ("running", 0), ("backoff", 100), ("stopped", 0)]


def test_stream_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i // 20}:{i % 20:02}", "m", float(i)) for i in range(60)]
    schema = "id long, at timestamp, method string, latency_ms double"
    typed = spark.createDataFrame(rows, "id long, at string, method string, latency_ms double").withColumn("at", F.to_timestamp("at"))
    got = run_stream(spark, tmp_path, [tuple(r) for r in typed.collect()], schema, lambda s: streams.minute_latency(s, "0 seconds"))
    assert [r[2] for r in sorted(got)] == [20, 20]  # the last minute is still open


@pytest.mark.parametrize("name", ["workspace_symbols", "references_at", "generation_gates", "call_edges", "tree_digest", "conformance_score", "module_closure", "columns_in_encodings", "applied_edits", "safe_spans", "valid_memo", "compaction_equivalence"])
def test_queries_against_sql(spark, sf_dir, name):
    import duckdb

    import __spark_entry__

    SQL, QUERIES = __spark_entry__.oracle_sql(), __spark_entry__.queries()
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(SQL[name])
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_query_has_sql():
    from factloom.plans.oracle import SQL
    from factloom.plans import checks
    from factloom.plans.queries import QUERIES

    assert set(SQL) == set(QUERIES) and set(checks.SQL) == set(checks.QUERIES)
    assert not set(SQL) & set(checks.SQL)


def test_word_places_on_long_and_odd_lines(spark):
    """Starts and ends against a walk over the characters, on lines longer than a run of words."""
    from factloom.sources import tables

    lines = ["", "  a  b ", " ".join(f"w{i}é😀"[: 1 + i % 5] for i in range(300)), "x" * 50, "one  " * 200]
    df = tables.files(spark.createDataFrame([(1, "\n".join(lines), "en", "s")], "doc_id long, text string, lang string, source string"))
    width = lambda s: len(s.encode("utf-16-le")) // 2
    want, pairs = [], []
    for n, line in enumerate(lines):
        at, row = 0, []
        for w in line.split(" "):
            if w:
                row.append((n, at, at + width(w), w))
            at += width(w) + 1
        want += row
        pairs += [(n, a[1], b[2], a[3].lower(), b[3].lower()) for a, b in zip(row, row[1:])]
    assert sorted(tuple(r) for r in tables.occurrences(df).select("line", "start_char", "end_char", "token").collect()) == sorted(want)
    assert sorted(tuple(r) for r in tables.call_edges(df).select("line", "start_char", "end_char", "from", "to").collect()) == sorted(pairs)


def test_record_filters(spark):
    rows = [("", "u", (0, 0, 0, 1), "sha256:" + "a" * 64, "use"), ("x", "u\n", (1, 0, 0, 9), "sha256:zz", "reference")]
    df = spark.createDataFrame(rows, "symbol_id string, uri string, range struct<start_line:long,start_char:long,end_line:long,end_char:long>, source_hash string, role string")
    assert filters.record_violations(df).count() == 5
