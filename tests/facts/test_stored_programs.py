"""The stored index, results with dependencies, and extractors."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts, intervals, sets
from factloom.plans import index, memo
from factloom.plans.store import FactStore, StoreError
from factloom.sources import extract, tables
from factloom.storage import scratch

DOCUMENTS = [(1, "Alpha beta 😀 alpha\n\nbeta Alpha", "en", "a"), (2, "beta gamma\r\nalpha  x", "en", "a"), (3, "beta", "de", "b"), (4, None, "de", "b"), (5, "", "en", "a")]


def put(spark, path, rows=DOCUMENTS):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(path)
    return path


# ---- the stored index


def test_index_answers_as_the_facts_do(spark, tmp_path):
    path = put(spark, str(tmp_path / "documents.parquet"))
    found = index.stored_index(spark, path, str(tmp_path / "store"))
    files = tables.files(spark.read.parquet(path))
    occ = tables.occurrences(files)
    roles = tables.with_roles(occ)
    questions = spark.createDataFrame([(n, uri, line, char) for n, (uri, line, char) in enumerate((u, i, c) for u in ("doc:///a/1", "doc:///a/2", "doc:///b/3", "doc:///a/5", "doc:///z/9") for i in range(4) for c in range(0, 22, 2))], "query_id int, uri string, line long, char long")
    ranges = occ.select("uri", F.concat_ws("\x00", "scope_id", "symbol_id").alias("symbol_id"), F.col("line").alias("start_line"), "start_char", F.col("line").alias("end_line"), "end_char")
    rows = lambda df: sorted(map(str, df.collect()))
    hit = intervals.narrowest(questions, ranges).select("query_id", F.get(F.split("symbol_id", "\x00"), F.lit(0)).alias("scope_id"), F.get(F.split("symbol_id", "\x00"), F.lit(1)).alias("symbol_id"), "status", "reason")
    targets = found.symbols_at(questions)
    assert rows(targets) == rows(hit) and targets.where("status = 'exact'").count() > 10
    exact = hit.where("status = 'exact'")
    assert rows(found.definitions_of(exact)) == rows(facts.locations(roles.where("role = 'definition'"), exact).select("query_id", *facts.KEY, *facts.LOCATION))
    for declarations in (False, True):
        expected = facts.references(roles, exact, declarations)
        assert rows(found.references_of(exact, declarations).select(expected.columns)) == rows(expected)
        assert rows(found.reference_summary(exact, declarations)) == rows(facts.reference_summary(roles, exact, declarations).select(found.reference_summary(exact, declarations).columns))
    one = found.definition("doc:///a/2", 1, 0).collect()
    assert [(r.uri, r.line, r.start_char, r.end_char) for r in one] == [("doc:///a/1", 0, 0, 5)]
    assert found.references("doc:///a/2", 1, 0).count() == 3 and found.references("doc:///a/2", 1, 6).count() == 0


def test_index_follows_the_table(spark, tmp_path):
    path, store = put(spark, str(tmp_path / "documents.parquet")), str(tmp_path / "store")
    first = index.stored_index(spark, path, store)
    assert index.stored_index(spark, path, store).number == first.number
    put(spark, path, DOCUMENTS + [(6, "delta beta", "en", "c")])
    second = index.stored_index(spark, path, store)
    assert second.number > first.number and second.definitions.where("symbol_id = 'delta'").count() == 1
    assert second.definitions.where("symbol_id = 'beta' AND scope_id = 'a'").first().uses == 3


def test_a_look_up_reads_little(spark, tmp_path):
    path = put(spark, str(tmp_path / "documents.parquet"), [(i, f"word{i} common\nline{i} other", "en", f"s{i % 5}") for i in range(2000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables are one file else
    try:
        found = index.stored_index(spark, path, str(tmp_path / "store"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def files_read(df):
        df.collect()
        plan, read = df._jdf.queryExecution().executedPlan(), []
        stack = [plan]
        while stack:
            node = stack.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                stack.append(node.executedPlan())
            if "Scan" in node.nodeName():
                read.append(node.metrics().apply("numOutputRows").value())
            stack += [node.children().apply(i) for i in range(node.children().size())]
        return sum(read)

    assert found.postings.count() > 5000 and len(found.postings.inputFiles()) > 1
    definition = found.definition("doc:///s2/7", 1, 0)
    assert [r.uri for r in definition.collect()] == ["doc:///s2/7"]
    assert "PushedFilters: [IsNotNull(symbol_id), IsNotNull(scope_id), EqualTo(symbol_id,line7), EqualTo(scope_id,s2)]" in definition._jdf.queryExecution().toString()
    total = found.definitions.count()
    assert files_read(definition) < total / 2


def test_two_sessions_do_not_build_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "WAIT_SECONDS", 0)
    monkeypatch.setattr(index, "LOOKS", 2)
    path = put(spark, str(tmp_path / "documents.parquet"))
    root = str(tmp_path / "store")
    name = index.hashlib.sha256(path.encode()).hexdigest()[:16]
    with FactStore(spark, f"{root}/fact-index-{index.FORM}-{name}").lease(), pytest.raises(StoreError, match="another session"):
        index.stored_index(spark, path, root)
    assert index.stored_index(spark, path, root).number == 1


def test_row_hashes_tell_nulls_and_places_apart(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    df = lambda rows: spark.createDataFrame(rows, "a long, b long, m map<string,long>")
    tables_ = [df([(None, 1, {"x": 1})]), df([(1, None, {"x": 1})]), df([(1, 1, None)]), df([(1, 1, {"x": 2})]), df([(1, 2, None), (2, 1, None)]), df([(1, 1, None), (2, 2, None)])]
    assert len({store._summary(t)["checksum"] for t in tables_}) == len(tables_)
    assert store._summary(df([(1, 2, None), (2, 1, None)])) == store._summary(df([(2, 1, None), (1, 2, None)]).repartition(2))


# ---- results with dependencies


def brute(spec, values):
    """Each key's own value, plus those of the keys that it reads."""
    out = {}

    def of(k):
        if k not in out:
            out[k] = sum(values[i] if i in values else of(i) for i in spec[k])
        return out[k]

    return {k: of(k) for k in spec}


def run(spark, store, spec, values):
    edges = spark.createDataFrame([(k, i) for k, xs in spec.items() for i in xs], "key string, input string")
    inputs = spark.createDataFrame([(i, v) for i, v in values.items()], "input string, v long")

    asked = []

    def compute(wanted, valid):
        asked.extend(r.key for r in wanted.collect())
        known = inputs.unionByName(valid.select(F.col("key").alias("input"), F.col("value").cast("long").alias("v")))
        read = edges.join(wanted, "key").join(known, "input", "left")
        whole = read.groupBy("key").agg(F.sum("v").alias("v"), F.bool_or(F.col("v").isNull()).alias("waits")).where(~F.col("waits"))
        return whole.select("key", F.col("v").cast("string").alias("value")), read.select("key", "input")

    m = memo.Memo(store, compute)
    m.update(edges.select("key"), inputs.select("input", F.col("v").cast("string").alias("fingerprint")))
    got = {r.key: (int(r.value), r.outcome) for r in m.results().collect()}
    assert {k: v for k, (v, _) in got.items()} == brute(spec, values)
    return {k for k, (_, o) in got.items() if o == "computed"}


def test_only_what_a_change_reaches_is_computed_again(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    spec = {"a": ["1", "2"], "b": ["2", "3"], "c": ["a", "b"], "d": ["c"], "e": ["4"]}
    values = {"1": 1, "2": 2, "3": 3, "4": 4}
    assert run(spark, store, spec, values) == set(spec)
    assert run(spark, store, spec, values) == set()
    # The inputs of a and b change and their values don't, so nothing that reads them is computed again.
    assert run(spark, store, spec, {**values, "1": 0, "2": 3, "3": 2, "4": 5}) == {"a", "b", "e"}
    # A key that is new, one that is gone and one whose reader stays.
    spec = {"a": ["1", "2"], "c": ["a", "f"], "d": ["c"], "e": ["4"], "f": ["3"]}
    assert run(spark, store, spec, {**values, "1": 0, "2": 3, "3": 2, "4": 5}) == {"c", "d", "f"}


def test_keys_that_wait_for_one_another(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    with pytest.raises(memo.CycleError, match="'x', 'y'"):
        run(spark, store, {"x": ["y"], "y": ["x"], "a": ["1"]}, {"1": 1})
    assert store.current() is None


# ---- extractors


def words(uri, text):
    if "!" in text:
        raise ValueError("no")
    for w in text.split():
        yield extract.symbol(w, w, "function")
        yield extract.occurrence(w, "definition", 0, text.index(w), text.index(w) + len(w))


def files(spark, rows):
    return spark.createDataFrame([(s, f"u{i}", x, t, "h") for i, (s, x, t) in enumerate(rows)], "scope_id string, uri string, language string, text string, sha256 string")


def test_extractors_by_language(spark):
    own = extract.Extractors(spark)
    own.register(extract.Extractor("one", "1", ("go", "c"), ("symbol", "definition"), words))
    own.register(extract.Extractor("two", "3", ("py",), ("symbol",), lambda uri, text: [extract.symbol("p", "p", "class"), extract.edge("p", "q", "call", 0)]))
    out = own.export(files(spark, [("a", "go", "x y x"), ("a", "c", None), ("b", "py", "z"), ("c", "go", "x !"), ("c", "go", "ok"), ("d", "ml", "x"), ("e", "go", "k"), ("e", "py", "k")]))
    assert sorted((r.scope_id, r.id, r.kind) for r in out["symbols"].collect()) == [("a", "x", "function"), ("a", "y", "function"), ("b", "p", "class"), ("c", "ok", "function"), ("e", "k", "function"), ("e", "p", "class")]
    assert [(r.scope_id, r["from"], r.to, r.kind) for r in out["edges"].orderBy("scope_id").collect()] == [("b", "p", "q", "call"), ("e", "p", "q", "call")]
    assert [(r.scope_id, r.message) for r in out["faults"].collect()] == [("c", "ValueError: no")]
    states = {(r.scope_id, r.fact): r.state for r in out["coverage"].collect()}
    assert len(states) == 5 * 11
    assert [states[s, "symbol"] for s in "abcde"] == ["complete", "complete", "unknown", "unknown", "complete"]
    assert [states[s, "definition"] for s in "abcde"] == ["complete", "unavailable", "unknown", "unknown", "unavailable"]
    assert sorted((r.scope_id, r.extractor, r.version) for r in out["provenance"].collect()) == [("a", "one", "1"), ("b", "two", "3"), ("c", "one", "1"), ("e", "one", "1"), ("e", "two", "3")]
    # Registered functions are there for SQL as well.
    assert spark.sql("SELECT symbol_id FROM extract_one('u', 'p q') WHERE kind = 'symbol'").count() == 2


def test_extractors_run_once_for_all_facts(spark, tmp_path):
    own = extract.Extractors(spark)
    own.register(extract.Extractor("one", "1", ("go",), ("symbol",), words))
    of = files(spark, [("a", "go", "x y x"), ("c", "go", "x !")])
    kept, plain = own.export(of, str(tmp_path / "facts")), own.export(of)
    for name in ("symbols", "occurrences", "edges", "faults", "coverage"):
        assert "PythonUDTF" not in kept[name]._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, kept[name].collect()), key=str) == sorted(map(tuple, plain[name].collect()), key=str)


def test_what_an_extractor_may_not_do(spark):
    own = extract.Extractors(spark)
    own.register(extract.Extractor("one", "1", ("go",), ("symbol",), lambda uri, text: [extract.edge("a", "b", "friend", 0), {"kind": "thing"}]))
    out = own.export(files(spark, [("a", "go", "x")]))
    assert {r.message for r in out["faults"].collect()} == {"no such kind of edge: friend", "no such kind of row"} and out["edges"].isEmpty()
    assert {r.state for r in out["coverage"].collect()} == {"unknown"}
    for bad in (extract.Extractor("two", "1", ("go",), (), words), extract.Extractor("two", "1", ("c",), ("thing",), words), extract.Extractor("a b", "1", ("c",), (), words), extract.Extractor("two", "1", (), (), words)):
        with pytest.raises(extract.ExtractorError):
            own.register(bad)
    with pytest.raises(extract.ExtractorError):
        extract.Extractors(spark).export(files(spark, []))


def test_once_by_digest(spark):
    files = spark.createDataFrame([("a", "x", "t"), ("b", "x", "t"), ("c", "y", None), ("d", None, "u")], "uri string, sha256 string, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    own = F.udf(count, "string")
    out = sets.once_by_digest(files, lambda rows: rows.select("sha256", own("text").alias("text")))
    assert sorted((r.uri, r.text) for r in out.collect()) == [("a", "t"), ("b", "t"), ("c", None)]
    assert seen.value <= 3


def test_scratch_is_deleted(spark):
    with scratch(spark) as folder:
        spark.range(3).write.parquet(folder)
    assert not os.path.exists(folder)
