"""Words cut side by side, and the queries that put them together inside their document's row."""

import pytest
from pyspark.sql import functions as F

from factloom.plans import checks, queries
from factloom.sources import interop, tables, words

TEXTS = [
    "a b a\nB  c \n\n a", "", None, " ", "\n", "x\r\ny\rz", "ΣΑΣ ΣΑΣ.\nİstanbul I ı", "😀 é😀x y\n𝒳y Yé é", "tab\tin word and sep a\x0bb", "end\r", "\r\n\r\nq",
    "Straße STRASSE ǅ ŉ", "word " * 500 + "End", "\x00 nul a", "ẞ" * 3 + " 𐐀 𐐨",
]


def files(spark):
    rows = [(i, t, "s1" if i % 3 else None, None if i % 4 == 0 else "en") for i, t in enumerate(TEXTS)]
    return tables.files(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_steps_and_runs_do_not_show(spark, monkeypatch, step):
    """The same words from slices of any size, over runs of few words."""
    whole = rows(tables.words(files(spark), following=True))
    step_, run_ = words.STEP, words.RUN
    cut = words.run_cutter(1, True, True)
    import pyarrow as pa

    try:
        words.STEP, words.RUN = step, 3
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([t or "" for t in TEXTS])], ["doc_id", "text"])
        got = [(r["doc_id"], r["line"], *w.values()) for b in cut(iter([batch])) for r in b.to_pylist() for w in r["words"]]
    finally:
        words.STEP, words.RUN = step_, run_
    want = tables.words(files(spark), following=True).select("doc_id", "line", "token", "start_char", "end_char", "to", "to_end")
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in want.collect()) and len(whole) > 500


def test_definitions_as_from_single_places(spark):
    own = files(spark).where("scope_id IS NOT NULL")
    want = tables.definitions(tables.occurrences(own))
    assert rows(tables.definitions_of(own).select(want.columns)) == rows(want)


def test_documents_as_from_single_places(spark):
    own = files(spark).where("scope_id IS NOT NULL")
    occ = tables.with_roles(tables.occurrences(own))
    want = interop.scip_documents(occ, tables.symbols(tables.definitions(occ.drop("role"))), own)
    assert rows(interop.scip_documents_of(own).select(want.columns)) == rows(want)


@pytest.mark.parametrize("name", ["scip_documents", "scip_roundtrip", "occurrence_facts", "stale_occurrences"])
def test_words_do_not_become_rows(spark, sf_dir, name):
    """What a document or a line says of its own words is put together in its row."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("name", ["symbol_documents", "unresolved_references"])
def test_only_symbols_are_shuffled(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(queries, "fixed", lambda df: df)
    assert "Generate posexplode" not in queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_only_lines_asked_for_are_cut(spark, sf_dir):
    plan = queries.ambiguous_positions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "(line#" in plan and " = 0)" in plan


@pytest.mark.parametrize("name", ["call_edges", "record_violations"])
def test_words_are_cut_side_by_side(spark, sf_dir, name):
    assert "MapInArrow" in queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["index_by_document", "index_by_symbol"])
def test_stored_order_is_gone_through_in_batches(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(checks, "fixed", lambda df: df)
    plan = checks.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "row_index" not in plan and "MapInArrow" in plan


def test_neighbours_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        occ = spark.createDataFrame([(f"u{i % 3}", i // 7, i, i + 1, None if i % 5 else "s", "x") for i in range(40)], "uri string, line long, start_char long, end_char long, scope_id string, symbol_id string")
        got = {r.uri: (r.n, r.ordered) for r in checks._neighbours(occ, ["uri", "line", "start_char", "end_char", "scope_id", "symbol_id"], "uri").collect()}
        broken = checks._neighbours(occ.withColumn("line", F.lit(1)).withColumn("start_char", F.lit(1)).withColumn("end_char", F.lit(1)).withColumn("scope_id", F.lit("s")), ["uri", "line", "start_char", "end_char", "scope_id", "symbol_id"], "uri")
        assert got == {"u0": (14, 13), "u1": (13, 12), "u2": (13, 12)}
        assert {r.ordered for r in broken.collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
