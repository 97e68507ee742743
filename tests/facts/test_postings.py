"""Postings that are put together inside documents, against the words that Spark's own functions find."""

from pyspark.sql import functions as F

from factloom.plans import index
from factloom.sources import tables

TEXTS = [
    "a b a\nB  c \n\n a", "", None, " ", "\n", "x\r\ny\rz", "ΣΑΣ ΣΑΣ.\nİstanbul I ı", "😀 é😀x y\n𝒳y Yé é", "tab\tin word and sep a\x0bb",
    "Straße STRASSE ǅ ŉ", "word " * 500 + "End", "\x00 nul a", "ẞ" * 3 + " 𐐀 𐐨",
]


def documents(spark):
    rows = [(i, t, "s1" if i % 3 else None, None if i % 4 == 0 else "en") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def postings(spark, rows, folder):
    index.relations(rows, folder)
    return spark.read.parquet(f"{folder}/postings")


def test_postings_hold_every_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PLACES", 50)
    rows = documents(spark)
    made = postings(spark, rows, str(tmp_path / "made"))
    flat = made.select("scope_id", "symbol_id", "doc_id", "uri", "language", F.posexplode("places").alias("k", "p"), "token").select("*", "p.*")
    keys = ["scope_id", "symbol_id", "doc_id", "uri", "language", "line", "start_char", "end_char"]
    got = sorted(map(tuple, flat.select(*keys).collect()), key=str)
    words = tables.occurrences(tables.files(rows))
    assert got == sorted(map(tuple, words.select(*keys).collect()), key=str) and len(got) > 500
    # The spelling is that of the first place.
    first = {(r.doc_id, r.line, r.start_char): r.token for r in words.collect()}
    assert all(r.token == first[r.doc_id, r.line, r.start_char] for r in flat.where("k = 0").collect())


def test_places_are_in_order(spark, tmp_path):
    made = postings(spark, documents(spark), str(tmp_path / "made"))
    assert made.where(~F.col("places").eqNullSafe(F.sort_array("places"))).count() == 0
    assert made.groupBy("scope_id", "symbol_id", "doc_id").count().where("count > 1").count() == 0


def test_no_documents(spark, tmp_path):
    assert postings(spark, documents(spark).where("false"), str(tmp_path / "made")).count() == 0


def test_postings_know_their_definitions(spark, tmp_path):
    """Roles and uses are there before postings are shuffled, so no join follows."""
    rows = documents(spark).where("source IS NOT NULL")
    made = postings(spark, rows, str(tmp_path / "made"))
    got = made.where("defines").select("scope_id", "symbol_id", "doc_id", F.col("places")[0]["line"], F.col("places")[0]["start_char"], "token", "uses")
    want = tables.definitions(tables.occurrences(tables.files(rows))).select("scope_id", "symbol_id", "doc_id", "line", "start_char", "token", "uses")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_stay_out_of_shuffles(spark, tmp_path):
    """References are counted, and words looked for, before anything is joined."""
    path = str(tmp_path / "documents.parquet")
    documents(spark).write.parquet(path)
    found = index.stored_index(spark, path, str(tmp_path / "store"))
    targets = spark.createDataFrame([(1, "s1", "a")], "query_id int, scope_id string, symbol_id string")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "LeftSemi" not in plan(found.reference_summary(targets)) and "Join" not in plan(found.counts())
    assert not [x for x in plan(found.edits(targets, "b")).splitlines() if "Deduplicate" in x and "line#" in x]


def test_definitions_in_one_shuffle(spark):
    """Symbols meet once, with place and spelling: no text is joined and no list of a document's symbols is made."""
    rows = tables.files(documents(spark).where("source IS NOT NULL"))
    want = tables.definitions(tables.occurrences(rows)).drop("source_hash")
    made = tables.defined(rows)
    assert sorted(map(tuple, made.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_questions_are_answered_in_their_lines(spark):
    lines = spark.createDataFrame([(1, "a Bc  d", 2), (2, "a Bc", 1), (3, "", 0), (4, "😀 x", 3), (5, "w " * 5000, 9998)], "k long, line_text string, char long")
    found = index.words_at(lines, ["k"])
    assert sorted(map(tuple, found.collect())) == [(1, "bc"), (4, "x"), (5, "w")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_references_are_counted_in_one_shuffle(spark):
    """Against all places: the definition, wherever the least line is, is left out or not."""
    rows = tables.files(documents(spark).where("source IS NOT NULL").unionByName(spark.createDataFrame([(100, "q\nz z", "s1", "en"), (101, "z", "s1", "en"), (102, "x\n\nonly only", "s9", "en"), (103, "only", "s9", "en")], "doc_id long, text string, source string, lang string")))
    roles = tables.with_roles(tables.occurrences(rows))
    keys = roles.select("scope_id", "symbol_id").distinct().withColumn("query_id", F.concat_ws("|", "scope_id", "symbol_id"))
    from factloom.operators import facts

    for declarations in (False, True):
        made = tables.reference_counts(rows, declarations)
        want = facts.reference_summary(roles, keys, declarations).select("scope_id", "symbol_id", "places", "documents", "least_line", "starts")
        assert sorted(map(tuple, made.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
