"""The stages on awkward tables, and the queries of this subpackage against their SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from factloom.llm import entry
from tests.llm.helpers import documents, empty, prose, rows
from tests.llm.test_operators import brute_near


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = documents(spark, extra=True)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        path = str(tmp_path / f"{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {1, 12, 16} <= ids, name
            if i == 0:
                assert not ids & {5, 6, 7, 13, 15}
            if i == 1:
                assert not ids & {2, 4} and docs.where("doc_id = 11").count() == 1
            if i == 2:
                assert 3 not in ids and 10 not in ids
            if i == 3:
                text = docs.where("doc_id = 12").first()
                assert rows()[0][1][150:350] not in text.text and text.n_chars == len(text.text)
    assert docs.count() > 0


def test_near_copies_go_row_by_row(spark):
    """Rows that repeat an id, rows without one, and a column that was named as an inner one."""
    base, other, third = prose(1, 80), prose(2, 80), prose(3, 80)
    table = [(1, base), (2, base + " end"), (2, other), (3, other + " end"), (None, third), (None, third + " end"), (None, None), (4, ""), (5, "  "), (6, third + " stop")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "k", "r") for i, t in table], "doc_id long, text string, lang string, source string, n_chars long, `kept id` string, row string")
    out = corpus_pipeline.without_near_copies(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, base), (2, other), (None, None), (4, ""), (5, "  "), (6, third + " stop")]))
    # Ids that are all different take the shorter way to the same rows.
    unique = df.where("doc_id <> 2")
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, unique, "").collect()} == {1, 3, 4, 5, 6}


def test_near_copies_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, component) in brute_near(texts, 5, 80).items() if component == i}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).select("doc_id").collect()} == want
    assert len(want) < len(texts)


def test_texts_near_no_learned_language_go(spark, sf_dir):
    draw = random.Random(5)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(2, 9)))
    alphabets = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x4E00 + 1500))), "abcdefghijklmnopqrstuvwxyz"]
    foreign = [" ".join(word(letters) for _ in range(n)) for letters in alphabets for n in (40, 200) for _ in range(50)]
    foreign += ["suurin osa ihmisistä asuu kaupungeissa jotka ovat lähellä vettä ja he työskentelevät usein toimistossa tai kaupassa", "de meeste mensen in het land wonen in steden die aan het water liggen en zij werken vaak in een kantoor of in een winkel "
                "maar op zondag gaan ze met hun kinderen naar het bos om er te wandelen of om bij vrienden koffie te drinken en over vroeger te praten "
                "want toen was alles volgens de oudere mensen veel goedkoper dan nu en had iedereen nog tijd voor elkaar"]
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    added = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.by_language(spark, docs.unionByName(added), "").select("doc_id").collect()}
    assert not [foreign[i - 10**9][:40] for i in kept if i >= 10**9]
    short = docs.where("length(text) < 100").count()
    assert short > 5 and len(kept) >= 0.995 * docs.count()
    assert docs.where("length(text) < 100").where(~docs.doc_id.isin(list(kept))).count() <= 0.1 * short


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_every_query_gives_all_rows(spark, sf_dir, name):
    out = entry.queries()[name](spark, sf_dir)
    table = {"op5_html_text": ("pages", "page_id"), "op9_chat_format": ("conversations", "conv_id"), "op11_vector_codes": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    ids = spark.read.parquet(f"{sf_dir}/{table[0]}.parquet").select(table[1]).distinct().count()
    assert out.select(table[1]).distinct().count() == ids + (name == "op9_chat_format")
