"""The queries of this subpackage, each over its whole table, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import blocks, bpe, chat, exact, fim, html, langid, linededup, minhash, packing, quality, suffix, vectors
from factloom.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table whose rows are worked on one by one: dealt out where its files are too few for the cores."""
    return spread(table(spark, sf_dir, name), key)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_verdicts(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(texts(spark, sf_dir, "pages", "page_id"), keep=["page_id", "url"])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256").drop("file", "number")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    prototypes = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, prototypes, keep=["doc_id"]).select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(texts(spark, sf_dir), words=3, percent=85)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("id")
    probe = spark.range(2).select(F.lit(chat.PROBE_ID).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PROBE_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chat(turns))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.remove_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(texts(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_packing, op4_suffix_dedup, op5_html_text, op6_exact_dedup, op7_language_id, op8_minhash, op9_chat_format, op10_byte_bpe, op11_vector_codes, op12_substring_dedup, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.ORACLE_SQL, "op4_suffix_dedup": suffix.ORACLE_SQL, "op6_exact_dedup": exact.ORACLE_SQL, "op8_minhash": minhash.ORACLE_SQL, "op9_chat_format": chat.ORACLE_SQL, "op11_vector_codes": vectors.ORACLE_SQL, "op12_substring_dedup": blocks.ORACLE_SQL, "op13_fill_in_middle": fim.ORACLE_SQL}
