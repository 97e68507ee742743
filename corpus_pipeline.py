"""A training corpus from documents: filter by language, deduplicate three ways, pack.

Every stage takes and returns the columns of documents, whatever else they hold,
except the last, which returns pieces of packed sequences. Results of stages are
Parquet tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact, langid, minhash, packing, suffix
from factloom.llm.common import scratch, stored

#: Cosine under which a text is in none of the learned languages, where too few texts have a language to read it from.
LEAST_SCORE = 0.05


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with neutral column names, so that none clashes with an operator's; and the names."""
    names = {c: f"column {i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Texts without letters, null texts and ones near no language go.

    Near is what scores as the texts do that the languages were learned from, by length.
    Where no document has a language and a text, nothing can be learned, and all stay.
    """
    learned = docs.where(~langid.held_out())
    prototypes = langid.train(learned)
    if not prototypes:
        return docs
    least = langid.calibrate(learned, prototypes, LEAST_SCORE)
    plain, names = numbered(docs)
    judged = langid.identify(plain, prototypes, text_col=names["text"], keep=list(names.values()), least=least)
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).drop("lang_pred", "score").toDF(*names)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id; of repeated rows one.

    White space runs count as one space and null texts as empty; rows without doc_id come last.
    """
    plain, names = numbered(docs)
    return exact.without_copies(plain, names["doc_id"], names["text"]).toDF(*names)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id.

    Rows are judged one by one, also where they repeat an id: of rows that have it the first by
    their place in the table counts as smaller, and rows without one come last. Null, empty and
    blank texts are linked with nothing and stay.
    """
    plain, names = numbered(docs)
    id_, text = names["doc_id"], names["text"]
    if plain.groupBy(id_).count().where(F.col(id_).isNull() | (F.col("count") > 1)).isEmpty():
        kept = minhash.near_duplicates(plain, id_col=id_, text_col=text).where("kept").select(F.col(id_).alias("kept row"))
        return plain.join(kept, F.col(id_) == F.col("kept row"), "left_semi").toDF(*names)
    plain = exact.located(plain)
    row = F.struct(F.col(id_).isNull().alias("no_id"), F.col(id_).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))
    own = plain.select("*", row.alias("row"))
    kept = minhash.near_duplicates(own, id_col="row", text_col=text).where("kept").select(*[F.col(f"row.{c}").alias(f"kept {c}") for c in ("file", "number")])
    return own.join(kept, (F.col("row.file") == F.col("kept file")) & (F.col("row.number") == F.col("kept number")), "left_semi").drop("row").toDF(*names)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents with nothing left go.

    A character is dropped whole when only some of its bytes are in such a passage. ``n_chars``
    counts what is left; null texts stay null.
    """
    plain, names = numbered(docs)
    text, id_ = names["text"], names["doc_id"]
    rest = [c for c in names.values() if c != text]
    flagged = plain.withColumn("no text", F.col(f"`{text}`").isNull())
    out = suffix.remove_repeats(flagged, id_, text, keep=[*rest, "no text"], whole_characters=True)
    out = out.where("n_bytes = 0 OR n_removed < n_bytes").withColumn(text, F.when(~F.col("no text"), F.col("kept_text")))
    if "n_chars" in names:
        n = F.col(f"`{names['n_chars']}`")
        out = out.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, F.length(F.col("kept_text"))).otherwise(n).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{x}`") for x in names.values()]).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. Null and empty texts are one piece, of the final token; repeated rows are packed as often as they are there."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", by_language),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("repeated passages", without_repeats),
    ("packing", packed),
]

#: SQL can express neither the prototypes nor the tokens; tests hold each operator against brute force, and what the stages decide on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; what a stage put into the shared folder goes when the next one has its table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            own = made.pop()
            made += before
            before = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
