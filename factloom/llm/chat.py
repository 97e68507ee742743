"""Chat formatting by prefix-target expansion (operator 9), in DataFrame functions only.

Template: every turn is ``<|role|>text<|end|>``. Inside roles and texts a
backslash, ``<`` and ``|`` are written as ``\\b``, ``\\t`` and ``\\p``, so no text
can hold a control string, and reading the output back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ESCAPES = [("\\", "\\b"), ("<", "\\t"), ("|", "\\p")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One example for every turn of ``trained_role``: all turns before it, and the turn itself.

    Only the text of the last turn is under the loss mask: ``loss_length`` code points of
    ``formatted`` from ``loss_start`` (from 0). A conversation that ends with another role gets
    one more example of all its turns with an empty mask, so that nothing is lost. Turns are in
    the order of (turn, role, text), nulls first; repeated rows stay. Null texts and roles are
    empty. Rows with a null conv_id are one conversation. Other columns are left out.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    by_conversation = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    shown = F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END)))
    numbers = F.sequence(F.lit(1), F.size("ts"))
    wanted = F.filter(numbers, lambda i: (F.element_at("ts", i)["role"] == trained_role) | (i == F.size("ts")))
    one = by_conversation.select("conv_id", "ts", shown.alias("shown"), F.explode(wanted).alias("n_turns"))
    last = F.element_at("ts", F.col("n_turns"))
    loss = F.when(last["role"] == trained_role, F.length(escape(last["text"]))).otherwise(0)
    one = one.select("conv_id", "n_turns", (last["role"] == trained_role).alias("trained"), F.array_join(F.slice("shown", 1, F.col("n_turns")), "").alias("formatted"), loss.cast("long").alias("loss_length"))
    start = F.length("formatted") - F.lit(len(END)) - F.col("loss_length")
    return one.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "trained", "formatted", F.when(F.col("trained"), start).otherwise(F.length("formatted")).cast("long").alias("loss_start"), "loss_length")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    role = lambda x: F.regexp_extract(x, r"(?s)^<\|(.*?)\|>", 1)
    return F.transform(parts, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + len(OPEN) + len(CLOSE) + 1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the examples alone."""
    loss = F.substr(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))
    rows = examples.select("conv_id", "n_turns", "trained", "formatted", unescape(loss).alias("loss"))
    by = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("widest"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("n_turns", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    by = by.select("conv_id", read_turns(F.col("widest")).alias("ts"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts look like control strings; the query adds it to the table.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"

ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), s AS (
  SELECT *, sum(11 + length(replace(replace(replace(role, '\', '\b'), '<', '\t'), '|', '\p'))
                   + length(replace(replace(replace(text, '\', '\b'), '<', '\t'), '|', '\p'))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""
