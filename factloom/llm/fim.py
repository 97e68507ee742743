"""Fill-in-the-middle examples (operator 13).

The Split pre-tokenizer of the tokenizers library, with isolated matches of a
pattern and nothing learned, gives the code-point offsets of a text's units.
Their array's length gives the number of units, and two ranks in it the places
where prefix, middle and suffix are sliced. What a document becomes is read from
a hash of its id, so that it doesn't depend on the other rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from factloom.llm.common import binary_parts, make_room, slices

#: What a unit is, and what marks prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents those that stay plain, and of a hundred others those with the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Code points that the library is given at once; its time for a unit grows with the text.
STEP = 4096
#: Bytes of text of an output batch.
CHUNK = 1 << 20

#: Where a text may be cut without cutting a unit: behind anything but a letter.
_BEHIND = re.compile("[^A-Za-z]")


def segments(text: str, step: int = STEP):
    """Bounds of consecutive parts of about ``step`` code points that no unit crosses."""
    lo, n = 0, len(text)
    while lo < n:
        cut = _BEHIND.search(text, min(n, lo + step - 1))
        hi = cut.end() if cut else n
        yield lo, hi
        lo = hi


def unit_offsets(text: str, splitter: Split) -> np.ndarray:
    """The code-point offset of every unit, and the end of the text."""
    ends = [np.zeros(1, np.int64)]
    for lo, hi in segments(text):
        units = splitter.pre_tokenize_str(text[lo:hi])
        ends.append(np.fromiter((b for _, (_, b) in units), np.int64, len(units)) + lo)
    return np.concatenate(ends)


def draws(key: str) -> list[int]:
    """The first four groups of eight digits of the key's SHA-256, as numbers."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key: str, splitter: Split, plain_percent: int, spm_percent: int) -> tuple:
    """Number of units, form, code points of prefix and middle (None if plain), and the example."""
    at = unit_offsets(text, splitter)
    n = len(at) - 1
    one, two, form, order = draws(key)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or form % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    a, b = (int(at[i]) for i in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: the id), n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units of the text, ``form`` is plain, psm or spm, the two numbers are code
    points and null where the form is plain, ``output`` is the example. Plain are also empty texts
    and those that hold a mark. Null text counts as empty; long texts are read whole, in parts that
    no unit crosses; bytes that aren't UTF-8 are read as U+FFFD. A null id is hashed as if it had no
    digits. Rows are independent: repeated rows get equal results, an empty table gives an empty
    result, and columns of any name may stand beside id and text.
    """
    keep = keep if keep is not None else [id_col]
    names = [f"keep {i}" for i in range(len(keep))]
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("binary")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(text.alias("text"), key.alias("key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    made = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches):
        make_room("fim")
        splitter = Split(Regex(UNIT), "isolated")
        for batch in batches:
            data, at = binary_parts(batch.column(0))
            keys = batch.column(1).to_pylist()
            for i, j in slices(at, CHUNK):
                out = [transform(str(data[at[k] : at[k + 1]], "utf-8"), keys[k], splitter, plain_percent, spm_percent) for k in range(i, j)]
                columns = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*out), made)]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[2:]], *columns], [*names, *[n for n, _ in made]])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    fields = ", ".join(f"{n} {'string' if kind == pa.string() else 'bigint'}" for n, kind in made)
    out = rows.mapInArrow(run, f"{kinds}, {fields}" if names else fields)
    return out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, keep)], *[n for n, _ in made])


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an example was made of. Texts with marks are plain, so each mark is there once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # nothing, first, second, middle
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
         sha256(concat('1:', doc_id)) AS h
  FROM documents
), d AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t
), f AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS a, greatest(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d
), s AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
