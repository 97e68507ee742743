"""Vector codes with VA-file filtering (operator 11).

Vectors of integers are cut into equal parts, and each part is replaced by the
number of its nearest codebook entry. The search for it goes by a vector
approximation file: the entries' coordinates are quantised to a few bits, so
that each lies in a cell of its dimension. For a part, a table of its squared
distances to the near and far side of every cell gives a lower and an upper
bound for each entry by adding up looked-up numbers. Entries whose lower bound
isn't above the least upper bound are candidates, and only these are compared
in full, with integers.

Codebooks are learned in rounds over all vectors. A task adds up its own parts
by entry, so that what is shuffled and what reaches the driver is one row for
each part position and entry, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import make_room, stored

#: Part positions, entries of a codebook, rounds, and what a component is multiplied by before it is floored.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate's cell.
CELL_BITS = 3
#: Vectors that are handled at once.
STEP = 2048


class Approximation:
    """The entries (entry x dimension) of one part position, and the cells that their coordinates are in."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        count, width = entries.shape
        cells = min(1 << bits, count)
        # Cells hold about as many coordinates each: the k-th smallest of a dimension is in cell k * cells / count.
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((count, width), np.int64)
        np.put_along_axis(self.cell, order, np.repeat((np.arange(count) * cells // count)[:, None], width, 1), 0)
        inside = self.cell[None] == np.arange(cells)[:, None, None]
        far = np.iinfo(np.int64).max
        self.low = np.where(inside, entries[None], far).min(1)  # cell x dimension
        self.high = np.where(inside, entries[None], -far).max(1)

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the squared distance of every part to every entry."""
        q = parts[:, None, :]
        near = np.maximum(np.maximum(self.low[None] - q, q - self.high[None]), 0) ** 2
        far = np.maximum(np.abs(q - self.low[None]), np.abs(self.high[None] - q)) ** 2
        lower, upper = (np.zeros((len(parts), len(self.entries)), np.int64) for _ in range(2))
        for d in range(parts.shape[1]):
            lower += near[:, self.cell[:, d], d]
            upper += far[:, self.cell[:, d], d]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part; of equally near entries the first."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        best = exact.argmin(1)
        return best, exact[np.arange(len(parts)), best]


def components(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's vectors of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assigned(vectors: np.ndarray, approximations: list[Approximation]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance by vector and part position."""
    width = vectors.shape[1] // len(approximations)
    found = [a.nearest(vectors[:, p * width : (p + 1) * width]) for p, a in enumerate(approximations)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def integers(vectors: DataFrame, id_col: str, vector_col: str, keep: list[str], scale: int) -> DataFrame:
    """Rows whose vector has finite components only: ``id``, the columns ``keep`` by number, and ``v``, scaled and floored."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(v.isNotNull() & finite)
    return kept.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"keep {i}") for i, c in enumerate(keep)], F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def dimension(rows: DataFrame, parts: int) -> int | None:
    """The number of components that most vectors have (None without vectors); an error where codes aren't possible."""
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("rows"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most"))
    top = sizes.orderBy(F.desc("rows"), F.desc("dims")).first()
    if top is None:
        return None
    if top.dims % parts:
        raise ValueError(f"vectors of {top.dims} components can't be cut into {parts} equal parts")
    # (2 * most) ** 2 for every component has to fit in a long.
    if top.dims and top.dims * (2 * top.most + 1) ** 2 >= 2**63:
        raise ValueError(f"components of {top.most} after scaling have distances over 64 bits")
    return top.dims


def one_round(rows: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks (part x entry x component) after one assignment of all vectors."""
    parts, entries, width = books.shape

    def run(batches):
        make_room("vectors")
        approximations = [Approximation(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                v = components(batch.column(0).slice(i, STEP), dims)
                best, _ = assigned(v, approximations)
                for p in range(parts):
                    np.add.at(total[p], best[:, p], v[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(best[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.select("v").mapInArrow(run, "part bigint, entry bigint, n bigint, total array<bigint>")
    added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total"))
    after = books.copy()
    # As many rows as entries, whatever the number of vectors.
    for r in added.collect():
        after[r.part, r.entry] = [t // r.n for t in r.total]
    return after


def learn(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks that begin as the parts of the vectors with the smallest ids, then follow all vectors."""
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = one_round(rows, books, dims)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """``rows`` with ``code`` (two hexadecimal digits a part) and ``error`` in place of the vector."""
    rest = [c for c in rows.columns if c != "v"]

    def run(batches):
        make_room("vectors")
        approximations = [Approximation(b) for b in books]
        for batch in batches:
            codes, errors = [], []
            for i in range(0, batch.num_rows, STEP):
                best, distance = assigned(components(batch.column(0).slice(i, STEP), dims), approximations)
                codes += [row.tobytes().hex() for row in best.astype(np.uint8)]
                errors.append(distance.sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *errors]))], [*rest, "code", "error"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.select("v", *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, code string, error bigint")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector that is kept: id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, and so are those with
    another number of components than most have (of equally many, the longer). Components become
    floor(scale * x). Codebooks begin as the parts of the ``entries`` rows with the smallest ids
    (null ids last, equal ids by their vectors; fewer rows, fewer entries); unused entries stay as they
    are. Of equally near entries the first counts. ``label_error`` is the error summed over the rows
    of a label, null labels together. Repeated rows count as often as they are there; an empty
    table gives an empty result; columns of any name may stand beside the three. Distances are
    exact: components too large for 64-bit distances are refused, as are numbers of
    components that the parts don't divide, and more than 256 entries.
    """
    if entries > 256:
        raise ValueError("two hexadecimal digits number 256 entries")
    rows = integers(vectors, id_col, vector_col, [label_col], scale)
    dims = dimension(rows, parts)
    if dims is None:
        none = rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
        return none.where("false")
    rows = rows.where(F.size("v") == dims)
    books = learn(rows, dims, parts, entries, rounds)
    # Both sides of the join are tables, so that a label with very many rows can be split.
    coded = stored(encode(rows, books, dims), "codes")
    by_label = stored(coded.groupBy(F.col("keep 0").alias("label")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(by_label, F.col("keep 0").eqNullSafe(F.col("label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one by one, each entry compared with each part."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT id, part, any_value(q) AS q, arg_min({{'e': entry, 'd': d}}, {{'d': d, 'e': entry}}) AS best
  FROM (SELECT p.id, p.part, p.q, c.entry, list_sum(list_transform(list_zip(p.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM p JOIN c{r} c USING (part))
  GROUP BY id, part
)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT part, entry, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY k) AS q
  FROM (SELECT part, best.e AS entry, k, sum(q[k])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT any_value(len(q)) FROM p) + 1) t(k) GROUP BY ALL) GROUP BY part, entry
), c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS q FROM kept, range({PARTS}) t(part)
), c0 AS MATERIALIZED (
  SELECT part, entry, q FROM p JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM kept ORDER BY id LIMIT {ENTRIES}) USING (id)
), {", ".join(steps)}, coded AS (
  SELECT id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id
), books AS (
  SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
), labels AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (id) GROUP BY label
)
SELECT coded.id AS vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (id) JOIN labels ON kept.label IS NOT DISTINCT FROM labels.label, books
"""


ORACLE_SQL = _oracle()
