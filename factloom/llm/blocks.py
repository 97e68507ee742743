"""Removal of repeated passages by fixed-block anchors (operator 12).

Words 0 to 24 of a document, 25 to 49 and so on are its reference blocks. Fifty
consecutive words always hold a whole block of any document that has them too,
so a passage of fifty words or more that two documents share shows where a
rolling window of 25 words of the one equals a reference block of the other.

1. Batches of documents send their rolling windows' hashes to parts (by range of
   hash), those at block places marked. A part knows which hashes are a block of
   one document and a window of another: these are hits.
2. Hits are extended. A block can be extended to fifty words in 26 ways, by the
   words before and behind it; every place is extended in all of them at once,
   and the fifty words go to parts by a fingerprint of 128 bits. A part answers
   which of them an earlier document has. So all members of a group of copies
   meet in one pass, and never pair by pair.
3. Extensions that an earlier document has are joined to maximal repeats, and
   their words are dropped.

The texts are shuffled once: the three passes over them share one exchange.
Batches send each distinct hash or fingerprint once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factloom.llm.common import binary_parts, kept, make_room, mix64, release, stored

#: Words of a repeat. A block is the longest that every window of so many words holds whole, wherever blocks begin.
WINDOW = 50
#: Bytes of text of a batch on average, and batches to a part.
BATCH_BYTES, PART_BATCHES = 4 << 20, 2
#: Bytes of text that are cut into words at once, and bytes of a word from which it is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 256
#: Odd multipliers of the two lanes of rolling hashes (the golden ratio's and the published murmur3 constants).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)
HASH_BITS = 48
BLOCK_BIT, SEVERAL_BIT = np.uint64(1 << HASH_BITS), np.uint64(1 << (HASH_BITS + 1))
LOW = np.uint64((1 << HASH_BITS) - 1)
NO_ID = 2**63 - 1

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def block_of(window: int) -> int:
    return (window + 1) // 2


# ---- words

#: Which bytes are white space.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def cuts(raw: np.ndarray, at: np.ndarray):
    """Bounds of consecutive parts of about PIECE bytes that no word crosses."""
    lo, n, data = 0, len(raw), memoryview(raw)
    while lo < n:
        if lo + PIECE >= n:
            hi = n
        else:
            found = _SPACE.search(data, lo + PIECE)
            ends = at[np.searchsorted(at, lo + PIECE)]
            hi = min(found.end() if found else n, int(ends))
        yield lo, hi
        lo = hi


@kept("blocks", 4)
def powers(multiplier: int, most: int) -> np.ndarray:
    out = np.full(most, multiplier, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in documents whose bounds are ``at``."""
    white = WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at[(at >= 0) & (at <= len(raw))]] = True
    begin, end = ~white, ~white
    begin[1:] &= white[:-1] | edge[1:-1]
    end[:-1] &= white[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashed_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of every word: polynomials of its bytes, taken from running sums over the text; long words go through xxh3."""
    size = 1 << max(PIECE, len(raw)).bit_length()
    symbols = raw.astype(np.uint64) + np.uint64(1)
    lanes = []
    for m in MULTIPLIERS:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * powers(m, size)[: len(raw)])))
        lanes.append(mix64((sums[end] - sums[begin]) * powers(pow(m, -1, 1 << 64), size)[begin]))
    for k in np.flatnonzero(end - begin >= LONG_WORD).tolist():
        lanes[0][k], lanes[1][k] = np.frombuffer(xxhash.xxh3_128_digest(raw[begin[k] : end[k]].tobytes()), "<u8")
    return lanes


def rolled(symbols: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """The polynomial hash of every run of ``size`` symbols, by doubling."""
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    power = lambda e: np.uint64(pow(multiplier, e, 1 << 64))
    out, covered, run, width = None, 0, symbols, 1
    while True:
        if size & width:  # this run stands before what is covered
            n = len(symbols) - covered - width + 1
            out = run if out is None else run[:n] * power(covered) + out[width : width + n]
            covered += width
        if width * 2 > size:
            return out
        run = run[:-width] * power(width) + run[width:]
        width *= 2


class Batch:
    """The documents of a batch in the order of rank: their words' places and hashes, and how far each is from its document's ends."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.take(pa.array(np.argsort(table.column("rank").to_numpy(), kind="stable")))
        data, at = binary_parts(self.table.column("text"))
        self.at = at - at[0]
        self.raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        self.window, self.block = window, block_of(window)
        found = []
        for lo, hi in cuts(self.raw, self.at):
            piece = self.raw[lo:hi]
            begin, end = word_bounds(piece, self.at - lo)
            found.append((begin + lo, end + lo, *hashed_words(piece, begin, end)))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.begin, self.end, *self.words = (np.concatenate(c) for c in zip(none, *found))
        self.bounds = np.searchsorted(self.begin, self.at)
        self.counts = np.diff(self.bounds)
        own = np.repeat(np.arange(len(self.counts)), self.counts)
        self.own_rank = self.table.column("rank").to_numpy()[own]
        self.left = self.bounds[1:][own] - np.arange(len(own))  # words from here to the document's end
        self.inside = np.arange(len(own)) - self.bounds[:-1][own]
        self.long = self.counts[own] >= window

    def rolling(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of block size in documents that hold a whole window, and their hashes."""
        at = np.flatnonzero(self.long & (self.left >= self.block))
        return at, mix64(rolled(self.words[0], self.block, MULTIPLIERS[0])[at]) & LOW

    def extensions(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that hold a hit, and both halves of their fingerprints."""
        at, h = self.rolling()
        hit = np.zeros(len(self.left) + 1, np.int64)
        hit[at + 1] = among(h, shared)
        before = np.cumsum(hit)
        starts = np.flatnonzero(self.left >= self.window)
        starts = starts[before[starts + self.window - self.block + 1] > before[starts]]
        return starts, *(mix64(rolled(w, self.window, m)[starts]) for w, m in zip(self.words, MULTIPLIERS))


def among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def heads_of(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)])


def distinct(lane0: np.ndarray, lane1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of fingerprints (equal ones in the order given), where a new one begins in it, and the number of each place's."""
    order = np.argsort(lane0, kind="stable")
    same, other = lane0[order][1:] == lane0[order][:-1], lane1[order][1:] != lane1[order][:-1]
    if (same & other).any():  # half a fingerprint in common
        order = np.lexsort((lane1, lane0))
        same, other = lane0[order][1:] == lane0[order][:-1], lane1[order][1:] != lane1[order][:-1]
    new = np.append(True, ~same | other)[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


# ---- what batches and parts send one another


def planes(values: np.ndarray) -> bytes:
    """Byte by byte of all values: sorted hashes and small numbers are compressed far better so."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def values_of(blob: bytes, dtype="<u8") -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def joined(column: pa.ChunkedArray, dtype="<u8") -> tuple[np.ndarray, list[int]]:
    """The values of all rows, and how many each row has."""
    rows = [values_of(x, dtype) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, dtype), *rows]), [len(r) for r in rows]


def ranges(top: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 32-bit number, by range."""
    return (top * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the few runs of equal numbers."""
    heads = heads_of(sorted_).tolist()
    return list(zip(heads, [*heads[1:], len(sorted_)]))


def table_of(rows: list[tuple], fields: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], fields)


def announce(table: pa.Table, parts: int, number: int, window: int) -> pa.Table:
    """The distinct hashes of a batch's rolling windows, by part; marked are blocks, and what several documents have."""
    batch = Batch(table, window)
    at, h = batch.rolling()
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    heads = heads_of(h)
    ends = np.append(heads[1:], len(h))[: len(heads)]
    block = np.maximum.reduceat(batch.inside[at] % batch.block == 0, heads) if len(heads) else np.zeros(0, bool)
    rank = batch.own_rank[at]
    several = rank[ends - 1] != rank[heads]
    packed = h[heads] | np.where(block, BLOCK_BIT, np.uint64(0)) | np.where(several, SEVERAL_BIT, np.uint64(0))
    part = ranges(h[heads] >> np.uint64(HASH_BITS - 32), parts)
    return table_of([(int(part[a]), number, planes(packed[a:b])) for a, b in runs(part)], ["part", "batch", "blob"], [pa.int64(), pa.int64(), pa.binary()])


def hits(table: pa.Table) -> pa.Table:
    """For each batch: which of its hashes are a block of one document and a window of another."""
    values, sizes = joined(table.column("blob"))
    batch = np.repeat(table.column("batch").to_numpy(), sizes)
    h = values & LOW
    order = np.argsort(h, kind="stable")
    h, values, batch = h[order], values[order], batch[order]
    heads = heads_of(h)
    count = np.diff(np.append(heads, len(h)))
    flags = np.bitwise_or.reduceat(values, heads) if len(heads) else values
    hit = np.repeat((flags & BLOCK_BIT > 0) & ((count > 1) | (flags & SEVERAL_BIT > 0)), count)
    h, batch = h[hit], batch[hit]
    order = np.argsort(batch, kind="stable")
    h, batch = h[order], batch[order]
    return table_of([(int(batch[a]), -1, planes(h[a:b])) for a, b in runs(batch)], ["batch", "part", "blob"], [pa.int64(), pa.int64(), pa.binary()])


def extended(table: pa.Table, reply: pa.Table, parts: int, number: int, window: int) -> pa.Table:
    """The distinct fingerprints of a batch's extensions with the least rank that has each, by part."""
    batch = Batch(table, window)
    starts, lane0, lane1 = batch.extensions(np.sort(joined(reply.column("blob"))[0]))
    order, heads, _ = distinct(lane0, lane1)
    first = order[heads]  # places are in the order of rank
    part = ranges(lane0[first] >> np.uint64(32), parts)
    rank = batch.own_rank[starts[first]]
    rows = [(int(part[a]), number, planes(lane0[first[a:b]]), planes(lane1[first[a:b]]), planes(rank[a:b])) for a, b in runs(part)]
    return table_of(rows, ["part", "batch", "lane0", "lane1", "ranks"], [pa.int64(), pa.int64(), *[pa.binary()] * 3])


def earlier(table: pa.Table) -> pa.Table:
    """For each batch, in the order it sent them: a bit for each fingerprint that a smaller rank has."""
    lane0, sizes = joined(table.column("lane0"))
    lane1, rank = joined(table.column("lane1"))[0], joined(table.column("ranks"), "<i8")[0]
    order, heads, number = distinct(lane0, lane1)
    least = np.minimum.reduceat(rank[order], heads)[number] if len(heads) else rank
    bits, rows, at = least < rank, [], 0
    for batch, part, size in zip(table.column("batch").to_pylist(), table.column("part").to_pylist(), sizes):
        own = bits[at : at + size]
        at += size
        if own.any():
            rows.append((batch, part, np.packbits(own).tobytes()))
    return table_of(rows, ["batch", "part", "blob"], [pa.int64(), pa.int64(), pa.binary()])


def remove(table: pa.Table, reply: pa.Table, parts: int, window: int, keep: list[str]) -> pa.Table:
    """A batch's documents without the words of the extensions that an earlier document has."""
    batch = Batch(table, window)
    of = reply.column("part").to_numpy()
    starts, lane0, lane1 = batch.extensions(np.sort(joined(reply.filter(pa.array(of < 0)).column("blob"))[0]))
    order, heads, number = distinct(lane0, lane1)
    first = order[heads]
    answered = np.zeros(len(heads), bool)
    own_part = ranges(lane0[first] >> np.uint64(32), parts)
    slots = {int(own_part[a]): (a, b) for a, b in runs(own_part)}
    for part, blob in zip(of.tolist(), reply.column("blob").to_pylist()):
        if part >= 0:
            a, b = slots[part]
            answered[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
    rank = batch.own_rank[starts]
    gone = starts[answered[number] | (rank > rank[first][number])]
    cover = np.zeros(len(batch.left) + window + 1, np.int64)
    cover[gone] += 1
    cover[gone + window] -= 1
    stays = np.cumsum(cover)[: len(batch.left)] <= 0
    before = np.concatenate(([0], np.cumsum(stays)))[batch.bounds]
    removed = batch.counts - np.diff(before)
    # What stays of a document: its words, and the byte of white space behind each but the last.
    begin, end = batch.begin[stays], batch.end[stays]
    last = before[1:][np.diff(before) > 0] - 1
    apart = np.delete(end, last)
    inside = np.zeros(len(batch.raw) + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    taken = np.cumsum(inside[:-1], dtype=np.int8) > 0
    taken[apart] = True
    out = batch.raw.copy()
    out[apart] = 0x20
    size = np.add.accumulate(np.append(0, end - begin + 1))[before]
    size = np.maximum(np.diff(size) - 1, 0)
    texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(out[taken])]).cast(pa.binary())
    columns = [*[batch.table.column(c) for c in keep], pa.array(batch.counts), pa.array(removed), texts]
    return pa.table(columns, [*keep, "n_words", "n_removed", "kept"])


def ranked(docs: DataFrame, id_col: str, rows: DataFrame, most: int | None) -> tuple[DataFrame, Column]:
    """``rows`` and an expression for the place of their ``id`` in the order of ids; null is last."""
    if isinstance(docs.schema[id_col].dataType, IntegralType) and (most is None or most < NO_ID):
        return rows, F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))
    ids = docs.select(F.col(f"`{id_col}`").alias("ranked")).where("ranked IS NOT NULL").distinct()
    numbers = stored(ids.orderBy("ranked").withColumn("number", F.monotonically_increasing_id()), "ranks")
    return rows.join(numbers, F.col("id") == F.col("ranked"), "left"), F.coalesce("number", F.lit(NO_ID))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller id.

    Rows out, one per row of ``docs``: the columns ``keep`` (default: the id), n_words, n_removed and
    kept_text (the remaining words, joined by one space). Words are separated by ASCII white space and
    compared byte by byte; null text has none, long texts are read whole, windows don't cross
    documents and are judged on the texts as they came in. Ids of any type that can be ordered will do.
    A null id is larger than every other; rows with one id, repeated or not, don't remove from one
    another. An empty table gives an empty result; columns of any name may stand beside id and text.
    Fingerprints have 128 bits: among 10**13 windows two different ones agree with probability under 1e-12.
    """
    keep = keep if keep is not None else [id_col]
    names = [f"keep {i}" for i in range(len(keep))]
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    size, most = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.max(F.col(f"`{id_col}`").cast("long") if whole else F.lit(0).cast("long"))).first()
    batches, parts = (max(1, -(-int(size or 0) // n)) for n in (batch_bytes, PART_BATCHES * batch_bytes))
    rows = docs.select(
        # Rows that repeat an id and a text are dealt out too, by the partition they are read in.
        F.pmod(F.xxhash64(F.lit("blocks"), F.col(f"`{id_col}`"), text, F.spark_partition_id()), F.lit(batches)).alias("batch"),
        F.col(f"`{id_col}`").alias("id"),
        text.alias("text"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
    )
    rows, rank = ranked(docs, id_col, rows, most)
    rows = rows.select("batch", rank.alias("rank"), "text", *[F.col(f"`{n}`") for n in names])
    number = lambda t: t.column("batch")[0].as_py()

    def alone(f):
        def run(t):
            make_room("blocks")
            try:
                return f(t)
            finally:
                release()

        return run

    def paired(f):
        def run(t, reply):
            make_room("blocks")
            try:
                return f(t, reply)
            finally:
                release()

        return run

    answer = "batch bigint, part bigint, blob binary"
    announced = rows.groupBy("batch").applyInArrow(alone(lambda t: announce(t, parts, number(t), window)), "part bigint, batch bigint, blob binary")
    shared = announced.groupBy("part").applyInArrow(alone(hits), answer)
    sent = rows.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(paired(lambda t, r: extended(t, r, parts, number(t), window)), "part bigint, batch bigint, lane0 binary, lane1 binary, ranks binary")
    seen = sent.groupBy("part").applyInArrow(alone(earlier), answer)
    kinds = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.groupBy("batch").cogroup(shared.unionByName(seen).groupBy("batch")).applyInArrow(paired(lambda t, r: remove(t, r, parts, window, names)), f"{kinds}n_words bigint, n_removed bigint, kept binary")
    return out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, keep)], "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


#: For small tables: it has a row for every window.
ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW})
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s) WHERE first < doc_id
), dropped AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE (SELECT string_agg(word, ' ' ORDER BY j) FROM (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j) WHERE NOT list_contains(js, j)) END, '')) AS kept_sha256
FROM t LEFT JOIN dropped USING (doc_id)
"""
