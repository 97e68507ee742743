"""Byte-level BPE: encode with offsets, decode (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import binary_parts, kept, make_room, slices
from factloom.llm.pretoken import pieces

#: Pieces of a generation of the cache, two of which are kept at most, and the longest such piece.
CACHED_PIECES, CACHED_BYTES = 200_000, 64
#: Bytes of text that are handled at once.
CHUNK = 1 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged, the leftmost first.

    A heap of pairs over a linked list keeps long pieces at n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceCache(dict):
    """Piece to its ids as little-endian unsigned 32-bit bytes; computes what is missing.

    When it is full, its pieces become the older generation, from which only those that
    occur again return. So frequent pieces stay, and memory is bounded.
    """

    def __init__(self, encode, most: int | None = None):
        super().__init__()
        self.encode, self.older, self.most = encode, {}, most

    def __missing__(self, piece: bytes) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = out
        return out

    def trim(self) -> None:
        if len(self) > (self.most or CACHED_PIECES):
            self.older = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes with a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.cache = PieceCache(lambda piece: merge(piece, ranks))
        self.tokens = {v: k for k, v in ranks.items()}

    def encode(self, data, at: np.ndarray):
        """For each document: its ids as bytes."""
        self.cache.trim()
        parts, heads, _ = pieces(data, at)
        get = self.cache.__getitem__
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            yield b"".join(map(get, parts[a:b]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte offset in the document of each id, and the end: what maps ids to text."""
        sizes = [len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


@kept("bpe", 2)
def codec(data: bytes) -> Codec:
    return Codec(parse_ranks(data))


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and byte offsets of every whole text.

    Rows out: id, ``ids`` and ``offsets`` (arrays; one more offset than ids).
    Null text counts as empty and has no ids. Rows are independent: repeated ids stay apart.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        make_room("bpe")
        own = codec(ranks.value)
        for batch in batches:
            data, at = binary_parts(batch.column(1))
            for i, j in slices(at, CHUNK):
                ids = list(own.encode(data, at[i : j + 1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([own.offsets(x) for x in ids], pa.list_(pa.int64()))],
                    ["id", "ids", "offsets"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, offsets array<bigint>").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: counts and digests of both, one row per row in.

    Null text counts as empty: no tokens, and digests of nothing.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        make_room("bpe")
        own = codec(ranks.value)
        for batch in batches:
            data, at = binary_parts(batch.column(1))
            n, ids_hex, text_hex = [], [], []
            for i, j in slices(at, CHUNK):
                for ids in own.encode(data, at[i : j + 1]):
                    n.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
