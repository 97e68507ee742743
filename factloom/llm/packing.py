"""Packing documents into training sequences (operator 3).

First-fit decreasing over a tournament tree of free bin capacities, run
independently in random groups of documents.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import CHUNK, PieceCache, read_bytes
from factloom.llm.common import binary_parts, kept, make_room, release, slices, small_batches, stored
from factloom.llm.pretoken import pieces

#: Tokens of a sequence, and documents of a group on average.
SEQUENCE, GROUP_DOCUMENTS = 1024, 4096
#: Pieces that a worker remembers in each of two generations; here another is soon merged.
KEPT_PIECES = 100_000
#: Bits of a sequence_id that number the sequences of one group.
GROUP_BITS = 36


class Tournament:
    """Bins in order of opening; each inner node holds the larger free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room: its number, and its free capacity before."""
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        had = free[i]
        free[i] = had - size
        bin_ = i - self.leaves
        i >>= 1
        while i:
            best = free[2 * i] if free[2 * i] >= free[2 * i + 1] else free[2 * i + 1]
            if free[i] == best:
                break
            free[i] = best
            i >>= 1
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size; larger first, equal sizes in the order given."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return bins, offsets
    tree = Tournament(n, capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def ranks_of(vocabulary: bytes) -> dict[bytes, int] | None:
    """Byte strings to ids of a byte-level BPE file, if its merges are in the order of their ids."""
    model = json.loads(vocabulary)["model"]
    # Byte-level files write each byte as a printable character: itself, or one from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = model["vocab"]
    merges = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(b <= a for a, b in zip(merges, merges[1:])) or not all(c in vocab for c in byte_of):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and (len(token) == 1 or i >= merges[0])}


class Encoder:
    """Ids of texts: added tokens are taken out first, as the library does, then come the pre-tokens.

    Of added tokens that begin at one place the longest is taken, and what is between two is a text
    of its own. Where one takes white space along, or asks for whole words or a normalised text,
    a text with any goes through the library as it is.
    """

    def __init__(self, vocabulary: bytes):
        self.cache = piece_cache(vocabulary)
        file = json.loads(vocabulary)
        added, vocab = file.get("added_tokens") or [], file["model"]["vocab"]
        # An added token that the vocabulary has too keeps the vocabulary's id, as in the library.
        self.added = {t["content"].encode(): np.array([vocab.get(t["content"], t["id"])], "<u4").tobytes() for t in added}
        self.vocabulary = vocabulary
        self.plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None

    def ordinary(self, data: memoryview | bytes, at: np.ndarray) -> list[bytes]:
        """The ids, as bytes, of each text between the offsets ``at``, in which no added token is."""
        parts, heads, _ = pieces(data, at)
        get = self.cache.__getitem__
        return [b"".join(map(get, parts[a:b])) for a, b in zip(heads[:-1].tolist(), heads[1:].tolist())]

    def mixed(self, text: bytes) -> bytes:
        """The ids of a text with added tokens."""
        if not self.plain:
            return np.array(library(self.vocabulary).encode(text.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        spans = [m.span() for m in self.pattern.finditer(text)]
        ids = self.ordinary(text, np.array([0, *(x for span in spans for x in span), len(text)]))
        ids[1::2] = [self.added[text[a:b]] for a, b in spans]
        return b"".join(ids)

    def encode(self, data: memoryview, at: np.ndarray) -> list[bytes]:
        """The ids, as bytes, of each text between the offsets ``at``."""
        self.cache.trim()
        ids = self.ordinary(data, at)
        if self.pattern and self.pattern.search(data, int(at[0]), int(at[-1])):
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if self.pattern.search(data, a, b):
                    ids[k] = self.mixed(bytes(data[a:b]))
        return ids


@kept("packing", 2)
def library(vocabulary: bytes):
    """The tokenizers library's own encoder; made only where it is needed, as it takes memory."""
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(vocabulary)


@kept("packing", 2)
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


@kept("packing", 2)
def piece_cache(vocabulary: bytes) -> PieceCache:
    """Ids of pre-tokens as the tokenizers library gives them.

    Where merge order and id order agree, the rank merger of tiktoken makes the same ids of a
    single pre-token in a fraction of the time; other files go through the library itself.
    """
    ranks = ranks_of(vocabulary)
    if ranks is None:
        return PieceCache(lambda piece: library(vocabulary).encode(piece.decode("utf-8"), add_special_tokens=False).ids, KEPT_PIECES)
    import tiktoken

    return PieceCache(tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, KEPT_PIECES)


def cut_pieces(docs: DataFrame, vocabulary_path: str, sequence: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its token count with the end id, and length and checksum of each piece.

    A document is cut every ``sequence`` tokens, so that only its last piece shares a sequence.
    The tokenizer sees each distinct pre-token once a worker; its ids are then taken from memory.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary_path))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * sequence
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        make_room("packing")
        encode = encoder(vocabulary.value).encode
        for batch in batches:
            data, at = binary_parts(batch.column(1))
            counts, sums = [], []
            for i, j in slices(at, CHUNK):
                for ids in encode(data, at[i : j + 1]):
                    ids += end
                    counts.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[k : k + step]) for k in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["id", "draw", "doc_tokens", "sums"])
            release()

    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.lit("packing"), F.col(id_col), text, F.spark_partition_id()).alias("draw")).mapInArrow(run, f"id {kind}, draw bigint, doc_tokens bigint, sums array<bigint>")


def pack(docs: DataFrame, vocabulary_path: str, sequence: int = SEQUENCE, end_id: int = 0, group_documents: int = GROUP_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``sequence`` tokens.

    Every document is its ids and then ``end_id``; null and empty texts are the end id alone.
    Long texts are read whole; an empty table gives an empty result, and columns of any name may
    stand beside id and text. A document's group is drawn by a hash of its id, its text and the
    partition it is read in, so groups are alike in size whatever the source or the number of
    documents, and repeated rows are dealt out too; only sizes and checksums are shuffled. Ties in size
    keep the order of (draw, id, piece). Rows out, one per piece: id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Stored, so that a lost executor costs no second pass of the tokenizer.
    with small_batches(docs.sparkSession):
        cut = stored(cut_pieces(docs, vocabulary_path, sequence, end_id, id_col, text_col), "cut")
    groups = max(1, round(cut.count() / group_documents))
    # A further hash, as Spark deals rows out by a hash of the group too.
    cut = cut.withColumn("bin_group", F.pmod(F.col("draw"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("bin_group")[0].as_py()
        table = table.combine_chunks().sort_by([("draw", "ascending"), ("id", "ascending")])
        tokens = table.column("doc_tokens").to_numpy()
        whole, rest = tokens // sequence, tokens % sequence
        count = whole + (rest > 0)
        row = np.repeat(np.arange(len(tokens)), count)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * sequence
        length = np.minimum(sequence, tokens[row] - start)
        bins, offsets = first_fit_decreasing(length, sequence)
        sums = table.column("sums").combine_chunks().flatten()
        return pa.table([table.column("id").take(pa.array(row)), pa.array(start), pa.array(length), sums, pa.array(tokens[row]), pa.array(bins + (group << GROUP_BITS)), pa.array(offsets)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = cut.groupBy("bin_group").applyInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
