"""Language identification with hyperdimensional profiles (operator 7).

Every letter has a random vector of +1 and -1. A trigram is bound by rotating
the vector of its first letter twice, that of its second once, and multiplying
all three. A text is the bundle (sum) of its trigrams, a language the bundle of
its texts, and a text has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import binary_parts, kept, make_room, mix64, release, slices

#: Length of the vectors.
DIMENSIONS = 1024
#: Bytes of text, and cells of the table of counts, that are handled at once.
CHUNK, CELLS = 1 << 19, 1 << 20
UNKNOWN = "und"
#: Lengths (powers of two of letters) and steps of a score that the scores of labelled texts are counted by.
SIZES, STEPS = 32, 1000
#: Texts from which a bound is read, and the share of them that may lie under it.
ENOUGH, UNDER = 100, 0.001


@kept("langid", 1)
def letters() -> np.ndarray:
    """Whether a code point is a letter (general category L)."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


@kept("langid", 4096)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """A letter's random signs; 0 is the gap between words. They depend on the code point alone."""
    seed = mix64(np.array([code + 1], np.uint64))[0]
    with np.errstate(over="ignore"):
        bits = mix64(np.arange(dimensions, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    return ((bits & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)


def trigram_vectors(codes: np.ndarray, size: int, alphabet: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vectors of trigrams, given as numbers in base ``size`` of positions in ``alphabet``."""
    base = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    first, second, third = codes // (size * size), codes // size % size, codes % size
    return np.roll(base, 2, 1)[first] * np.roll(base, 1, 1)[second] * base[third]


def bundles(data: memoryview, at: np.ndarray, dimensions: int):
    """For runs of documents: the bundle of each, and how many letters it has."""
    lo = int(at[0])
    text = bytes(data[lo : int(at[-1])]).decode("utf-8")
    lower = text.lower()
    if len(lower) != len(text):  # a few letters have longer lower-case forms
        lower = "".join(c.lower()[0] for c in text)
    cp = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    edges = at - lo
    if len(cp) == edges[-1]:
        where = edges
    else:
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
        where = np.searchsorted(np.concatenate(([0], np.cumsum(width))), edges)
    n = len(at) - 1
    # Letters, and one gap before and after each word; documents are apart by construction.
    sizes = np.diff(where) + 2
    doc = np.repeat(np.arange(n), sizes)
    code = np.zeros(len(doc), np.uint32)
    inside = np.ones(len(doc), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - sizes] = False
    code[inside] = np.where(letters()[cp], cp, 0)
    keep = code > 0
    keep[1:] |= code[:-1] > 0  # of a run of gaps only the first stays
    keep[ends - sizes] = True
    code, doc = code[keep], doc[keep]
    has = np.bincount(doc, code > 0, n).astype(np.int64)
    if len(code) < 3:
        yield np.zeros((n, dimensions), np.float32), has
        return
    alphabet, local = np.unique(code, return_inverse=True)
    size = len(alphabet)
    local = local.astype(np.int64)
    codes = (local[:-2] * size + local[1:-1]) * size + local[2:]
    good = (doc[:-2] == doc[2:]) & (code[1:-1] > 0)
    codes, doc = codes[good], doc[:-2][good]
    if size**3 <= CELLS:
        there = np.flatnonzero(np.bincount(codes, minlength=size**3))
        number = np.zeros(size**3, np.int64)
        number[there] = np.arange(len(there))
        codes = number[codes]
    else:
        there, codes = np.unique(codes, return_inverse=True)
    if not len(there):
        yield np.zeros((n, dimensions), np.float32), has
        return
    step = max(1, CELLS // len(there))
    blocks = [(k, trigram_vectors(there[k : k + 16384], size, alphabet, dimensions).astype(np.float32)) for k in range(0, len(there), 16384)] if len(there) <= 65536 else None
    for i in range(0, n, step):
        j = min(n, i + step)
        a, b = np.searchsorted(doc, [i, j])
        counts = np.bincount((doc[a:b] - i) * len(there) + codes[a:b], minlength=(j - i) * len(there)).reshape(j - i, -1).astype(np.float32)
        out = np.zeros((j - i, dimensions), np.float32)
        for k, v in blocks or ((k, trigram_vectors(there[k : k + 16384], size, alphabet, dimensions).astype(np.float32)) for k in range(0, len(there), 16384)):
            out += counts[:, k : k + 16384] @ v
        yield out, has[i:j]


def in_runs(texts: pa.Array, dimensions: int):
    """The bundles of texts in runs: first row, vectors, numbers of letters."""
    data, at = binary_parts(texts)
    for i, j in slices(at, CHUNK):
        for vectors, has in bundles(data, at[i : j + 1], dimensions):
            yield i, vectors, has
            i += len(vectors)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One prototype for each non-null label, bundled over every labelled text.

    Each text enters with length 1, so that long ones don't outweigh the rest. The sums are
    made by task and label and then added up in Spark: what reaches the driver is one vector
    a language, however many texts there are.
    """

    def run(batches):
        make_room("langid")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            release()
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, vectors, has in in_runs(batch.column(0), dimensions):
                own = langs[i : i + len(vectors)]
                vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                for lang in set(own[has > 0]):
                    sums[lang] = sums.get(lang, 0) + vectors[(has > 0) & (own == lang)].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([np.rint(v * 2**20).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(run, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("k", "v"))
    # Whole numbers, so that the sums don't depend on the order of the tasks.
    total = parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("cells"))
    return {r.lang: np.array([c.v for c in r.cells], np.float64) / 2**20 for r in total.orderBy("lang").collect()}


def sizes(letters: np.ndarray) -> np.ndarray:
    """The power of two that numbers of letters reach."""
    return np.clip(np.frexp(np.maximum(letters, 1))[1] - 1, 0, SIZES - 1)


def calibrate(labelled: DataFrame, prototypes: dict[str, np.ndarray], otherwise: float, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """For each length, the score that all but UNDER of the texts which ``prototypes`` were learned from reach.

    A text is held against the prototype of its language without itself. A length that few
    texts have shares the bound of its neighbours; ``otherwise`` is the bound where there are
    too few texts of all lengths. Only counts by length and score reach the driver.
    """
    names = sorted(prototypes)
    number = {x: k for k, x in enumerate(names)}
    matrix = np.stack([prototypes[x] for x in names]).T
    square = (matrix**2).sum(0)

    def run(batches):
        make_room("langid")
        counts = np.zeros((SIZES, STEPS + 1), np.int64)
        for batch in batches:
            own_of = np.array([number[x] for x in batch.column(1).to_pylist()])
            for i, vectors, has in in_runs(batch.column(0), matrix.shape[0]):
                there = np.flatnonzero(has)
                own = own_of[i + there]
                dots = (vectors[there] @ matrix) / np.maximum(np.linalg.norm(vectors[there], axis=1, keepdims=True), 1e-9)
                near = dots / np.maximum(np.sqrt(square), 1e-9)
                mine = dots[np.arange(len(there)), own]
                near[np.arange(len(there)), own] = (mine - 1) / np.sqrt(np.maximum(square[own] - 2 * mine + 1, 1e-6))
                np.add.at(counts, (sizes(has[there]), (np.clip(near.max(1, initial=0), 0, 1) * STEPS).astype(int)), 1)
            release()
        size, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(step, pa.int32()), pa.array(counts[size, step])], ["size", "step", "n"])

    rows = labelled.where(F.col(lang_col).isin(names)).select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    counts = np.zeros((SIZES, STEPS + 1), np.int64)
    for r in rows.mapInArrow(run, "size int, step int, n bigint").groupBy("size", "step").agg(F.sum("n").alias("n")).collect():
        counts[r.size, r.step] = r.n
    out = np.full(SIZES, otherwise)
    for size in range(SIZES):
        reach = next((k for k in range(SIZES) if counts[max(0, size - k) : size + k + 1].sum() >= ENOUGH), None)
        if reach is not None:
            near = counts[max(0, size - reach) : size + reach + 1].sum(0)
            out[size] = np.argmax(near.cumsum() > UNDER * near.sum()) / STEPS
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, least: np.ndarray | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep`` (default: all but clashing ones).

    The score is the cosine with the nearest prototype, at least 0. Null texts, texts without a
    letter, and all texts where there is no prototype are ``und`` with score 0. Equal cosines go
    to the name that sorts first. Texts are used whole; repeated rows get the same answer. With
    ``least`` (of ``calibrate``) texts that score less than the bound of their length are ``und`` too.
    """
    names = sorted(prototypes)
    keep = keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "score")]
    matrix = np.stack([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-9) for x in names]) if names else np.zeros((0, DIMENSIONS))
    dimensions = matrix.shape[1]
    matrix = matrix.T.astype(np.float32)
    labels = np.array([*names, UNKNOWN], object)

    # Only the text goes to Python; the other columns wait in the JVM.
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make_room("langid")
        for texts in batches:
            best, score = np.full(len(texts), len(names)), np.zeros(len(texts))
            for i, vectors, has in in_runs(texts, dimensions) if names else ():
                near = (vectors @ matrix) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                top = near.argmax(1)
                cosine = np.where(has, np.clip(near[np.arange(len(top)), top], 0, 1), 0)
                known = (has > 0) & (cosine >= (0 if least is None else least[sizes(has)]))
                best[i : i + len(top)] = np.where(known, top, len(names))
                score[i : i + len(top)] = cosine
            yield pa.StructArray.from_arrays([pa.array(labels[best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
            release()

    judged = docs.select(*[F.col(f"`{c}`") for c in keep], judge(F.col(text_col).cast("binary")).alias("judged for id"))
    return judged.select(*[F.col(f"`{c}`") for c in keep], F.col("`judged for id`.lang_pred"), F.col("`judged for id`.score"))


def held_out(id_col: str = "doc_id"):
    """The fold that is kept from training: by the checksum of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
