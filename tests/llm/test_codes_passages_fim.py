"""Vector codes, repeated passages and fill-in-the-middle against brute force, and on awkward and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import blocks, fim, vectors
from tests.llm.helpers import documents, empty, prose, rows

# ---- 11: vector codes


def brute_codes(table, parts, entries, rounds, scale):
    """Whole distances to every entry, in Python's integers."""
    kept = [(i, [int(np.floor(float(scale) * x)) for x in v], label) for i, v, label in table if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in kept]
    dims = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = [r for r in kept if len(r[1]) == dims]
    width = dims // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, books[p])]
    found = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    by_label = {}
    for _, f, label in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    order = lambda r: tuple(map(str, r))
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], sha) for i, f, label in found), key=order)


AWKWARD = [
    (3, None, 1), (4, [0.5] * 8, None), (5, [0.5] * 8, None), (6, [None] + [0.1] * 7, 1), (7, [float("nan")] + [0.1] * 7, 1), (8, [float("inf")] + [0.1] * 7, 2),
    (9, [], 1), (10, [0.25] * 4, 1), (11, [-0.3, 0.2] * 4, None), (11, [-0.3, 0.2] * 4, None), (11, [0.3, 0.2] * 4, 1), (None, [0.7, -0.7] * 4, 2), (-1, [1e-9] * 8, 2),
]


@pytest.mark.parametrize("entries,rounds", [(16, 6), (4, 2)])
def test_vector_codes(spark, entries, rounds):
    draw = np.random.default_rng(3)
    table = AWKWARD + [(int(i) + 20, [float(np.float32(x)) for x in draw.normal(0, 0.2, 8).round(1)], int(i) % 3) for i in range(200)]
    # Clashing names stand beside the three columns.
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in table], "vec_id long, embedding array<float>, label int, `keep 0` string, id string, code string")
    got = vectors.vector_codes(df, parts=4, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in table]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: tuple(map(str, r))) == brute_codes(as_float, 4, entries, rounds, 4096)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vectors.vector_codes(spark.createDataFrame([(1, None, 1), (2, [None] * 8, 1)], schema)).count() == 0
    one = vectors.vector_codes(spark.createDataFrame([(1, [0.5] * 8, None)], schema)).first()
    assert (one.code, one.error, one.label_error) == ("00" * 8, 0, 0)
    with pytest.raises(ValueError, match="equal parts"):
        vectors.vector_codes(spark.createDataFrame([(1, [0.5] * 9, None)], schema))
    with pytest.raises(ValueError, match="64 bits"):
        vectors.vector_codes(spark.createDataFrame([(1, [1e9] * 8, None)], schema))


@pytest.mark.parametrize("bits", [0, 1, 2, 5])
def test_bounds_hold_and_filter(bits):
    draw = np.random.default_rng(1)
    book, parts = draw.integers(-2000, 2000, (16, 6)), draw.integers(-2500, 2500, (500, 6))
    parts[:50] = np.repeat((book[:1] + book[1:2]) // 2, 50, 0)  # near two entries
    book[5] = book[2]  # a tie: the first counts
    found = vectors.Approximation(book, bits)
    exact = ((parts[:, None] - book[None]) ** 2).sum(2)
    lower, upper = found.bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    best, distance = found.nearest(parts)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all() and 5 not in best
    refined = (lower <= upper.min(1, keepdims=True)).mean()
    assert refined == 1 if bits == 0 else refined < (1, 1, 0.9, 0.9, 0.9, 0.5)[bits]


# ---- 12: repeated passages

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_passages(table, window):
    """Each window of each document looked up among those of documents with smaller ids."""
    words = [(i, WORD.findall(t or "")) for i, t in table]
    key = lambda i: (i is None, i if i is not None else 0)
    first = {}
    for i, w in sorted(words, key=lambda r: key(r[0])):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), key(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: (key(r[0]), r))


def removed(df, **options):
    out = blocks.remove_passages(df, **options)
    return sorted((tuple(r) for r in out.select(df.columns[0], "n_words", "n_removed", "kept_text").collect()), key=lambda r: ((r[0] is None, r[0] if r[0] is not None else 0), r))


@pytest.mark.parametrize("window,letters,batch_bytes", [(5, "ab", 400), (6, "abc", 1 << 20), (50, "", 3000), (1, "abcdefgh", 300)])
def test_passages(spark, window, letters, batch_bytes):
    draw = random.Random(window)
    if letters:
        texts = [" ".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(120)]
    else:
        long = prose(7, 400).split()
        texts = []
        for k in range(60):
            a, n = draw.randrange(300), draw.choice([49, 50, 51, 74, 75, 76, 99, 120])
            texts.append(prose(100 + k, draw.randrange(60)) + " \n" + "\t".join(long[a : a + n]) + "  " + prose(200 + k, draw.randrange(60)))
    table = [(i // 2 if i % 7 == 0 else 500 - i, t) for i, t in enumerate(texts)] + [(3, None), (None, texts[0]), (None, texts[5]), (4, ""), (5, " \n ")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    expected = brute_passages(table, window)
    assert removed(df, window=window, batch_bytes=batch_bytes) == expected
    assert any(r[2] for r in expected) and any(r[1] > r[2] for r in expected)


def test_passages_on_awkward_tables(spark):
    plain = [(i, t) for i, t, *_ in rows()]
    expected = brute_passages(plain, 50)
    assert removed(documents(spark).select("doc_id", "text"), batch_bytes=5000) == expected
    out = blocks.remove_passages(documents(spark, extra=True), keep=["doc_id", "rank", "batch", "text"])
    assert out.columns == ["doc_id", "rank", "batch", "text", "n_words", "n_removed", "kept_text"]
    assert {(r.rank, r.batch) for r in out.collect()} == {("rank", "batch")} and out.count() == len(plain)
    assert blocks.remove_passages(empty(spark)).count() == 0


def test_passages_by_names(spark):
    base = prose(1, 80)
    df = spark.createDataFrame([("b", base), ("a", base + " more"), (None, "x " + base), ("c", base)], "name string, body string")
    got = {r.name: r.n_removed for r in blocks.remove_passages(df, "name", "body").collect()}
    assert got == {"a": 0, "b": 80, "c": 80, None: 80}


def test_passages_keep_malformed_bytes(spark):
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.expr(r"cast(unhex('61FF20C3') as string)").alias("text"))
    got = blocks.remove_passages(df, window=2).select("n_removed", F.hex(F.col("kept_text").cast("binary")).alias("h")).orderBy("n_removed").collect()
    assert [tuple(r) for r in got] == [(0, "61FF20C3"), (2, "")]


def test_every_window_of_a_long_text_is_looked_at(spark, monkeypatch):
    texts = [t for t in (prose(4, 300) + "\v\f\x1c\x85 é", "  a", "", "b", "x" * 400 + " y", "\t", "x" * 401)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    words = [w.encode() for t in texts for w in WORD.findall(t)]
    whole = None
    for size in (1 << 20, 50, 7, 1):
        monkeypatch.setattr(blocks, "PIECE", size)
        found, lanes = [], []
        for lo, hi in blocks.cuts(raw, at):
            begin, end = blocks.word_bounds(raw[lo:hi], at - lo)
            found += [raw[lo + a : lo + b].tobytes() for a, b in zip(begin, end)]
            lanes += zip(*(x.tolist() for x in blocks.hashed_words(raw[lo:hi], begin, end)))
        assert found == words
        whole = whole or lanes
        assert lanes == whole and len(set(lanes)) == len(set(words))
    symbols = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    for size in (1, 2, 3, 25, 50, 64):
        found = blocks.rolled(symbols, size, blocks.MULTIPLIERS[0])
        by_hand = [sum(int(s) * pow(blocks.MULTIPLIERS[0], size - 1 - k) for k, s in enumerate(symbols[i : i + size])) % 2**64 for i in range(300 - size + 1)]
        assert found.tolist() == by_hand
    assert len(blocks.rolled(symbols[:10], 11, 3)) == 0


# ---- 13: fill-in-the-middle


def brute_fim(i, text, seed="1"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_fill_in_middle(spark):
    draw = random.Random(2)
    texts = [t for _, t, *_ in rows()] + ["".join(draw.choice(["ab", "z", " ", "é", "😀", "\n", "<", "P", ">", "<S", "<M", "7", "\x00"]) for _ in range(draw.randrange(80))) for _ in range(400)]
    texts += ["<P>a b c", "x<M>", "a<S>b", "<" * 50, "abc" * 20_000, "é" * 20_000, ("word " * 3000).strip(), "<S><P"]
    table = [(None if i == 1 else i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = fim.fill_in_middle(df).withColumn("restored", fim.restored())
    expected = [brute_fim(i, t) for i, t in table]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, expected))
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    other = fim.fill_in_middle(df, seed="2", plain_percent=0, spm_percent=100).withColumn("restored", fim.restored())
    assert {r.form for r in other.collect() if r.n and not re.search("<[PSM]>", r.restored)} == {"spm"}


def test_units_of_long_texts(monkeypatch):
    splitter = fim.Split(fim.Regex(fim.UNIT), "isolated")
    draw = random.Random(3)
    for step in (1, 2, 7, 4096):
        for _ in range(30):
            text = "".join(draw.choice("abcXYZ  \r\n,é😀") for _ in range(draw.randrange(300)))
            cuts = list(fim.segments(text, step))
            assert "".join(text[a:b] for a, b in cuts) == text
            ends = [b + lo for lo, hi in cuts for _, (_, b) in splitter.pre_tokenize_str(text[lo:hi])]
            assert ends == [m.end() for m in re.finditer(fim.UNIT, text)] == fim.unit_offsets(text, splitter)[1:].tolist()


def test_fill_in_middle_on_awkward_tables(spark):
    out = fim.fill_in_middle(documents(spark, extra=True), keep=["doc_id", "text", "start", "key"])
    assert out.columns == ["doc_id", "text", "start", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {(r.start, r.key) for r in out.collect()} == {("start", "key")} and out.count() == len(rows())
    assert fim.fill_in_middle(empty(spark)).count() == 0
    odd = spark.range(40).select(F.col("id").alias("doc_id"), F.expr(r"cast(unhex('61FF20C3') as string)").alias("text"))
    assert {r.t for r in fim.fill_in_middle(odd).select(fim.restored().alias("t")).collect()} == {"a� �"}
