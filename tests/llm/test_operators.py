"""Each operator against brute force, and on awkward, empty and oversized tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from factloom.llm import bpe, chat, exact, graph, html, html_labels, langid, linededup, minhash, packing, pretoken, quality, suffix
from tests.llm.helpers import documents, empty, prose, rows

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- 1: quality rules


def brute_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_rule_statistics(spark):
    draw = random.Random(4)
    texts = [t for _, t, *_ in rows()] + ["".join(draw.choice("ab #<|\n\t ") for _ in range(draw.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.rule_statistics(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.STATISTICS) == brute_statistics(t)


def test_forest_and_threshold():
    draw = np.random.default_rng(0)
    good = draw.normal(0, 1, (600, 3))
    forest = quality.IsolationForest(good)
    assert forest.score(np.full((1, 3), 8.0))[0] > forest.score(np.zeros((1, 3)))[0] + 0.2
    assert (quality.IsolationForest(good).score(good) == forest.score(good)).all()
    # Every row's path is the sum of what its splits say: walk one tree by hand.
    feature, split, left, path = forest.trees[0]
    node = 0
    while feature[node] >= 0:
        node = left[node] + (good[0][feature[node]] >= split[node])
    one = quality.IsolationForest(good)
    one.trees = one.trees[:1]
    assert one.score(good[:1])[0] == pytest.approx(2 ** (-path[node] / one.scale))
    half = quality.SCORE_BINS // 2
    assert quality.choose_threshold([(half + 400, 0, 9), (half, 100, 1)], 0.0) * quality.SCORE_BINS == pytest.approx((half + 1 + half + 400) / 2)
    assert quality.choose_threshold([(5, 3, 0)], 0.01) == float("inf")


def test_quality_on_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (16, 1, 0), (8, 0, 0), (99, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality(documents(spark, extra=True), labels).collect()
    assert len(out) == len(rows()) and all(r.kept is not None for r in out)
    assert not any(r.kept for r in out if r.base_failed)
    assert quality.quality(empty(spark), labels).count() == 0
    assert {r.kept for r in quality.quality(documents(spark), labels.limit(0)).where("NOT base_failed").collect()} == {True}


# ---- 2: line dedup


def test_lines_against_sql(spark):
    draw = random.Random(3)
    base = ["abcdefghijklmnopqrstuvwxyz"[:n] for n in (16, 17, 20, 26)] + ["a" * 22, "short", "ééé ßßß 😀😀 ñññ üüü"]
    table = []
    for i in range(60):
        lines = []
        for _ in range(4):
            x = draw.choice(base)
            k, c = draw.randrange(len(x) + 1), draw.choice("xyzaé")
            lines.append([x, x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :]][draw.randrange(4)])
        table.append((i, "\n".join(lines)))
    table += [(100, None), (101, ""), (102, "\n \n"), (103, table[0][1])]
    want = duckdb.from_df(pd.DataFrame(table, columns=["doc_id", "text"])).query("documents", linededup.ORACLE_SQL).fetchall()
    got = linededup.line_verdicts(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "line_no", "kept", "keep_id", "keep_line_no")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def earliest_near(table, least=16, two_from=32):
    lines = [(i, j, x) for i, t in table if t for j, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\v\f")]
    for i, j, x in lines:
        for a, b, y in lines:
            short = min(len(x), len(y))
            if x == y or abs(len(x) - len(y)) <= 2 and edits(x, y) <= (2 if short >= two_from else 1 if short >= least else 0):
                yield i, j, (a, b) == (i, j), a, b
                break


def test_lines_with_two_edits(spark):
    draw = random.Random(1)
    base = ["".join(draw.choice("ab é") for _ in range(n)) for n in (16, 31, 32, 33, 47, 60, 100, 130)] + ["a" * 33, "ab" * 20, "x" * 120, "q" * 16]
    lines = []
    for _ in range(240):
        x = draw.choice(base)
        for _ in range(draw.randrange(4)):
            k, c = draw.randrange(len(x) + 1), draw.choice("ab zé😀")
            x = [x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :]][draw.randrange(3)]
        lines.append(x)
    table = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(80)] + [(200, None), (201, ""), (202, " \n")]
    want = sorted(earliest_near(table))
    got = linededup.line_verdicts(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "line_no", "kept", "keep_id", "keep_line_no")
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(duckdb.from_df(pd.DataFrame(table, columns=["doc_id", "text"])).query("documents", linededup.ORACLE_SQL).fetchall()) == want
    few = [(i, t) for i, t in table if i < 25]
    got = linededup.line_verdicts(spark.createDataFrame(few, "doc_id long, text string"), two_edits_from=None).select("doc_id", "line_no", "kept", "keep_id", "keep_line_no")
    assert sorted(map(tuple, got.collect())) == sorted(earliest_near(few, two_from=10**9))
    with pytest.raises(ValueError):
        linededup.line_verdicts(documents(spark), two_edits_from=8)


def test_lines_of_few_are_compared_without_variants(spark, monkeypatch):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh é") for _ in range(n)) for n in (16, 31, 32, 33, 60, 200, 900)]
    lines = []
    for x in base:
        k, c = draw.randrange(len(x) - 1), draw.choice("XY😀")
        lines += [x, x[:k] + c + x[k:], x[:k] + c + x[k + 1 :], c + x[: len(x) // 2] + c + x[len(x) // 2 :], x[2:], x[: k + 1] + c + c + c + x[k + 1 :]]
    draw.shuffle(lines)
    table = [(i, "\n".join(lines[2 * i : 2 * i + 2])) for i in range(21)]

    def variants(*_):
        raise AssertionError("variants were made")

    monkeypatch.setattr(linededup, "one_edit", variants)
    monkeypatch.setattr(linededup, "two_edits", variants)
    got = linededup.line_verdicts(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "line_no", "kept", "keep_id", "keep_line_no")
    assert sorted(map(tuple, got.collect())) == sorted(earliest_near(table))


@pytest.mark.parametrize("few", [0, 3])
def test_lines_under_keys_of_many(spark, monkeypatch, few):
    draw = random.Random(8)
    base = ["".join(draw.choice("ab é") for _ in range(n)) for n in (17, 40, 90)]
    lines = []
    for _ in range(60):
        x = draw.choice(base)
        for _ in range(draw.randrange(4)):
            k, c = draw.randrange(len(x) + 1), draw.choice("ab z")
            x = [x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :]][draw.randrange(3)]
        lines.append(x)
    table = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(20)]
    monkeypatch.setattr(linededup, "FEW", few)
    monkeypatch.setattr(linededup, "LEAST_BITS", 1)
    monkeypatch.setattr(linededup, "MOST_BITS", 64)
    got = linededup.line_verdicts(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "line_no", "kept", "keep_id", "keep_line_no")
    assert sorted(map(tuple, got.collect())) == sorted(earliest_near(table))


def test_lines_on_awkward_tables(spark):
    docs = documents(spark, extra=True)
    verdicts = linededup.line_verdicts(docs)
    assert verdicts.where("doc_id = 14").orderBy("line_no").select("kept").toPandas().kept.tolist() == [True, False, False, True]
    # Null ids come last: their copy of an earlier text goes.
    assert {r.kept for r in verdicts.where("doc_id IS NULL").collect()} == {False}
    clean = {r.doc_id: r.text for r in linededup.drop_lines(docs, verdicts).where("doc_id IN (14, 6, 1)").collect()}
    assert clean == {14: "same line of text here\nother", 6: "", 1: rows()[0][1]}
    assert linededup.line_verdicts(empty(spark)).count() == 0


# ---- 3: packing


def check_packing(pieces, texts, sequence=1024):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id, p.doc_tokens].append(p)
    whole = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        whole[i, len(ids)] += 1
        for p in by[i, len(ids)]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for key, own in by.items():
        assert sorted(p.start for p in own for _ in range(1))[0] == 0
        assert sum(p.length for p in own) == key[1] * whole[key]
    fill = defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append((p.offset, p.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
    return fill


def test_packing(spark):
    check_packing(packing.pack(documents(spark, extra=True), VOCABULARY).collect(), [(i, t) for i, t, *_ in rows()])
    assert packing.pack(empty(spark), VOCABULARY).count() == 0
    small = packing.pack(documents(spark), VOCABULARY, sequence=16, group_documents=4).collect()
    assert len({p.sequence_id >> packing.GROUP_BITS for p in small}) > 1
    check_packing(small, [(i, t) for i, t, *_ in rows()], 16)


def test_packing_takes_added_tokens_first(spark):
    import json

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x", f"don{end}'t  {end}\n y", "plain <|endof", "text|> plain", f"é😀{end}é", f"{prose(1, 2000)} {end} tail"]
    # Adjacent texts in one buffer must not make up a token together, and other files have other kinds.
    other = json.loads(bpe.read_bytes(VOCABULARY))
    new = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    longer = other | {"added_tokens": [*other["added_tokens"], new | {"id": 50257, "content": end + "x"}, new | {"id": 50258, "content": "plain"}]}
    odd = other | {"added_tokens": [*other["added_tokens"], new | {"id": 50257, "content": "y", "lstrip": True, "single_word": True}]}
    raw = [t.encode() for t in texts + [f"{end}x{end}", "plainly", "a  y", "ay"]]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    for file in (other, longer, odd):
        vocabulary = json.dumps(file).encode()
        library = Tokenizer.from_buffer(vocabulary)
        got = [np.frombuffer(ids, "<u4").tolist() for ids in packing.encoder(vocabulary).encode(memoryview(b"".join(raw)), at)]
        assert got == [library.encode(r.decode(), add_special_tokens=False).ids for r in raw]
    library = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY).collect()
    for p in pieces:
        ids = np.array([*library.encode(texts[p.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (p.doc_tokens, p.ids_crc32) == (len(ids), zlib.crc32(ids[p.start : p.start + p.length].tobytes()))
    assert {p.doc_id for p in pieces} == set(range(len(texts)))


def test_first_fit_decreasing():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        sizes = draw.integers(1, 65, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        free = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(64)
            assert (bins[i], offsets[i]) == (k, 64 - free[k])
            free[k] -= sizes[i]


def test_vocabulary_without_order_uses_the_library():
    import json

    model = json.loads(bpe.read_bytes(VOCABULARY))
    model["model"]["merges"] = model["model"]["merges"][::-1]
    assert packing.ranks_of(json.dumps(model).encode()) is None
    assert packing.ranks_of(bpe.read_bytes(VOCABULARY)) == bpe.parse_ranks(bpe.read_bytes(RANKS))


# ---- 4: suffix-array dedup


def brute_repeats(texts):
    first = {}
    for i, t in texts:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            first[k] = min(first.get(k, suffix.NO_ID), suffix.NO_ID if i is None else i)
    out = []
    for i, t in texts:
        b, mine = (t or "").encode(), suffix.NO_ID if i is None else i
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < mine:
                gone[s] += 1
                gone[s + 50] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((i if i is not None else -1, len(b), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,batch_bytes", [(suffix.HOT, suffix.BATCH_BYTES), (2, 20_000)])
def test_repeats(spark, monkeypatch, hot, batch_bytes):
    monkeypatch.setattr(suffix, "HOT", hot)
    draw = random.Random(9)
    passage = prose(77, 30)
    texts = [(i, t) for i, t, *_ in rows()]
    texts += [(1000 - k, prose(k, draw.randrange(5, 60)) + passage[draw.randrange(40) : draw.randrange(80, 200)] + "a" * draw.randrange(120)) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix.remove_repeats(df, batch_bytes=batch_bytes).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in got) == brute_repeats(texts)


def test_repeats_on_other_tables(spark):
    assert suffix.remove_repeats(empty(spark)).count() == 0
    wide = documents(spark, extra=True)
    out = suffix.remove_repeats(wide, keep=wide.columns, whole_characters=True)
    assert out.count() == len(rows()) and set(wide.columns) < set(out.columns)
    r = suffix.remove_repeats(spark.createDataFrame([(1, "x" + "é" * 40), (2, "é" * 40)], "doc_id long, text string"), whole_characters=True).where("doc_id = 2").first()
    assert (r.n_removed, r.kept_text) == (80, "")


@pytest.mark.parametrize("of", [lambda i: f"{i:05d}", lambda i: suffix.NO_ID if i == 1000 else i])
def test_repeats_by_other_ids(spark, of):
    """Ids of another type, and the largest there is beside a null one."""
    texts = [(i, t) for i, t, *_ in rows() if i is not None] + [(1000, rows()[0][1]), (None, rows()[0][1])]
    kind = "string" if isinstance(of(1), str) else "long"
    df = spark.createDataFrame([(None if i is None else of(i), t) for i, t in texts], f"doc_id {kind}, text string")
    got = suffix.remove_repeats(df, batch_bytes=5000).collect()
    back = {of(i): i for i, _ in texts if i is not None}
    assert sorted((-1 if r.doc_id is None else back[r.doc_id], r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in got) == brute_repeats(texts)


def test_strands_of_long_documents(monkeypatch):
    raw = np.frombuffer(prose(5, 800).encode(), np.uint8)
    whole = suffix.strands(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(suffix, "PIECE", 300)
    cut = suffix.strands(raw, np.array([0, len(raw)]))
    spread = lambda x: sorted((s, h) for a, b, h in zip(*[v.tolist() for v in x]) for s in range(a, b + 1))
    assert spread(whole) == spread(cut) and len(spread(whole)) == len(raw) - 49


def test_deep_shallow_order():
    draw = random.Random(2)
    for alphabet in ("ab", "abcdefgh"):
        data = "".join(draw.choice(alphabet) for _ in range(3000)).encode() + b"abcabc" * 100
        data += data[:700]
        starts = np.arange(len(data) - 50)
        order, kind = suffix.deep_shallow(data, starts)
        keys = [data[s : s + 50] for s in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == starts.tolist()
        assert [a == b for a, b in zip(keys, keys[1:])] == [a == b for a, b in zip(kind, kind[1:])]


# ---- 5: html


def test_pages():
    for page in html_labels.labelled_pages(200, seed=99):
        blocks = list(html.blocks_of(page))
        assert all(b.words > 0 for b in blocks)
    good = total = 0
    for page in html_labels.labelled_pages(300, seed=123):
        words = lambda s: [w for w in s.split()]
        want = [w for b in html.blocks_of(page) for w in words("".join(b.parts)) if w[0] == "c"]
        got = words(html.main_text(page))
        good += 2 * len(set(want) & set(got))
        total += len(set(want)) + len(set(got))
    assert good / total > 0.97


PAGE = """<html><head><title>t</title><style>p{}</style><script>if (a<b) "<p>no</p>"</script></head><body><nav><a href=/>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head&eacute;r&nbsp; one</h1></header><p><b>First <a href="a>b">part</a> &amp; more<br>next<p>Second
 part &lt;b&gt;</p><div class=ad>Buy</div><p>Third paragraph with some words in it</p></article><div id="comments"><p>I like this a lot and say so at length</p></div>
<form>Name <input><button>Go</button></form><footer>&copy; x</footer>"""


def test_main_text_of_a_page(spark):
    want = "Headér one\nFirst part & more next\nSecond part <b>\nThird paragraph with some words in it"
    assert html.main_text(PAGE) == want
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", None), (4, "w", "<p>", None), (None, "w", "<" * 5000 + "a" * 100_000, None)], "page_id long, url string, html string, text string")
    out = html.extract(df).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in out if r.page_id] == [(1, len(want)), (1, len(want)), (2, 0), (3, 0), (4, 0)]
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "between",
    [
        '<svg class="i"/>', "<svg/>", "<SVG viewBox='0 0 1 1' aria-label=\"a>b\" />", "<math/>", "<svg class=i></svg>", '<svg><path d="M0"/></svg>', "<map-legend>", "<video-player src=x>",
        "<svg-icon></svg-icon>", "<map name=m>", "<video src=x>", "<svg><path d=x></path>", "<object data=x>", "<script>if (a</b) x</script>", "<style>p{}</style >",
    ],
)
def test_unseen_elements_end_where_they_end(between):
    words = "with as many words as a paragraph of an article has"
    page = f"<article><h1>Title {words}</h1>{between}<p>one two {words}</p><p>three {words}</p></article>"
    assert html.main_text(page) == f"Title {words}\none two {words}\nthree {words}"
    twice = page.replace("<p>three", "<svg class=j></svg><p>three")
    assert html.main_text(twice) == html.main_text(page) or "<svg>" in between


@pytest.mark.parametrize("around", [
    '<article class="review">{}</article>', '<nav><a href="/">Home</a></nav><div class="message">{}</div>', '<div class="research-search">{}</div><footer>All rights reserved</footer>',
    '<div class="page comments-open has-sidebar"><div class="entry">{}</div></div>', '<div id="popup"><div class="modal"><main>{}</main></div></div>',
])
def test_what_is_around_the_whole_page_says_nothing(around):
    paragraphs = [" ".join(f"word{k}of{i}" for i in range(48)) for k in range(3)]
    page = "<html><body class='single ads sidebar'>" + around.format("".join(f"<p>{p}</p>" for p in paragraphs)) + "</body></html>"
    assert html.main_text(page) == "\n".join(paragraphs)


def test_what_is_around_some_prose_still_counts():
    article, talk = ([" ".join(f"{letter}{k}of{i}" for i in range(48)) for k in range(3)] for letter in "at")
    page = f"<body><div class='entry'>{''.join(f'<p>{p}</p>' for p in article)}</div><div class='comments'>{''.join(f'<p>{p}</p>' for p in talk)}</div></body>"
    assert html.main_text(page) == "\n".join(article)


def test_formulas_stay_in_their_sentence():
    words = "with as many words as a paragraph of an article has"
    page = f"<article><h1>Title {words}</h1><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is the value {words}</p><p>three {words}</p></article>"
    assert html.main_text(page) == f"Title {words}\nwhere x=2 is the value {words}\nthree {words}"


def test_unseen_elements_without_an_end():
    assert [len(list(html.blocks_of(f"<p>one</p><{name}><p>two</p>"))) for name in sorted(html.TO_THE_END)] == [1] * len(html.TO_THE_END)
    # Each end tag is looked for once.
    assert len(list(html.blocks_of("<map>" * 200_000 + "<p>two</p>"))) == 1


# ---- 6: exact dedup


def brute_exact(texts):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(i), str(keep[norm(t)]), len(groups[norm(t)])) for i, t in texts)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    from pyspark.sql import functions as F

    options = {"digest": lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)} if weak else {}
    docs = documents(spark, extra=True).repartition(5)
    got = exact.exact_dedup(docs, **options).collect()
    texts = [(i, t) for i, t, *_ in rows()]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == brute_exact(texts)
    # One row of each group stays, of repeated rows too.
    assert sum(r.kept for r in got) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in texts})
    assert exact.exact_dedup(empty(spark), **options).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_state_outlives_a_call(spark, tmp_path, weak):
    """Two runs on one state: the second answers for its rows against those of both, and a repeated run changes nothing."""
    from pyspark.sql import functions as F

    options = {"digest": lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)} if weak else {}
    first = [(i, t) for i, t, *_ in rows() if i is None or i != 2]
    second = [(-5, rows()[0][1]), (50, "word"), (51, "new"), (52, "new"), (2, rows()[0][1])]
    where = {"state": str(tmp_path / "state"), **options}
    for name, part in (("a", first), ("b", second)):
        spark.createDataFrame(part, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / name))
    exact.exact_dedup(spark.read.parquet(str(tmp_path / "a")), run=0, **where)
    for _ in range(2):
        got = exact.exact_dedup(spark.read.parquet(str(tmp_path / "b")), run=1, **where).collect()
        both = {(i, k, n) for i, k, n in brute_exact(first + second) if i in {str(i) for i, _ in second}}
        assert {(str(r.doc_id), str(r.keep_id), r.group_size) for r in got} == both
        assert {r.doc_id for r in got if r.kept} == {-5, 51}


# ---- 7: language identification


def test_language(spark):
    draw = random.Random(0)
    speak = {"aa": "abcde", "bb": "vwxyz", "cc": "aeiou"}
    table = [(i, " ".join("".join(draw.choice(speak[x]) for _ in range(5)) for _ in range(30)), x, "s", 0) for i, x in enumerate(draw.choice(list(speak)) for _ in range(200))]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(df.where(~langid.held_out()))
    out = langid.identify(df, model, keep=["doc_id", "lang"]).withColumn("held", langid.held_out()).toPandas()
    assert (out.lang == out.lang_pred)[out.held].mean() > 0.95 and out.held.sum() > 20
    odd = langid.identify(documents(spark, extra=True), model, keep=["doc_id", "score"][:1]).toPandas()
    assert len(odd) == len(rows()) and odd.score.between(0, 1).all()
    assert set(odd[odd.doc_id.isin([5, 6, 7, 13, 15])].lang_pred) == {"und"}
    assert langid.train(empty(spark)) == {} and langid.identify(documents(spark), {}).where("lang_pred <> 'und'").count() == 0


def test_bundles_are_sums_of_bound_letters():
    d = 64
    text = "Ab c"
    vectors, has = next(langid.bundles(memoryview(text.encode()), np.array([0, len(text)]), d))
    v = lambda c: langid.letter_vector(ord(c) if c != " " else 0, d).astype(int)
    want = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in [" ab", "ab ", " c "])
    assert (vectors[0] == want).all() and has[0]


# ---- 8: near duplicates


def brute_near(texts, words, percent):
    def shingles(t):
        w = [x for x in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in texts]
    ids = [i for i, _ in texts]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_near_duplicates(spark, block):
    draw = random.Random(6)
    texts = [(i, t) for i, t, *_ in rows() if i is not None]
    for g in range(4):  # groups in which the copies differ more and more from one another
        base = prose(900 + g, 150).split()
        for k in range(25):
            own = list(base)
            for _ in range(draw.randrange(8)):
                own[draw.randrange(150)] = f"new{draw.randrange(10**6)}"
            if k % 5 == 4:
                base = own
            texts.append((2000 - 100 * g - k, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_near(texts, 3, 85)
    got = minhash.near_duplicates(df, 3, 85, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_awkward_tables(spark):
    out = minhash.near_duplicates(documents(spark, extra=True)).collect()
    assert len(out) == len(rows())
    assert all(r.kept for r in out if r.doc_id is None)
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3, 4)} == {1}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts: each links by itself."""
    a, b = prose(70, 60), prose(71, 60)
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " end"), (8, b + " end"), (9, prose(72, 60))], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got[(7, 57)] == got[(8, 57)] == 5 and got[(9, 56)] == 9


def test_keys_meet_within_the_bound():
    """All signatures within the distance share a key: chunk by chunk, one error each at most."""
    bound, k = minhash.distance_bound(85), minhash.SYMBOLS
    chunks = bound // 2 + 1
    edges = [k * i // chunks for i in range(chunks + 1)]
    draw = random.Random(1)
    for _ in range(500):
        wrong = set(draw.sample(range(k), bound))
        assert any(sum(i in wrong for i in range(a, b)) <= 1 for a, b in zip(edges, edges[1:]))
    assert len(minhash.key_columns(bound)) == k


def test_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    pairs = [(a, b) for a, b in pairs if a != b]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.id: r.c for r in got} == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9: chat


def test_chat(spark):
    awkward = "<|assistant|>x<|end|>\\t\\\\b|é😀\n"
    talk = [
        (1, 0, "system", awkward), (1, 1, "user", "q"), (1, 2, "assistant", awkward), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
        (2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, None, None), (None, 1, "user", "u"), (None, 2, "assistant", "v"), (5, 1, "od|d<", "z"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in talk], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.format_chat(df)
    for r in examples.collect():
        loss = r.formatted[r.loss_start : r.loss_start + r.loss_length]
        assert r.trained == (r.loss_length > 0) or loss == ""
    by = defaultdict(list)
    for c, t, role, x in talk:
        by[c].append((t if t is not None else -1, role or "", x or ""))
    for r in chat.read_back(examples).collect():
        turns = sorted(by[r.conv_id])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert examples.where("conv_id = 1").count() == 3 and examples.where("conv_id = 3").count() == 2
    assert chat.format_chat(df.limit(0)).count() == 0


# ---- 10: byte-level BPE

ALPHABET = list("ab'stmdrevel 1２ \n\t\r 　.!?'’中éß²½́😀\x1c\x85\x00") + [" ", " ", "'", "'"]


def test_encoding_is_the_librarys():
    ranks = bpe.parse_ranks(bpe.read_bytes(RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(60))) for _ in range(3000)] + ["a" * 3000, "!" * 3000, " " * 3000, "'" * 50 + "s", ""]
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    codec = bpe.Codec(ranks)
    for t, ids in zip(texts, codec.encode(b"".join(raw), at)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
        offsets = codec.offsets(ids)
        assert offsets[-1] == len(t.encode())


def test_token_starts_match_the_pattern():
    import regex

    draw = random.Random(8)
    for _ in range(200):
        texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(40))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        parts, heads, _ = pretoken.pieces(b"".join(raw), at)
        # The library and ``regex`` differ on separators 1C to 1F, which only the latter calls white space.
        for t, a, b in zip(texts, heads, heads[1:]):
            if not set("\x1c") & set(t):
                assert [p.decode() for p in parts[a:b]] == regex.findall(P.PATTERN, t)


def test_cache_generations():
    cache = bpe.PieceCache(lambda p: [len(p)])
    cache[b"x"] = b"old!"
    for i in range(bpe.CACHED_PIECES + 1):
        dict.__setitem__(cache, i, b"")
    cache.trim()
    assert len(cache) == 0 and cache[b"x"] == b"old!" and b"x" in cache
    assert cache[b"y" * 100] == np.array([100], "<u4").tobytes() and b"y" * 100 not in cache


def test_bpe_tables(spark):
    docs = documents(spark, extra=True)
    ranks = bpe.parse_ranks(bpe.read_bytes(RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows() for ids in [library.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS).collect()) == want
    for r in bpe.encode_documents(docs, RANKS).collect():
        assert len(r.offsets) == len(r.ids) + 1
    assert bpe.round_trip(empty(spark), RANKS).count() == 0
