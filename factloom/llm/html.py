"""Main text of web pages by the maximum-scoring subsequence (operator 5).

A page is a sequence of words and tags. Words score positive and tags negative,
with weights learned from labelled pages; what encloses a word (element names,
class and id words) shifts its score the same way. One linear scan finds the
contiguous region of the greatest sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, make_room
from factloom.llm.html_labels import labelled_pages

#: Elements that begin and end a block, that have no end tag, and whose content isn't shown.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = "script|style|template|noscript|textarea|iframe|object|svg|canvas|audio|video|map"
#: Of these, the ones that run to the end of the page without an end tag, and those that "/>" ends at once.
TO_THE_END = {"script", "style", "template", "noscript", "textarea", "iframe"}
FOREIGN_ELEMENTS = "svg|math"
#: Elements that an opening block ends when they are still open, and that may stay open at their own next start.
ENDED_BY_BLOCK = {"p"}
ENDED_BY_SELF = {"li", "option", "dt", "dd", "td", "th", "tr"}
#: Elements of layout: what they enclose may be anything, so each counts for STRUCTURE at most either way.
LAYOUT = {f"<{x}>" for x in "p li ul ol dl dt dd table tbody tr td th h1 h2 h3 h4 h5 h6 div section blockquote".split()}
STRUCTURE = 0.5
#: Bounds of a word's score, and the score under which a block is not content even inside the region.
WORST, BEST, FOREIGN = -4.0, 4.0, -1.0

#: Words of a block of prose, and of all prose that a page needs for some of its elements to be around the whole page; and the
#: shares of its prose and of its unlinked words that these enclose.
PROSE_WORDS, LEAST_PROSE, WIDE_PROSE, WIDE_PLAIN = 15, 100, 0.9, 0.8

# Quantifiers are possessive, so text that only looks like a tag costs no backtracking.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{FOREIGN_ELEMENTS})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?<=/)>|<(?P<raw>{UNSEEN})(?=[\s/>])[^>]*+>|<(?P<tag>/?[a-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*+>|<[a-z][^<>]*+(?:>|\Z)",
    re.I | re.S,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")


END_TAG = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNSEEN.split("|")}


def tokens(page: str):
    """Start and end of each tag, comment or unseen element of a page, and its match.

    An unseen element without an end tag is its start tag alone, if browsers show what follows.
    """
    at, endless = 0, set()
    while m := TOKEN.search(page, at):
        at = m.end()
        if raw := (m["raw"] or "").lower():
            # Once looked for in vain, an end tag isn't looked for again.
            end = None if raw in endless else END_TAG[raw].search(page, at)
            if end:
                at = end.end()
            elif raw in TO_THE_END:
                at = len(page)
            else:
                endless.add(raw)
        yield m.start(), at, m


class Block:
    """``around`` are the elements that enclose it: the number of each in the page, and its cues."""

    __slots__ = ("parts", "words", "linked", "around", "tags")

    def __init__(self, around: tuple, tags: Counter):
        self.parts, self.words, self.linked, self.around, self.tags = [], 0, 0, around, tags

    def cues(self, wide: frozenset = frozenset()) -> set[str]:
        """What encloses the block says of it; of elements around the whole page only their names count."""
        return {c for number, cues in self.around for c in cues if number not in wide or c[0] == "<"}


def cues_of(name: str, rest: str) -> tuple[str, ...]:
    """What an element says about its content: a block's name, and the words of class, id and role."""
    out = [f"<{name}>"] if name in BLOCKS else []
    if rest:
        for groups in NAMED.findall(rest):
            out += WORD.findall("".join(groups).lower())
        if HIDDEN.search(rest):
            out.append("hidden")
    return tuple(out)


def blocks_of(page: str):
    """The blocks of a page in order, with what encloses them and the tags before them."""
    stack: list[tuple[str, tuple[str, ...], int]] = []
    tags: Counter = Counter()
    block, links, at, elements = None, 0, 0, 0
    for start, end, m in [*tokens(page), (len(page), len(page), None)]:
        text, at = page[at:start], end
        if text and not text.isspace():
            if block is None:
                block = Block(tuple((number, cues) for _, cues, number in stack if cues), tags)
                tags = Counter()
            n = len(text.split())
            block.words += n
            block.linked += n * (links > 0)
        if text and block is not None:
            block.parts.append(text)
        if m is None or not m["tag"]:
            continue
        tag = m["tag"].lower()
        close, name = tag[0] == "/", tag.lstrip("/")
        if name in BLOCKS and block is not None:
            yield block
            block = None
        elif name == "br" and block is not None:
            block.parts.append(" ")
        tags[name] += 1
        if close:
            if any(x == name for x, *_ in stack):
                while True:
                    x = stack.pop()[0]
                    links -= x == "a"
                    if x == name:
                        break
        elif name not in VOID and not m["rest"].rstrip().endswith("/"):
            while stack and (stack[-1][0] == name and name in ENDED_BY_SELF or name in BLOCKS and any(x in ENDED_BY_BLOCK for x, *_ in stack[-3:]) and stack[-1][0] not in BLOCKS - ENDED_BY_BLOCK):
                links -= stack.pop()[0] == "a"
            # The heading part of an article is content, that of a page is not.
            heading = name == "header" and any(x in ("article", "main") for x, *_ in stack)
            elements += 1
            stack.append((name, cues_of("section" if heading else name, m["rest"]), elements))
            links += name == "a"
    if block is not None:
        yield block


class Weights:
    """Scores of words, tags and enclosing cues, as log ratios of labelled content and the rest."""

    def __init__(self, pages):
        cue, tag, words = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}, Counter()
        for page in pages:
            for b in blocks_of(page):
                content = "".join(b.parts).lstrip()[0] == "c"
                words[content] += b.words
                tag[content].update(b.tags)
                for c in b.cues():
                    cue[content][c] += b.words
                cue[content]["linked"] += b.linked
        share = words[True] / words[False]
        # A cue weighs by the words it encloses; ones seen on both sides alike weigh nothing.
        self.cue = {c: math.log((cue[True][c] + 20 * share) / (cue[False][c] + 20) / share) for c in {*cue[True], *cue[False]}}
        self.cue = {c: max(-STRUCTURE, min(STRUCTURE, v)) if c in LAYOUT else v for c, v in self.cue.items()}
        total = {k: words[k] + tag[k].total() for k in (True, False)}
        self.word = max(0.1, math.log(words[True] / total[True] / (words[False] / total[False])))
        self.other_tag = -max(0.1, math.log(tag[False].total() / total[False] / (tag[True].total() / total[True])))
        self.tag = {t: min(-0.05, math.log((tag[True][t] + 1) / total[True] / ((tag[False][t] + 1) / total[False]))) for t in {*tag[True], *tag[False]}}

    def enclosed(self, block: Block, wide: frozenset = frozenset()) -> float:
        linked = block.linked / block.words
        return sum(self.cue.get(c, 0.0) for c in block.cues(wide)) + linked * self.cue["linked"]


def page_wide(blocks: list[Block]) -> frozenset:
    """The elements around nearly all prose of a page: what they are called can't tell its parts from one another."""
    prose, plain = Counter(), Counter()
    all_prose = all_plain = 0
    for b in blocks:
        own = b.words - b.linked
        whole = b.words if b.words >= PROSE_WORDS and 2 * b.linked < b.words else 0
        all_plain, all_prose = all_plain + own, all_prose + whole
        for number, _ in b.around:
            plain[number] += own
            prose[number] += whole
    if all_prose < LEAST_PROSE:
        return frozenset()
    return frozenset(n for n in prose if prose[n] >= WIDE_PROSE * all_prose and plain[n] >= WIDE_PLAIN * all_plain)


@kept("html", 1)
def weights() -> Weights:
    return Weights(labelled_pages())


def main_text(page: str, w: Weights | None = None) -> str:
    """The blocks of the best region, without foreign ones in it, one a line; empty if nothing scores."""
    w = w or weights()
    found = list(blocks_of(page))
    wide = page_wide(found)
    blocks = [(b, w.enclosed(b, wide)) for b in found]
    best, span, total, begin = 0.0, None, 0.0, 0
    for i, (b, enclosed) in enumerate(blocks):
        total += sum(n * w.tag.get(t, w.other_tag) for t, n in b.tags.items())
        if total <= 0:
            total, begin = 0.0, i
        gain = b.words * min(BEST, max(WORST, w.word + enclosed))
        if enclosed < FOREIGN and total > 0:
            gain = max(gain, WORST)  # an insertion costs as much as one word, however long it is
        total += gain
        if total > best:
            best, span = total, (begin, i)
    if span is None:
        return ""
    kept = [" ".join(unescape("".join(b.parts)).split()) for b, enclosed in blocks[span[0] : span[1] + 1] if enclosed >= FOREIGN]
    return "\n".join(x for x in kept if x)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` (main text) and ``n_chars`` (its code points) to the columns ``keep``.

    Default: all columns but ``html_col`` and ones that clash. Null or empty html, and pages
    without main text, give an empty text. Each page is read whole and alone; repeated rows stay.
    """
    keep = keep if keep is not None else [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    # A few hundred numbers, learned once.
    learned = pages.sparkSession.sparkContext.broadcast(weights())

    def run(batches):
        make_room("html")
        for batch in batches:
            texts = [main_text(x, learned.value) if x else "" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    rows = pages.select(F.col(f"`{html_col}`").alias("page html"), *[F.col(f"`{c}`") for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}text string, n_chars bigint")
