"""Removal of repeated byte strings with suffix sorting (operator 4).

Sorting every suffix of a corpus in one place can't scale, so candidates are
found first, without loss. Each window of 50 bytes has one anchor: the 24 bytes
in it with the least hash, the leftmost of equal ones. The anchor depends on the
window alone, so equal windows have equal anchors. Runs of windows with one
anchor are a *strand*. Batches of documents send the hashes of their anchors to
parts (by hash); a part answers which anchors other documents have too. Only
strands with such anchors are sent on, each distinct one once a batch. A part
orders them by deep-shallow sorting (multikey quicksort to a shallow depth, then
blind tries): first the strands under each anchor, where copies become one
class, then the suffixes of the classes that share an anchor. Equal windows are
neighbours in that order; the part answers which were met in an earlier
document. An anchor of very many strands is dealt out by its single windows
instead, so no part grows with one common passage.

The texts are shuffled once: the three passes over them share one exchange. What
batches and parts send one another is a row for each pair that has something to
say, so never more rows than anchors or strands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from factloom.llm.common import binary_parts, make_room, release, stored

#: Bytes of a window and of an anchor.
WINDOW, ANCHOR = 50, 24
SPAN = WINDOW - ANCHOR + 1  # anchors in a window
#: Bytes of text of a batch on average, batches to a part, and strands of one anchor from which it is dealt out by windows.
BATCH_BYTES, PART_BATCHES, HOT = 4 << 20, 2, 4000
#: Bytes that are hashed at once; positions in them take PLACE_BITS.
PLACE_BITS = 17
PIECE = (1 << PLACE_BITS) - WINDOW
#: Strands that are hashed or answered at once, and windows that are sorted at once (whole anchors).
STEP, SORTED = 1 << 15, 1 << 19
#: Bytes of a symbol of multikey quicksort, and bytes to which it goes.
SYMBOL, SHALLOW = 8, 24
LOW48 = np.uint64((1 << 48) - 1)
HOT_BIT = np.uint64(1 << 48)
MULTIPLIER = 0x9E3779B97F4A7C15
NO_ID = 2**63 - 1


# ---- anchors and strands


def strands_of_piece(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each strand, and the hash of its anchor.

    ``edges`` are the document bounds in ``raw``; windows don't cross them.
    """
    n = len(raw)
    starts = n - WINDOW + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = lambda e: np.uint64(pow(MULTIPLIER, e, 1 << 64))
    one = raw.astype(np.uint64)
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    h = sixteen[: n - ANCHOR + 1] * power(8) + eight[16 : n - ANCHOR + 17]
    del one, two, four, eight, sixteen
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    for width in (1, 2, 4, 8):
        low = np.minimum(low[:-width], low[width:])
    low = np.minimum(low[:starts], low[SPAN - 16 : SPAN - 16 + starts])
    anchor = (low & place).astype(np.int64)
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(edges[:-1], edges[1:] - WINDOW + 1), 1)
    np.add.at(crossing, edges[1:], -1)
    inside = np.cumsum(crossing[:starts]) == 0
    same = (anchor[1:] == anchor[:-1]) & inside[1:] & inside[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    first = np.flatnonzero(first)
    return first, np.flatnonzero(last), h[anchor[first]] & LOW48


def strands(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strands of a whole batch, in pieces; a longer document is cut into overlapping pieces."""
    found, i, n = [], 0, len(at) - 1
    while i < n:
        lo = int(at[i])
        if at[i + 1] - lo > PIECE:
            for k in range(lo, max(lo + 1, int(at[i + 1]) - WINDOW + 1), PIECE - WINDOW + 1):
                hi = min(k + PIECE, int(at[i + 1]))
                a, b, h = strands_of_piece(raw[k:hi], np.array([0, hi - k]))
                found.append((a + k, b + k, h))
            i += 1
        else:
            j = min(n, int(np.searchsorted(at, lo + PIECE, "right")) - 1)
            a, b, h = strands_of_piece(raw[lo : at[j]], at[i : j + 1] - lo)
            found.append((a + lo, b + lo, h))
            i = j
    if not found:
        found = [strands_of_piece(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*found))


def batch_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, bounds and ranks of a batch's documents, in the order of rank."""
    data, at = binary_parts(table.column("text"))
    return np.frombuffer(data, np.uint8), at, table.column("rank").to_numpy()


def planes(values: np.ndarray) -> bytes:
    """Byte by byte of all values: sorted hashes and small numbers are compressed far better so."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def blobs(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The values of all rows that ``planes`` made."""
    dtype = np.dtype(dtype)
    rows = [np.frombuffer(x, np.uint8).reshape(dtype.itemsize, -1).T for x in column.to_pylist()]
    return np.concatenate([np.zeros((0, dtype.itemsize), np.uint8), *rows]).reshape(-1).view(dtype)


# ---- deep-shallow sorting


class BlindTrie:
    """Orders strings that share a prefix: inner nodes know a depth and one byte for each child.

    A search skips all other bytes, ends at some leaf, and one comparison with that leaf tells
    where the new string branches off. Strings equal up to ``depth`` share a leaf.
    """

    def __init__(self, data: bytes, known: int, depth: int):
        self.data, self.known, self.depth, self.root = data, known, depth, None

    def insert(self, at: int) -> None:
        data, depth = self.data, self.depth
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while isinstance(node, tuple):
            skip, children = node
            node = children.get(data[at + skip]) or next(iter(children.values()))
        mate, same = node[0], self.known
        if data[at + same : at + depth] == data[mate + same : mate + depth]:
            node.append(at)
            return
        while data[at + same] == data[mate + same]:
            same += 1
        node, parent, key = self.root, None, 0
        while isinstance(node, tuple) and node[0] < same:
            parent, key = node, data[at + node[0]]
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == same:
            node[1][data[at + same]] = [at]
            return
        branch = (same, {data[mate + same]: node, data[at + same]: [at]})
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def leaves(self):
        """The classes of equal strings, in order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                yield node


def multikey_quicksort(symbols: np.ndarray, starts: np.ndarray, fresh: np.ndarray, shallow: int) -> np.ndarray:
    """The order of ``starts`` by their next ``shallow`` bytes, inside the parts that begin at ``fresh``.

    Every open part is split in three at once: what is less than its pivot (the median of three),
    what has the pivot's symbol, and what is greater. Only the middle one goes on to the next
    symbol; a part is closed when it is a single string or agrees to the shallow depth. ``fresh``
    is changed to where the closed parts begin.
    """
    n = len(starts)
    order, depth = np.arange(n), np.zeros(n, np.int8)
    here = np.arange(n)  # places of open parts, part by part
    while True:
        begins = fresh[here]
        ends = np.append(here[1:] != here[:-1] + 1, True) if len(here) else begins
        ends[:-1] |= begins[1:]
        open_ = ~(begins & ends) & (depth[here] < shallow)
        here, begins = here[open_], begins[open_]
        if not len(here):
            return order
        heads = np.flatnonzero(begins)
        size = np.diff(np.append(heads, len(here)))
        part = np.repeat(np.arange(len(heads)), size)
        key = symbols[starts[order[here]] + depth[here]]
        one, two, three = key[heads], key[heads + size // 2], key[heads + size - 1]
        pivot = np.maximum(np.minimum(one, two), np.minimum(np.maximum(one, two), three))[part]
        less, same = key < pivot, key == pivot
        to = np.empty(len(here), np.int64)
        at = here[heads]
        for which in (less, same, ~(less | same)):
            count = np.cumsum(which)
            before = count[heads] - which[heads]
            total = count[heads + size - 1] - before
            to[which] = (at[part] + count - before[part] - 1)[which]
            fresh[at[total > 0]] = True
            at = at + total
        order[to], depth[to] = order[here], depth[here] + np.where(same, SYMBOL, 0).astype(np.int8)


def sorted_classes(data: bytes, starts: np.ndarray, fresh: np.ndarray, depth: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``starts`` in the order of their next ``depth`` bytes, and the number of each one's class.

    Strings are compared inside the parts that begin at ``fresh``; ``depth`` is one number in a part.
    """
    symbols = np.ndarray((max(0, len(data) - SYMBOL + 1),), ">u8", data, strides=(1,)) if len(data) >= SYMBOL else np.zeros(0, ">u8")
    fresh = fresh.copy()
    fresh[:1] = True
    order = multikey_quicksort(symbols, starts, fresh, shallow)
    bounds = np.append(np.flatnonzero(fresh), len(order))
    size = np.diff(bounds)
    many = size > 1
    for lo, hi in zip(bounds[:-1][many].tolist(), bounds[1:][many].tolist()):
        rows = order[lo:hi].tolist()
        places = starts[order[lo:hi]].tolist()
        owner: dict[int, list[int]] = {}
        trie = BlindTrie(data, shallow, int(depth[rows[0]]))
        for row, at in zip(rows, places):
            if at in owner:  # one place given twice
                owner[at].append(row)
            else:
                owner[at] = [row]
                trie.insert(at)
        for leaf in trie.leaves():
            fresh[lo] = True
            for at in leaf:
                order[lo : lo + len(owner[at])] = owner[at]
                lo += len(owner[at])
    return order, np.cumsum(fresh) - 1


def deep_shallow(data: bytes, starts: np.ndarray, depth: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their next ``depth`` bytes, and the number of each one's class.

    Shallow: multikey quicksort by symbols of eight bytes. Deep: the parts that agree to the
    shallow depth are put in order by blind tries.
    """
    starts = np.array(starts, np.int64)
    order, kind = sorted_classes(data, starts, np.zeros(len(starts), bool), np.full(len(starts), depth), shallow)
    return starts[order], kind


# ---- the four passes

PACKED = np.dtype([("h", "<u8"), ("text", "<u8"), ("least", "<i8"), ("mask", "<u4")])


def announce(table: pa.Table, parts: int, batch: int) -> pa.Table:
    """A batch's distinct anchors, by part: hash, and number of strands with the top bit for several documents."""
    raw, at, rank = batch_of(table)
    first, _, h = strands(raw, at)
    own = rank[np.searchsorted(at, first, "right") - 1]
    order = np.lexsort((own, h))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    heads = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(heads, len(h))), 0x7FFF).astype(np.uint64)
    several = own[np.append(heads[1:], len(h)) - 1] != own[heads] if len(heads) else np.zeros(0, bool)
    packed = h[heads] | (count | (several.astype(np.uint64) << np.uint64(15))) << np.uint64(48)
    return by_part(h[heads] % np.uint64(parts), batch, packed)


def by_part(part: np.ndarray, batch: int, values: np.ndarray) -> pa.Table:
    order = np.argsort(part, kind="stable")
    part, values = part[order].astype(np.int64), values[order]
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rows = [planes(values[a:b]) for a, b in zip(heads.tolist(), np.append(heads[1:], len(part)).tolist())]
    return pa.table([pa.array(part[heads]), pa.array(np.full(len(heads), batch, np.int64)), pa.array(rows, pa.binary())], ["part", "batch", "blob"])


def shared_anchors(table: pa.Table) -> pa.Table:
    """For each batch: which of its anchors are in other documents too, the very common ones marked."""
    values = blobs(table.column("blob"), "<u8")
    batch = np.repeat(table.column("batch").to_numpy(), [len(x) // 8 for x in table.column("blob").to_pylist()])
    h, count = values & LOW48, (values >> np.uint64(48)).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, count, batch = h[order], count[order], batch[order]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(h)))
    several = np.add.reduceat(count >> 15, heads) > 0 if len(heads) else np.zeros(0, bool)
    total = np.add.reduceat(count & 0x7FFF, heads) if len(heads) else np.zeros(0, np.int64)
    keep = np.repeat((size > 1) | several, size)
    marked = h | np.where(np.repeat(total >= HOT, size), HOT_BIT, np.uint64(0))
    out = by_part(batch[keep].astype(np.uint64), 0, marked[keep])
    return pa.table([out.column("part"), out.column("blob")], ["batch", "blob"])


def selected(raw: bytes, at: np.ndarray, rank: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, hot: np.ndarray):
    """First start, number of windows, rank, anchor and text hash of strands; hot ones window by window."""
    if hot.any():
        size = np.where(hot, last - first + 1, 1)
        row = np.repeat(np.arange(len(first)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        first, last, h, hot = first[row] + step, np.where(hot[row], first[row] + step, last[row]), h[row], hot[row]
    own = rank[np.searchsorted(at, first, "right") - 1]
    ends = last + WINDOW
    text = np.empty(len(first), np.uint64)
    for k in range(0, len(first), STEP):
        text[k : k + STEP] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first[k : k + STEP].tolist(), ends[k : k + STEP].tolist())]
    return first, last - first + 1, own, h | np.where(hot, HOT_BIT, np.uint64(0)), text


def known(reply: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted reply, -1 if it isn't there."""
    if not len(reply):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(reply, h), len(reply) - 1)
    return np.where(reply[i] == h, i, -1)


SENT = "part bigint, batch bigint, h binary, texts binary, sizes binary, ranks binary"


def send_strands(table: pa.Table, reply: pa.Table, parts: int, batch: int) -> pa.Table:
    """The distinct strands with shared anchors: text, smallest rank, and whether it has several ranks."""
    raw, at, rank = batch_of(table)
    shared = np.sort(blobs(reply.column("blob"), "<u8"))
    bare = shared & LOW48
    order = np.argsort(bare, kind="stable")
    shared, bare = shared[order], bare[order]
    first, last, h = strands(raw, at)
    i = known(bare, h)
    keep = i >= 0
    hot = (shared[i[keep]] & HOT_BIT) > 0 if len(shared) else np.zeros(0, bool)
    data = raw.tobytes()
    first, size, own, h, text = selected(data, at, rank, first[keep], last[keep], h[keep], hot)
    order = np.lexsort((own, text, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    heads = order[new]
    least = own[heads]
    ends = order[np.append(np.flatnonzero(new)[1:], len(order)) - 1] if len(order) else heads
    several = own[ends] != least
    part = np.where(h[heads] & HOT_BIT, text[heads], h[heads]) % np.uint64(parts)
    by = np.argsort(part, kind="stable")
    heads, part, least, several = heads[by], part[by].astype(np.int64), least[by], several[by]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(part)).tolist()):
        own_rows = heads[a:b]
        texts = b"".join([data[s : s + n + WINDOW - 1] for s, n in zip(first[own_rows].tolist(), size[own_rows].tolist())])
        rows.append((int(part[a]), batch, planes(np.where(several[a:b], h[own_rows] | np.uint64(1 << 63), h[own_rows])), zstandard.compress(texts, 3), size[own_rows].astype(np.uint8).tobytes(), planes(least[a:b])))
    columns = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["part", "batch", "h", "texts", "sizes", "ranks"])


def first_documents(table: pa.Table) -> pa.Table:
    """For each batch's strands: the windows that an earlier document has (a bit each)."""
    h = blobs(table.column("h"), "<u8")
    several, h = h >> np.uint64(63) > 0, h & np.uint64((1 << 63) - 1)
    size, rank = blobs(table.column("sizes"), np.uint8).astype(np.int64), blobs(table.column("ranks"), "<i8")
    batch = np.repeat(table.column("batch").to_numpy(), [len(x) for x in table.column("sizes").to_pylist()])
    data = b"".join(map(zstandard.decompress, table.column("texts").to_pylist()))
    at = np.concatenate(([0], np.cumsum(size + WINDOW - 1)))
    anchor = h & LOW48
    # All strands under an anchor are sorted; those of several batches that are one text become one class.
    by = np.lexsort((size, anchor))
    fresh = np.append(True, (anchor[by][1:] != anchor[by][:-1]) | (size[by][1:] != size[by][:-1]))[: len(by)]
    order, kind = sorted_classes(data, at[:-1][by], fresh, size[by] + WINDOW - 1)
    text = np.zeros(len(h), np.int64)
    text[by[order]] = kind
    classes = int(kind[-1]) + 1 if len(kind) else 0
    least = np.full(classes, np.iinfo(np.int64).max)
    np.minimum.at(least, text, rank)
    sample = np.zeros(classes, np.int64)
    sample[text[::-1]] = np.arange(len(h))[::-1]
    # Windows are equal only under equal anchors, so where an anchor has several classes their suffixes
    # are sorted too; the windows of one strand are all different.
    windows = size[sample]
    begin = np.cumsum(windows) - windows
    earliest = np.repeat(least, windows)
    _, group, members = np.unique(anchor[sample], return_inverse=True, return_counts=True)
    rest = np.flatnonzero(members[group] > 1)
    rest = rest[np.argsort(group[rest], kind="stable")]
    heads = np.flatnonzero(np.append(True, group[rest][1:] != group[rest][:-1]))[: len(rest)]
    before = np.append(0, np.cumsum(windows[rest]))
    cuts = heads[np.unique(np.searchsorted(before[heads], np.arange(0, before[-1], SORTED), "right") - 1)] if len(rest) else heads
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rest)]):
        own = rest[i:j]
        count = windows[own]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts, slots = np.repeat(at[sample[own]], count) + step, np.repeat(begin[own], count) + step
        part = np.repeat(group[own], count)
        order, kind = sorted_classes(data, starts, np.append(True, part[1:] != part[:-1]), np.full(len(starts), WINDOW))
        slot = slots[order]
        best = np.full(int(kind[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, kind, earliest[slot])
        earliest[slot] = best[kind]
    mask = np.zeros(len(h), np.uint32)
    for i in range(0, len(h), STEP):
        count = size[i : i + STEP]
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        seen = earliest[begin[text[i : i + STEP]][row] + step] < rank[i : i + STEP][row]
        mask[i : i + STEP] = np.bincount(row, seen * 2.0**step, len(count)).astype(np.uint32)
    keep = np.flatnonzero((mask > 0) | several)
    out = np.zeros(len(keep), PACKED)
    out["h"], out["least"], out["mask"] = h[keep], rank[keep], mask[keep]
    cut = at.tolist()
    out["text"] = [xxhash.xxh3_64_intdigest(data[cut[i] : cut[i + 1]]) for i in keep.tolist()]
    answers = by_part(batch[keep].astype(np.uint64), 0, out)
    return pa.table([answers.column("part"), answers.column("blob")], ["batch", "blob"])


def remove(table: pa.Table, reply: pa.Table, keep: list[str], whole_characters: bool) -> pa.Table:
    """A batch's documents without the bytes of windows that an earlier document has."""
    raw, at, rank = batch_of(table)
    answers = np.sort(blobs(reply.column("blob"), PACKED), order=["h", "text"])
    data = raw.tobytes()
    cover = np.zeros(len(raw) + 1, np.int32)
    if len(answers):
        bare = np.unique(answers["h"])
        plain, order = bare & LOW48, np.argsort(bare & LOW48, kind="stable")
        first, last, h = strands(raw, at)
        i = known(plain[order], h)
        got = i >= 0
        hot = (bare[order][i[got]] & HOT_BIT) > 0
        first, size, own, h, text = selected(data, at, rank, first[got], last[got], h[got], hot)
        # Both parts of the key in one sorted array of pairs.
        keys = np.zeros(len(answers), "<u8,<u8")
        keys["f0"], keys["f1"] = answers["h"], answers["text"]
        wanted = np.zeros(len(h), "<u8,<u8")
        wanted["f0"], wanted["f1"] = h, text
        both, where = np.unique(np.concatenate([keys, wanted]), return_inverse=True)
        slot = np.full(len(both), -1)
        slot[where[: len(keys)]] = np.arange(len(keys))
        j = slot[where[len(keys) :]]
        got = j >= 0
        first, size, own, j = first[got], size[got], own[got], j[got]
        full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
        mask = np.where(own > answers["least"][j], full, answers["mask"][j].astype(np.uint64))
        whole = mask == full
        np.add.at(cover, first[whole], 1)
        np.add.at(cover, first[whole] + size[whole] + WINDOW - 1, -1)
        some = np.flatnonzero(~whole & (mask > 0))
        for bit in range(SPAN):
            hits = first[some[(mask[some] >> np.uint64(bit)) & np.uint64(1) > 0]] + bit
            np.add.at(cover, hits, 1)
            np.add.at(cover, hits + WINDOW, -1)
    gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
    del cover
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = gone[heads]
    edges = at.tolist()
    total = lambda x: np.array([np.count_nonzero(x[a:b]) for a, b in zip(edges, edges[1:])], np.int64)
    removed, spans = total(gone), total(begins)
    del begins
    left = raw[~gone].tobytes()
    del gone
    edges = np.concatenate(([0], np.cumsum(np.diff(at) - removed))).tolist()
    kept = [left[a:b] for a, b in zip(edges, edges[1:])]
    if whole_characters:
        kept = [x.decode("utf-8", "ignore") for x in kept]
    return pa.table([*[table.column(c) for c in keep], pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array(kept, pa.string() if whole_characters else pa.binary())], [*keep, "n_bytes", "n_removed", "n_spans", "kept_text" if whole_characters else "kept_bytes"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, batch_bytes: int = BATCH_BYTES, whole_characters: bool = False) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller id.

    Rows out, one per row of ``docs``: the columns ``keep`` (default: the id), n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_bytes (the remaining bytes), or with
    ``whole_characters`` kept_text (the same without parts of characters). Texts are UTF-8 bytes, null
    is empty, long ones are read whole, matches don't cross documents, and strings are judged on the
    texts as they came in. Ids of any type that can be ordered will do. A null id is larger than
    every other; rows with one id, repeated or not, don't remove from one another. An empty table
    gives an empty result; columns of any name may stand beside id and text.
    """
    keep = keep if keep is not None else [id_col]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    last = F.max(F.col(id_col).cast("long") if whole else F.lit(0).cast("long"))
    size, most = docs.agg(F.sum(F.octet_length(text_col)), last).first()
    batches, parts = (max(1, -(-int(size or 0) // n)) for n in (batch_bytes, PART_BATCHES * batch_bytes))
    rows = docs.select(
        # Rows that repeat an id and a text are dealt out too, by the partition they are read in.
        F.pmod(F.xxhash64(F.lit("batch"), F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(batches)).alias("batch"),
        F.col(id_col).alias("id"),
        text.alias("text"),
        *[F.col(f"`{c}`").alias(f"keep {i}") for i, c in enumerate(keep)],
    )
    if whole and (most is None or most < NO_ID):
        rank = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))
    else:
        # Ranks in the order of the ids: rows are ordered over all partitions, and numbered in it.
        ranks = stored(docs.select(F.col(id_col).alias("ranked")).where("ranked IS NOT NULL").distinct().orderBy("ranked").withColumn("number", F.monotonically_increasing_id()), "ranks")
        rows, rank = rows.join(ranks, F.col("id") == F.col("ranked"), "left"), F.coalesce("number", F.lit(NO_ID))
    rows = rows.select("batch", rank.alias("rank"), "text", *[f"keep {i}" for i in range(len(keep))])
    names = [f"keep {i}" for i in range(len(keep))]
    number = lambda t: t.column("batch")[0].as_py()

    def tidy(f):
        """The function, and what it has used given back."""

        def run(*tables):
            make_room("suffix")
            try:
                return f(*tables)
            finally:
                release()

        # Spark looks at the number of arguments.
        return (lambda t, r: run(t, r)) if f.__code__.co_argcount == 2 else (lambda t: run(t))


    anchors = rows.groupBy("batch").applyInArrow(tidy(lambda t: announce(t, parts, number(t))), "part bigint, batch bigint, blob binary")
    shared = anchors.groupBy("part").applyInArrow(tidy(lambda t: shared_anchors(t)), "batch bigint, blob binary")
    sent = rows.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(tidy(lambda t, r: send_strands(t, r, parts, number(t))), SENT)
    seen = sent.groupBy("part").applyInArrow(tidy(lambda t: first_documents(t)), "batch bigint, blob binary")
    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.groupBy("batch").cogroup(seen.groupBy("batch")).applyInArrow(tidy(lambda t, r: remove(t, r, names, whole_characters)), f"{fields}, n_bytes bigint, n_removed bigint, n_spans bigint, {'kept_text string' if whole_characters else 'kept_bytes binary'}")
    return out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, keep)], "n_bytes", "n_removed", "n_spans", out.columns[-1])


#: For small tables: it has a row for every window. Bytes are pairs of hexadecimal digits.
ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS window_bytes
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {WINDOW - 1})) AS i FROM t WHERE length(h) >= {2 * WINDOW})
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY window_bytes) AS first FROM w) WHERE first < doc_id
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hits))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER o, 0) AS lo, a AS hi FROM runs WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h) // 2) - lo)), '' ORDER BY lo) AS k FROM gaps JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(r.n, 0) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS spans FROM runs GROUP BY doc_id) r USING (doc_id)
"""
