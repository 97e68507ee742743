"""Words of many texts at once, in Arrow batches: where they are, and which are the same. A text is in one row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once, and words of one line in one row.
STEP, RUN = 2 << 20, 4096


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def _spans(data: np.ndarray, at: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings and ends of words, and which bytes lie between words."""
    gap = data == 32
    if lines:
        gap |= (data == 10) | (data == 13)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.append(True, gap)[:-1] | edge[:-1], np.append(gap, True)[1:] | edge[1:]
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1, gap


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gap: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[~gap]))


def words_below(texts: pa.Array, lowered: pa.Array | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts and the text of each, without their places; in lower case, as ``Words.group`` has it, if ``lowered`` is given."""
    if lowered is not None:
        texts = pc.if_else(pc.is_null(lowered), pc.ascii_lower(texts), lowered)
    data, at = utf8(texts)
    begin, end, gap = _spans(data, at, True)
    return _strings(data, begin, end, gap), np.searchsorted(at, begin, side="right") - 1


class Words:
    """The words of some texts in their order: ``row`` (of its text), ``line``, ``start`` and ``end`` in UTF-16 units, ``token``.

    Words end at single spaces, with ``lines`` also at CR and LF.
    """

    def __init__(self, texts: pa.Array, lines: bool = True):
        self.texts, self.lines = texts, lines
        data, at = utf8(texts)
        begin, end, gap = _spans(data, at, lines)
        units = np.append(0, np.cumsum(((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0)))
        self.row = np.searchsorted(at, begin, side="right") - 1
        first, self.line = at[self.row], np.zeros(len(begin), np.int64)
        if lines:
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            pair = (np.append(data, 0)[1:] == 10) & ~edge[1:]
            breaks = np.flatnonzero((data == 10) | (data == 13) & ~pair)
            k = np.searchsorted(breaks, begin)
            self.line = k - np.searchsorted(breaks, at)[self.row]
            first = np.maximum(first, np.append(0, breaks + 1)[k])
        self.start, self.end = units[begin] - units[first], units[end] - units[first]
        self.token = _strings(data, begin, end, gap)

    def __len__(self) -> int:
        return len(self.row)

    def group(self, lowered: pa.Array) -> None:
        """Find equal words of a text: ``order`` puts them together, groups begin in it at ``begins`` (one more at the end); ``symbol`` has the group's word.

        ``lowered`` has texts in lower case, null for those of ASCII.
        """
        data, at = utf8(pc.if_else(pc.is_null(lowered), pc.ascii_lower(self.texts), lowered))
        begin, end, gap = _spans(data, at, self.lines)
        coded = _strings(data, begin, end, gap).dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy()
        key = self.row * max(1, len(self.names)) + self.code
        self.order = np.argsort(key, kind="stable")
        self.keys, begins = np.unique(key[self.order], return_index=True)
        self.begins = np.append(begins, len(key))
        self.first = self.order[begins]
        self.symbol = self.names.take(pa.array(self.code[self.first]))

    def groups_of(self, row: np.ndarray, symbols: pa.Array) -> np.ndarray:
        """Which group each pair of a text and a symbol is, -1 for none."""
        code = pc.index_in(symbols, self.names)
        known = np.asarray(pc.is_valid(code))
        key = row * max(1, len(self.names)) + pc.fill_null(code, 0).to_numpy()
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = known & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)
        return np.where(hit, at, -1)


class Lines:
    """The lines of some texts, and places in them. Lines end at CR, LF or both."""

    def __init__(self, texts: pa.Array):
        self.data, at = utf8(pc.fill_null(texts, ""))
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True
        here = np.append(self.data, 0)
        lf, cr = here[:-1] == 10, here[:-1] == 13
        pair = cr & (here[1:] == 10) & ~edge[1:]
        breaks = np.flatnonzero(lf | cr & ~pair)
        after = np.append(False, pair)[breaks]  # a LF behind a CR
        row = np.searchsorted(at, breaks, side="right") - 1
        # By text: its beginning, and behind each of its breaks; a line ends before the break, or with the text.
        begin, of = np.append(at[:-1], breaks + 1), np.append(np.arange(len(texts)), row)
        order = np.argsort(of * (len(self.data) + 2) + begin, kind="stable")
        self.begin = begin[order]
        self.first = np.searchsorted(of[order], np.arange(len(texts) + 1))
        self.end = np.empty(len(begin), np.int64)
        last = np.zeros(len(begin), bool)
        last[self.first[1:] - 1] = True
        self.end[~last], self.end[last] = breaks - after, at[1:]
        self.units = np.append(0, np.cumsum(((self.data & 0xC0) != 0x80).astype(np.int64) + (self.data >= 0xF0)))

    def units_at(self, row: np.ndarray, line: np.ndarray, column: np.ndarray, octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns in UTF-16 units, given in bytes (``octets``) or in units, and whether they are places of their lines."""
        count = np.diff(self.first)[row]
        inside = (line >= 0) & (line < count) & (column >= 0)
        k = np.where(inside, self.first[row] + line, 0)
        begin, end, data = self.begin[k], self.end[k], np.append(self.data, 0)
        byte = np.minimum(begin + np.maximum(column, 0), end)
        by_byte = (column <= end - begin) & ((byte == end) | ((data[byte] & 0xC0) != 0x80))
        unit = self.units[begin] + column
        found = np.minimum(np.searchsorted(self.units, unit), len(self.units) - 1)
        by_unit = (unit <= self.units[end]) & (self.units[found] == unit)
        return np.where(octets, self.units[byte] - self.units[begin], column), inside & np.where(octets, by_byte, by_unit)


def pieces(batches: Iterator[pa.RecordBatch], step: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``step`` bytes of their last column."""
    step = step or STEP
    for b in batches:
        at = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy()))
        cuts = np.unique(np.append(np.searchsorted(at[:-1], np.arange(0, at[-1] + 1, step)), b.num_rows))
        for i, j in zip(np.append(0, cuts[cuts > 0])[:-1].tolist(), cuts[cuts > 0].tolist()):
            if j > i:
                yield b.slice(i, j - i)


def run_cutter(own: int, lines: bool, following: bool) -> Callable:
    """For ``mapInArrow``: ``own`` columns and a text become a row for each line (at most RUN words) with its words as an array of structs."""

    def run(batches):
        for b in pieces(batches):
            w = Words(b.column(own), lines)
            n = len(w)
            if not n:
                continue
            new = np.append(True, (w.row[1:] != w.row[:-1]) | (w.line[1:] != w.line[:-1]))
            place = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
            begins = np.flatnonzero(new | (place % RUN == 0))
            columns, names = [w.token, pa.array(w.start), pa.array(w.end)], ["token", "start_char", "end_char"]
            if following:
                after = pa.array(np.arange(1, n + 1), mask=np.append(new[1:], True))
                columns, names = [*columns, w.token.take(after), pa.array(w.end).take(after)], [*names, "to", "to_end"]
            words = pa.ListArray.from_arrays(pa.array(np.append(begins, n), pa.int32()), pa.StructArray.from_arrays(columns, names))
            at = pa.array(w.row[begins])
            line = [pa.array(w.line[begins])] if lines else []
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(own)], *line, words], [*b.schema.names[:own], *["line" for _ in line], "words"])

    return run
