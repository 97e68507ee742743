"""Pre-tokenisation without regular expressions.

Text becomes an array of codepoint classes. A small automaton over these
classes says where a token begins. Its run over a whole buffer of documents is
an associative scan: every symbol is a function from state to state, functions
are composed inside blocks side by side, the block functions are scanned with
log-step doubling, and each block is then replayed from its true first state.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE = range(6)

#: The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: What may follow an apostrophe at a token's start to form one token with it.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

# Symbols: classes with the one character of lookahead folded in. Symbols from 8 on begin a document.
SPACE_LAST, WHITE_LAST, WHITE_IN, S_LETTER, S_NUMBER, S_OTHER, SHORT, LONG = range(8)
# States: what the token in progress is.
FRESH, IN_WHITE, JOINING, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_MORE, TWO_MORE = range(8)


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins with this symbol."""
    if symbol == SPACE_LAST:
        return JOINING, True
    if symbol == WHITE_LAST:
        return FRESH, True
    if symbol == WHITE_IN:
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if state in (IN_OTHER, JOINING):
        return IN_OTHER, False
    return {S_OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE}[symbol], True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    move, begins = np.zeros(128, np.uint8), np.zeros(128, bool)
    for symbol in range(16):
        for state in range(8):
            move[symbol * 8 + state], begins[symbol * 8 + state] = _step(FRESH if symbol >= 8 else state, symbol % 8)
    return move, begins


MOVE, BEGINS = _tables()
BLOCK = 128


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` marks where documents begin."""
    kind = class_table()[cp]
    white = kind >= SPACE
    more = np.empty(len(cp), bool)
    more[:-1] = ~first[1:]
    more[-1:] = False
    before_text = np.zeros(len(cp), bool)
    before_text[:-1] = ~white[1:]
    before_text &= more
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_OTHER, WHITE_IN, WHITE_IN], np.uint8)[kind]
    out[before_text & (kind == SPACE)] = SPACE_LAST
    out[before_text & (kind == WHITE)] = WHITE_LAST
    quotes = np.flatnonzero((kind == APOSTROPHE) & more)
    if len(quotes):
        one = cp[quotes + 1]
        out[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = SHORT
        q = quotes[more[quotes + 1]]
        for a, b in TWO_LETTERS:
            out[q[(cp[q + 1] == ord(a)) & (cp[q + 2] == ord(b))]] = LONG
    return out + first.astype(np.uint8) * 8


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points at which tokens begin."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    sym = symbols(cp, first)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, WHITE_IN, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) << 3
    # Each block's function, for all eight first states side by side.
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)
    for row in grid:
        f = MOVE.take(f | row)
    # Inclusive scan of the block functions: after a step of width w, f[:, i] spans blocks i-2w+1 to i.
    width = 1
    while width < blocks:
        g = f.copy()
        g[:, width:] = np.take_along_axis(f[:, width:], f[:, :-width].astype(np.intp), 0)
        f, width = g, width * 2
    state = np.empty(blocks, np.uint8)
    state[0] = FRESH
    state[1:] = f[FRESH, :-1]
    begins = np.empty((BLOCK, blocks), bool)
    for i, row in enumerate(grid):
        at = state | row
        begins[i] = BEGINS.take(at)
        state = MOVE.take(at)
    return np.flatnonzero(begins.T.reshape(-1)[:n])


def pieces(data: memoryview | bytes, at: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens of a buffer of documents whose byte offsets are ``at``.

    Returns the byte slices, the index of each document's first slice (n + 1
    numbers), and each slice's byte offset in the buffer.
    """
    lo, hi = int(at[0]), int(at[-1])
    raw = bytes(data[lo:hi])
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    edges = at - lo
    if len(cp) == len(raw):
        where = None
        heads = edges[:-1]
    else:
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        where = np.concatenate(([0], np.cumsum(width)))
        heads = np.searchsorted(where, edges[:-1])
    first = np.zeros(len(cp), bool)
    first[heads[edges[:-1] < edges[1:]]] = True
    starts = token_starts(cp, first)
    begin = starts if where is None else where[starts]
    ends = np.append(begin[1:], len(raw)).tolist()
    out = [raw[a:b] for a, b in zip(begin.tolist(), ends)]
    return out, np.searchsorted(begin, edges), begin
