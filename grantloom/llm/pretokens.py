"""Pre-token boundaries of byte-level BPE by an associative scan instead of a regular expression.

Every code point gets a class (letter, number, white space, other), and with one or two code points of look-ahead a
symbol. The pattern that byte-level BPE splits with is then a finite automaton over symbols. A symbol is a function from
state to state; functions compose associatively, so the states of a whole batch come from a blocked prefix scan in
which each step composes one column of all blocks at once. The closure of the symbol functions under composition is
small, so a composition is one table look-up.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# symbols
LETTER, NUMBER, OTHER, SHORT, LONG, LEAD, LONE, SPACE, BREAK = range(9)
# states: nothing open, a run of one kind, a blank that opens the next token, one or two letters of a contraction left
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, LED, LAST, NEXT = range(8)
STATES, SYMBOLS = 8, 9

# White space as Unicode defines it, and the contractions that are tokens of their own.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters and numbers that Unicode 16 added and Python's tables may not have yet (first and last code point).
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this symbol."""
    if symbol == BREAK:
        return FREE, True
    if state == NEXT:
        return LAST, False
    if state == LAST:
        return FREE, False
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[symbol]
        return run, state not in (run, LED)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, LED):
            return IN_OTHER, False
        return (LAST if symbol == SHORT else NEXT), True
    if symbol == LEAD:
        return LED, True
    if symbol == LONE:
        return FREE, True
    return IN_SPACE, state != IN_SPACE


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; start flags; the symbols' functions; composition table; functions applied to states."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            classes[point] = LETTER
        elif kind == "N":
            classes[point] = NUMBER
    for later, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for low, high in later:
            classes[low : high + 1] = kind
    classes[list(WHITE)] = SPACE
    starts = np.array([[_step(q, s)[1] for s in range(SYMBOLS)] for q in range(STATES)]).reshape(-1)
    functions = [tuple(_step(q, s)[0] for q in range(STATES)) for s in range(SYMBOLS)]
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    order = list(functions)
    for f in order:  # grows while it is read, until it is closed
        for g in functions:
            both = tuple(g[q] for q in f)
            if both not in known:
                known[both] = len(order)
                order.append(both)
    compose = np.array([[known[tuple(g[q] for q in f)] for g in order] for f in order], dtype=np.uint16)
    apply = np.array(order, dtype=np.uint8)
    first = np.array([known[f] for f in functions], dtype=np.uint16)
    return classes, starts, first, compose, apply


def _scan(codes: np.ndarray) -> np.ndarray:
    """State before each position, for functions given by their codes, from FREE."""
    _, _, _, compose, apply = _tables()
    n, m = len(codes), len(apply)
    flat = compose.reshape(-1).astype(np.intp)
    if n <= 64:
        states, q = np.empty(n, dtype=np.uint8), FREE
        for i, f in enumerate(codes.tolist()):
            states[i] = q
            q = apply[f, q]
        return states
    width = max(16, int(np.sqrt(n / 16)))
    blocks = -(-n // width)
    padded = np.full(blocks * width, codes[-1], dtype=np.uint16)
    padded[:n] = codes
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    prefix = np.empty((width, blocks), dtype=np.uint16)
    prefix[0] = columns[0]
    run = columns[0].astype(np.intp)
    for j in range(1, width):
        run = flat[run * m + columns[j]]
        prefix[j] = run
    entry = _scan(run.astype(np.uint16))  # state in which each block is entered
    after = apply.reshape(-1)[prefix.astype(np.intp) * STATES + entry]
    states = np.empty((width, blocks), dtype=np.uint8)
    states[0] = entry
    states[1:] = after[:-1]
    return np.ascontiguousarray(states.T).reshape(-1)[:n]


def _symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    classes = _tables()[0]
    symbols = classes[points]
    symbols[breaks] = BREAK
    white = symbols == SPACE
    inner = white[:-1] & ~white[1:] & (symbols[1:] != BREAK)  # the last white space before something
    at = np.flatnonzero(inner)
    symbols[at] = np.where(points[at] == 32, LEAD, LONE)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        one = points[np.minimum(quotes + 1, len(points) - 1)]
        two = points[np.minimum(quotes + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quotes), dtype=bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        symbols[quotes[long]] = LONG
        symbols[quotes[short]] = SHORT
    return symbols


def edges(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with one separator after each, the 32-bit positions where pre-tokens begin and the last ends, and which are separators."""
    joined = b"\0".join(texts) + b"\0"
    points = np.frombuffer(joined.decode().encode("utf-32-le"), dtype=np.uint32)
    breaks = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    place = None
    if len(points) < len(joined):  # byte position of each code point
        width = (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF) + 1
        place = np.cumsum(width) - width
        breaks = np.searchsorted(place, breaks)
    symbols = _symbols(points, breaks)
    _, starts, first, _, _ = _tables()
    states = _scan(first[symbols])
    at = np.flatnonzero(starts[states.astype(np.intp) * SYMBOLS + symbols])
    ends = np.searchsorted(at, breaks)
    return joined, np.append(at if place is None else place[at], len(joined)).astype(np.int32), ends


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All pre-tokens of the UTF-8 texts in order, and for each text the position behind its last one.

    The list holds one separator after each text, at the returned positions.
    """
    joined, places, ends = edges(texts)
    places = places.tolist()
    return [joined[a:b] for a, b in zip(places, places[1:])], ends
