"""Pre-tokenisation without regular expressions.

Code points become class codes by table lookup (letters, numbers, white space, others, and apostrophes that open a
contraction). A small automaton over the classes says where pieces start. Each code point is a transition function on
the states; composing functions is associative, so blocks of code points are composed side by side, a doubling scan over
the blocks gives every block's entry state, and a last sweep over all blocks at once marks the starts.

The pieces are those of the pattern that byte-level vocabularies use:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import unicodedata

import numpy as np

# Classes. MID: white space with more or the end behind it; the other two stand before something else.
MID, SPACE, OTHER_SPACE, LETTER, NUMBER, REST, SHORT, LONG, END = range(9)
# States: at a piece's start; in a run; after a space that joins what follows; in white space; 1 or 2 letters of a contraction to go.
FRESH, IN_L, IN_N, IN_R, JOIN, IN_S, K1, K2 = range(8)
BLOCK = 128

#: Unicode White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    to, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    to[MID], start[MID, IN_S] = IN_S, False
    to[SPACE] = JOIN
    to[OTHER_SPACE] = FRESH
    to[END] = FRESH
    for c, run in ((LETTER, IN_L), (NUMBER, IN_N), (REST, IN_R), (SHORT, K1), (LONG, K2)):
        to[c] = run
    for c, run in ((LETTER, IN_L), (NUMBER, IN_N), (REST, IN_R)):
        start[c, [run, JOIN]] = False
    to[LETTER, K1], to[LETTER, K2] = FRESH, K1
    start[LETTER, [K1, K2]] = False
    for c in (SHORT, LONG):  # inside a run of others, or behind a joining space, an apostrophe is one of the others
        to[c, [IN_R, JOIN]], start[c, [IN_R, JOIN]] = IN_R, False
    pad = bytes(256 - to.size)
    return to.tobytes() + pad, start.tobytes() + pad


#: Indexed by 8 * class + state, for bytes.translate.
_TO, _START = _tables()


def _look(table: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: white space counts as MID."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        x = np.fromiter((kind.get(unicodedata.category(chr(c))[0], REST) for c in range(0x110000)), np.uint8, 0x110000)
        x[_WHITE] = MID
        _classes.append(x)
    return _classes[0]


def _compose(grid: np.ndarray) -> np.ndarray:
    """Entry state of each block (columns of grid, 8 * class each), by a scan over transition functions."""
    n = grid.shape[1]
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], n, axis=1)
    for row in grid:
        f = _look(_TO, row + f)
    span = 1
    while span < n:  # f[:, i] becomes the composition of all blocks up to i
        g = f.copy()
        g[:, span:] = np.take_along_axis(f[:, span:], f[:, :-span].astype(np.intp), axis=0)
        f, span = g, span * 2
    return np.concatenate((np.zeros(1, np.uint8), f[FRESH, :-1]))


def starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Piece starts in code points; at each index in ends stands a separator, a piece of its own.

    codes ends with a separator."""
    cls = classes()[codes]
    cls[ends] = END
    blank = cls == MID
    stop = blank | (cls == END)
    last = blank & ~np.append(stop[1:], True)
    cls[last] = np.where(codes[last] == 32, SPACE, OTHER_SPACE)
    at = np.flatnonzero((codes == 39) & (cls == REST))
    if len(at):
        codes = codes.copy()
        codes[ends] = 0
        tail = np.concatenate((codes, np.zeros(2, codes.dtype)))
        a, b = tail[at + 1], tail[at + 2]
        cls[at[np.isin(a, [115, 116, 109, 100])]] = SHORT  # s t m d
        cls[at[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]] = LONG  # re ve ll
    n = len(cls)
    pad = -n % BLOCK
    grid = np.ascontiguousarray(np.concatenate((cls, np.full(pad, END, np.uint8))).reshape(-1, BLOCK).T) * np.uint8(8)
    state, begins = _compose(grid), np.empty(grid.shape, np.uint8)
    for k, row in enumerate(grid):
        at = row + state
        begins[k] = _look(_START, at)
        state = _look(_TO, at)
    return np.flatnonzero(np.ascontiguousarray(begins.T).ravel()[:n])


def pieces(rows: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All rows' pieces as UTF-8, and the first piece of each row (with the total as last)."""
    joined = b"\n".join(rows) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    codes = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    ends = np.searchsorted(byte_of, np.cumsum([len(r) + 1 for r in rows]) - 1)
    begin = starts(codes, ends)
    mark = np.searchsorted(begin, ends)  # the separators' own pieces
    keep = np.ones(len(begin), bool)
    keep[mark] = False
    edge = byte_of[begin]
    head, tail = edge[keep].tolist(), np.append(edge[1:], len(data))[keep].tolist()
    return [joined[a:b] for a, b in zip(head, tail)], np.concatenate(([0], mark - np.arange(len(mark))))
