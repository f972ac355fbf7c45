"""Per-codepoint tables, each built by rule from the Unicode categories of the interpreter."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003,
    0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000,
)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = of.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            table[point] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """The lower-case code point, where that is a single one."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        low = chr(point).lower()
        if len(low) == 1:
            table[point] = ord(low)
    return table


def decode(data: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes; invalid bytes read as the replacement character."""
    text = data.decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def widths(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    wide = np.ones(len(points), np.int64)
    for least in (0x80, 0x800, 0x10000):
        wide += points >= least
    return wide
