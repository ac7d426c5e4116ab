"""Words of whole Arrow columns as 64-bit hashes, without a Python object per word.

Bytes are classed by a table; a running polynomial sum gives the hash of any run of
bytes by two look-ups, so a column costs a few vector operations a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are lexed at once; a longer text is lexed alone.
SLICE = 1 << 22

# Blocks of Unicode that hold marks and no letters.
MARKS = r"[\x{A0}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{206F}\x{2190}-\x{2BFF}\x{3000}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"

WORD, NUMBER, MARK, START, END = range(5)

_CLASS = np.full(256, 3, np.uint8)
_CLASS[:33] = 0
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[1], _CLASS[2] = 4, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, _BACK)]
    return _powers


@dataclass
class Tokens:
    """Tokens of several texts in order; each text opens with START and closes with END."""

    row: np.ndarray  # place of the text in the column
    kind: np.ndarray
    hash: np.ndarray  # of the lower-cased word; one for all numbers, and one for all runs of marks
    length: np.ndarray  # bytes
    wide: np.ndarray  # words of several characters that are written without blanks
    same: np.ndarray  # words of one repeated letter


def lex(texts: pa.Array) -> Iterator[Tokens]:
    """The tokens of a column of strings without nulls, slice by slice."""
    low = pc.replace_substring_regex(pc.utf8_lower(texts), MARKS, ".")
    framed = pc.binary_join_element_wise(pa.scalar("\x01"), low, pa.scalar("\x02"), pa.scalar(" "))
    framed = framed.combine_chunks() if isinstance(framed, pa.ChunkedArray) else framed
    if not len(framed):
        return
    offsets = np.frombuffer(framed.buffers()[1], np.int32 if framed.type == pa.string() else np.int64)[framed.offset : framed.offset + len(framed) + 1]
    data = np.frombuffer(framed.buffers()[2], np.uint8)
    first = 0
    while first < len(framed):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        yield _slice(data[offsets[first] : offsets[last]], first)
        first = last


def _slice(b: np.ndarray, first: int) -> Tokens:
    c = _CLASS[b]
    g = np.where(c == 2, 1, c)
    new = np.ones(len(b) + 1, bool)
    new[1:-1] = (g[1:] != g[:-1]) | (g[1:] >= 4)
    start = np.flatnonzero(new[:-1] & (g > 0))
    end = np.flatnonzero(new[1:] & (g > 0)) + 1
    power, back = _power(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)])
    h = mix((total[end] - total[start]) * back[start])

    def count(of: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(of)])

    digits, high = count(c == 2), count(b >= 0xE3)
    changes = count(np.concatenate([[False], b[1:] != b[:-1]]))
    group = g[start]
    kind = np.where(group == 3, MARK, np.where(group == 4, START, np.where(group == 5, END, WORD)))
    kind = np.where((group == 1) & (digits[end] > digits[start]), NUMBER, kind).astype(np.uint8)
    h = np.where(kind == WORD, h, kind.astype(np.uint64))
    length = end - start
    return Tokens(
        row=first + np.cumsum(kind == START) - 1,
        kind=kind,
        hash=h,
        length=length,
        wide=(kind == WORD) & (high[end] - high[start] >= 4),
        same=(kind == WORD) & (length >= 3) & (changes[end] == changes[start + 1]),
    )
