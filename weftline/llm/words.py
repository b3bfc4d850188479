"""Words of whole texts as 64-bit hashes, a batch of texts at a time.

Runs inside Spark tasks: numpy works on the UTF-8 bytes of an Arrow column, in blocks of
bounded size. A block ends between two texts, so a long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of a block: a dozen arrays of eight bytes for each of them are in memory at once
BLOCK_BYTES = 1 << 18
_U = np.uint64
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_ROW, _ROW_BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(_STEP))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: white space of the word pattern: blank and the bytes 9 to 13
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: besides white space, all ASCII signs that are neither letters nor digits
SPACE_OR_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of a number and of its inverse, grown on demand."""

    def __init__(self, step: int, back: int):
        self.pair, self.tables = (step, back), (np.ones(1, _U), np.ones(1, _U))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << int(n - 1).bit_length()
            self.tables = tuple(
                np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, x, _U)]), dtype=_U)
                for x in self.pair
            )
        return self.tables


_BYTES, _WORDS = _Powers(_STEP, _BACK), _Powers(_ROW, _ROW_BACK)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of a string column; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end, data[starts[first] : starts[end]], starts[first : end + 1] - starts[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """(start, end, count per text) of all words; no word crosses a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after[:-1] & (~before[:-1] | edge[:-1]))
    ends = np.flatnonzero(before[1:] & (~after[1:] | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lower-cased (A-Z) bytes of every span, from one running sum."""
    if not len(starts):
        return np.zeros(0, _U)
    power, back = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * back[starts] + _U(1))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, _U)
    power, back = _WORDS.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * power[: len(words)], out=total[1:])
    grams = (total[size:] - total[:-size]) * back[: len(words) - size + 1]
    return mix64(grams + _U(size))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The ordered distinct shingle hashes of every text.

    A text of fewer than ``size`` words is one shingle, a text without words has none.
    """
    for _, _, data, offsets in text_blocks(column):
        starts, ends, counts = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        at = 0
        for count in counts:
            own = words[at : at + count]
            at += count
            yield np.unique(gram_hashes(own, min(size, count))) if count else own
