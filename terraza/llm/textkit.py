"""Vectorised work on Arrow text columns: words, rolling hashes and shingles, without a Python loop per word.

A text column is handled in chunks of whole texts (about ``CHUNK`` bytes; a longer text is a chunk of its own), so the
memory of a task follows its longest text, not its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix
_BASE = 0x9E3779B97F4A7C15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _keys(n: np.ndarray) -> np.ndarray:
    return _mix((n.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range of data, which has eight bytes more than any range reaches; equal bytes have equal hashes.

    A range is taken in blocks of eight bytes. Each is mixed with a key of its place, so no run of blocks is a linear function of
    another; ranges of one length up to eight bytes never collide, others only as random numbers of 64 bits do.
    """
    size = end - start
    load = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    out = _mix(load[start] & _MASK[np.minimum(size, 8)] ^ _keys(np.zeros(1, np.int64)))
    long = np.flatnonzero(size > 8)
    if len(long):
        count = (size[long] - 1) // 8
        first = np.cumsum(count) - count
        nth = np.arange(int(count.sum())) - np.repeat(first, count) + 1
        own = np.repeat(long, count)
        block = load[start[own] + 8 * nth] & _MASK[np.minimum(size[own] - 8 * nth, 8)]
        out[long] += np.add.reduceat(_mix(block ^ _keys(nth)), first)
    return _mix(out + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


#: Byte classes: text between blanks, and words of digits, letters and non-ASCII bytes.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_a : _b + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Chunk:
    """Whole texts of a column: their bytes end to end, and where each begins."""

    row: int  #: of the first text in the column
    buf: np.ndarray
    offs: np.ndarray  #: one more than there are texts

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> str:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """A null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield Chunk(i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    """The words of a chunk, in order."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: first[d] : first[d + 1] are the words of text d
    data: np.ndarray  #: the chunk's bytes and eight more

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges; equal bytes have equal hashes."""
        return range_hashes(self.data, start, end)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(c: Chunk, kind: np.ndarray, lower: bool = True) -> Words:
    n = len(c.buf)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = LOWER[c.buf] if lower else c.buf
    inside = kind[c.buf]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0] = edge[n] = True
    edge[c.offs] = True
    cuts = np.flatnonzero(edge)
    full = inside[cuts[:-1]] if n else np.zeros(0, bool)
    start, end = cuts[:-1][full], cuts[1:][full]
    return Words(start, end, range_hashes(low, start, end), np.searchsorted(start, c.offs), low)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the width words from each word on, and whether they all lie in the word's text."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        out[: n - j] += hashes[j:] * np.uint64((_BASE * (2 * j + 3) ** 5 | 1) & (1 << 64) - 1)
    last = np.repeat(first[1:], np.diff(first))
    return _mix(out), np.arange(n) + width <= last


def shingle_sets(c: Chunk, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of blank-separated, ASCII-lowered words; fewer words than width are one shingle, no words none."""
    w = words(c, NON_BLANK)
    h, good = shingles(w.hash, w.first, width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(h[a:b][good[a:b]]))
        elif b > a:
            short = int(b - a)
            for x in w.hash[a:b].tolist():
                short = (short * _BASE + x) % (1 << 64)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
