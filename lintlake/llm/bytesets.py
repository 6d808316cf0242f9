"""Vectorised text primitives: Arrow string columns seen as one byte buffer.

Everything here works on ``(buf, starts)``: the UTF-8 bytes of many texts laid end to end and
the ``n + 1`` offsets that separate them. A null text is an empty one. Hashes are 64-bit and
seedless, so that every executor gives a word the same number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one numpy step; bounds a worker's memory whatever the batch.
SLICE_BYTES = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
#: The word separators of the contracts: blank and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    low, high = int(starts[0]), int(starts[-1])
    buf = np.frombuffer(data, np.uint8, high - low, low) if data is not None and high > low else np.zeros(0, np.uint8)
    return buf, starts - low


def slices(starts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    n, at = len(starts) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i up to n."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = _M, _M_INV
        made = np.cumprod(up), np.cumprod(down)
        if size > SLICE_BYTES * 2:  # made for one very long text: not kept
            return made
        _powers[size] = made
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix(buf: np.ndarray) -> np.ndarray:
    """Sums of byte * M**position before each position."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def spans(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [begin, end) from prefix sums."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every word, in order."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, solid[:-1]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word after lower-casing A-Z."""
    low = LOWER[buf]
    begin, end, row = words(low, starts)
    return spans(prefix(low), begin, end), row


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the distinct n-word shingles, ordered by row and hash.

    A row with fewer words than n has its whole sequence as one; a row without words has none.
    """
    if not len(hashes):
        return hashes, row
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    joined = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        joined = mix(joined * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k])
    keep = row[: len(joined)] == row[n - 1 :] if len(joined) else np.zeros(0, bool)
    out, rows = joined[keep], row[: len(joined)][keep]
    short = np.flatnonzero(count < n)
    if len(short):
        few = []
        for at, m in zip(first[short], count[short], strict=True):
            value = hashes[at : at + 1].copy()
            for k in range(1, m):
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[at + k : at + k + 1])
            few.append(mix(value + np.uint64(m)))
        out, rows = np.r_[out, np.concatenate(few)], np.r_[rows, row[first[short]]]
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])]
    return out[new], rows[new]


def strings(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return column(pa.array(values, pa.large_string()))
