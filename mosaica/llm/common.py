"""Shared pieces of the training-data operators: tables in the shared folder, and word kernels over Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mosaica.storage import written  # noqa: F401  (for the operators)

#: ASCII white space that ends a word: space, and TAB to CR.
SPACES = r"\x20\x09-\x0D"
_SUB = 1 << 20


def fresh(taken, name: str) -> str:
    """A column name that none of ``taken`` equals, in any case of letters: for columns that an operator adds for itself."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, and where each row starts in them (rows + 1 offsets); null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = _SUB):
    """Row ranges of about ``most`` bytes each, for kernels whose arrays should stay in cache; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, and grown when a longer row needs it."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, _SUB + 4096), base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A full-avalanche finish of 64-bit values (murmur's), in a new array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hashes(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Sums of table[byte] * base ** position before each position: two of them give the hash of any range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, alike wherever the same bytes stand."""
    inverse = powers(_BASE_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each row (rows + 1 entries).

    A word is a longest run of bytes that aren't separators; none crosses rows.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z lower-cased, and the number of the first word of each row."""
    starts, ends, first = words(data, offsets, separators)
    return range_hashes(prefix_hashes(data, _BYTE_LOWER), starts, ends), first


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values (of all rows together: the caller drops those that cross rows)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[i : i + m]
    return mix(out)
