"""Words of a whole batch of texts as vectors over their UTF-8 bytes: positions, 64-bit hashes, document numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The six ASCII white spaces.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Everything that is neither an ASCII letter or digit nor part of a longer UTF-8 sequence.
NOT_ALNUM = np.array([not (chr(i).isascii() and chr(i).isalnum()) and i < 128 for i in range(256)])

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 18)
        for k, base in enumerate((_P, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets where each begins; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators, and where each document's words begin among them."""
    gap = separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~gap
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], gap[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((gap[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first: a polynomial with odd base from prefix sums, then mixed with the length.

    Two different words agree with a chance of about 2**-64.
    """
    up, down = _tables(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data] if lower else data] * up[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
