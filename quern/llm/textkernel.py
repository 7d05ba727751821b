"""Words and hashes of whole texts, vectorised over Arrow batches with numpy.

Texts stay UTF-8 bytes.  A word's 64-bit hash is a polynomial in a random odd base over a random
byte table, taken from prefix sums and mixed, so no Python loop runs over words or characters.
Work is cut into slices of about a megabyte: memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (in place for uint64 arrays)."""
    h ^= h >> U64(32)
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(salt)) | U64(1)


_TABLE = seeds(256, 11)
_BASE = int(seeds(1, 23)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, and every byte of a non-ASCII character, belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES * 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


@dataclass
class Words:
    """Words of the texts lo to hi of a batch; those of the i-th of them are ptr[i] to ptr[i + 1]."""

    lo: int
    hi: int
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def heads(self, sizes: tuple[int, ...]) -> np.ndarray:
        """Hashes of the words' first bytes, a row for each size; shorter words count whole."""
        return _hash(self.data, self.start, self.end, sizes)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...] = ()) -> np.ndarray:
    out = np.empty((max(1, len(sizes)), len(start)), U64)
    k = 0
    while k < len(start):  # pieces that begin and end at words
        last = max(int(np.searchsorted(end, start[k] + SLICE_BYTES, "right")), k + 1)
        a, b = int(start[k]), int(end[last - 1])
        powers, inverses = _power_tables(b - a + 1)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        np.cumsum(_TABLE[data[a:b]] * powers[: b - a], out=sums[1:])
        s, e = start[k:last] - a, end[k:last] - a
        for j, n in enumerate(sizes or (b - a,)):
            out[j, k:last] = (sums[np.minimum(e, s + n)] - sums[s]) * inverses[s]
        k = last
    return mix(out) if sizes else mix(out[0])


def words(texts: pa.Array, separators: np.ndarray = SPACE, hashed: bool = True) -> Iterator[Words]:
    """Words of each text, A-Z in lower case, split at bytes in separators; a null text has none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():
            texts = texts.fill_null("")
            yield from words(texts, separators, hashed)
            return
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1, lo + 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        data = _FOLD[raw[a:b]]
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[lo:hi] - a
        at = cuts[cuts < b - a]
        first[at] |= inside[at]
        before = at[at > 0] - 1
        last[before] |= inside[before]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        ptr = np.append(np.searchsorted(start, cuts), len(start))
        yield Words(lo, hi, _hash(data, start, end) if hashed else np.zeros(0, U64), start, end, ptr, data, np.append(cuts, b - a))
        lo = hi


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U64)
    k = seeds(n, 37 + n)
    out = h[: len(h) - n + 1] * k[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * k[j]
    return mix(out)


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence, told apart by its length."""
    k = seeds(max(len(h), 1), 1000 + len(h))
    return mix((h * k[: len(h)]).sum(dtype=U64).reshape(1))


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; with fewer words the whole sequence as one; none without words."""
    if not len(h):
        return np.zeros(0, U64)
    return np.unique(ngrams(h, n)) if len(h) >= n else whole(h)
