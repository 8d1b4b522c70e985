"""Vectorised text helpers for Arrow batches inside Spark tasks: words, rolling hashes, keys.

Everything works on one batch: a UTF-8 byte array with document offsets. Hashes are polynomial
over Z/2^64 with a random odd base and a random value per symbol, then mixed; equal sequences
always have equal hashes in every task, since all tables below come from fixed seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_BASE, _SEQ = (int(x) | 1 for x in _RNG.integers(2**40, 2**63, 2))
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that the hashing handles at once (a longer document is handled alone).
SLICE = 1 << 18

#: The bytes that separate words: space and 0x09-0x0D.
IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits are usable as a key."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]))
        if size <= 16 * SLICE:
            _POWERS[base] = have
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base ** i, one longer than values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the sequences [start, end) under prefix(), the same at any position."""
    inverse = powers(len(sums), pow(base, -1, 2**64))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + np.asarray(ends - starts).astype(U64))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 document offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray):
    """Ranges of whole documents of about SLICE bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of a batch: byte range, document row and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        parts = [self._of(data, offsets, a, b, lower) for a, b in slices(offsets)]
        none = np.zeros(0, np.int64)
        self.start, self.end, self.doc = (np.concatenate([none, *(p[i] for p in parts)]) for i in range(3))
        self.hash = np.concatenate([np.zeros(0, U64), *(p[3] for p in parts)])
        self.per_doc = np.bincount(self.doc, minlength=len(offsets) - 1)
        #: Word index at which each document begins, n + 1 values.
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])

    @staticmethod
    def _of(data, offsets, a, b, lower):
        base, part, at = offsets[a], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        part = LOWER[part] if lower else part
        word = IS_WORD[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        end = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        h = spans(prefix(_BYTE[part], _BASE), start, end, _BASE)
        return start + base, end + base, np.searchsorted(at, start, "right") - 1 + a, h

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of so many consecutive words of one document, and their hashes."""
        n = len(self.hash)
        at = np.arange(max(0, n - size + 1))
        at = at[self.doc[at] == self.doc[at + size - 1]]
        out = np.empty(len(at), U64)
        for a in range(0, len(at), SLICE):  # in parts, for memory
            some = at[a : a + SLICE]
            lo, hi = some[0], some[-1] + size
            out[a : a + SLICE] = spans(prefix(self.hash[lo:hi], _SEQ), some - lo, some - lo + size, _SEQ)
        return at, out


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[data], _BASE)


def byte_spans(sums: np.ndarray, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hashes of the byte strings of so many bytes that begin at starts, under byte_sums()."""
    return spans(sums, starts, starts + size, _BASE)


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the windows that begin at starts."""
    begun = np.zeros(n + 1, np.int32)
    begun[1:][starts] = 1
    begun = np.cumsum(begun, dtype=np.int32)
    return begun[1:] > np.concatenate([np.zeros(min(size, n), np.int32), begun[1 : max(1, n + 1 - size)]])


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit values each hash is in."""
    return (((hashes >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


class Keys:
    """The distinct keys of a batch in order of bucket and hash, with the places where each occurs.

    A bucket is a range of hash values unless the bucket of each place is given. `hashes` belong
    to rows whose document values do not decrease; places keep that order, so the first place of
    a key is in its smallest document.
    """

    def __init__(self, hashes: np.ndarray, buckets: int, bucket: np.ndarray | None = None):
        self.order = np.argsort(hashes, kind="stable") if bucket is None else np.lexsort((hashes, bucket))
        ordered = hashes[self.order]
        new = np.ones(len(ordered), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        if bucket is not None:
            new[1:] |= np.diff(bucket[self.order]) != 0
        self.at = np.flatnonzero(new)
        self.until = np.append(self.at[1:], len(ordered))[: len(self.at)]
        self.keys = ordered[self.at]
        self.bucket = ranges(self.keys, buckets) if bucket is None else self.first(bucket)

    def first(self, values: np.ndarray) -> np.ndarray:
        """Of each key, the value at its first place."""
        return values[self.order[self.at]]

    def last(self, values: np.ndarray) -> np.ndarray:
        return values[self.order[self.until - 1]]

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags[self.order], self.at) if len(self.at) else np.zeros(0, bool)

    def parts(self):
        """(bucket, slice of its keys) of each bucket that has keys."""
        found, at = np.unique(self.bucket, return_index=True)
        until = [*at[1:].tolist(), len(self.bucket)][: len(found)]
        for b, lo, hi in zip(found.tolist(), at.tolist(), until, strict=True):
            yield b, slice(lo, hi)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each key to each of its places."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.until - self.at)
        return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
