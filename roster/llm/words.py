"""Words of a batch of texts as arrays: where they are and a 64-bit hash of each.

Texts stay in the byte buffer Arrow delivers; nothing is made per word in Python. Words are runs of
bytes other than separators. The separators are ASCII, so a word never splits a UTF-8 character.
Hashes are polynomials over random byte codes modulo 2^64, mixed; an n-gram's hash is a polynomial
over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CHUNK_BYTES = 1 << 20

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_WORD_STEP = _U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    """One of many independent hashes derived from ``h``."""
    return mix(h + _U((seed + 1) * _STEP % (1 << 64)))


def _codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Texts:
    """Bytes of some texts: ``data`` and, for text i, ``data[ends[i - 1]:ends[i]]`` (``at`` has the cuts)."""

    def __init__(self, column: pa.Array):
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if column.null_count:
            column = column.fill_null("")
        buffers = column.buffers()
        if buffers[1] is None or not len(column):
            at = np.zeros(len(column) + 1, np.int64)
        else:
            at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
            at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
        first, last = int(at[0]), int(at[-1])
        self.data = np.frombuffer(buffers[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        self.at = at - first

    def __len__(self) -> int:
        return len(self.at) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[self.at])


class Words(Texts):
    """The words of some texts: ``start``, ``end`` in ``data``, ``text`` (its number), ``first`` (the
    number of the first word of each text, one more at the end)."""

    def __init__(self, column: pa.Array, separators: bytes = BLANKS):
        super().__init__(column)
        n = len(self.data)
        table = np.zeros(256, bool)
        table[list(separators)] = True
        inside = ~table[self.data]
        cuts = np.zeros(n + 1, bool)
        cuts[self.at] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | cuts[1:n]
            closes[:-1] &= ~inside[1:] | cuts[1:n]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self._inside = inside
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self)), self.count)

    def hashes(self, seed: int = 1, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash per word, or of its first ``prefix`` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        begin = int(self.start[0])
        place = np.arange(begin, len(self.data)) - np.repeat(self.start, np.diff(np.append(self.start, len(self.data))))
        place *= self._inside[begin:]
        values = _codes(seed)[self.data[begin:]] * powers(_STEP, int(place.max()) + 1)[place]
        size = self.end - self.start
        if prefix is None:
            values *= self._inside[begin:]
        else:
            values *= self._inside[begin:] & (place < prefix)
            size = np.minimum(size, prefix)
        return mix(np.add.reduceat(values, self.start - begin) + size.astype(np.uint64))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word and hash of every run of n words of one text."""
        count = len(hashes)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: count - n + 1] == self.text[n - 1 :])
        if n <= 8:
            h = hashes[: count - n + 1].copy()
            for i in range(1, n):
                h = h * _WORD_STEP + hashes[i : count - n + 1 + i]
        else:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(_STEP, count), dtype=np.uint64)))
            h = (sums[n:] - sums[:-n]) * powers(_BACK, count - n + 1)
        return at, mix(h[at])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        at = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = int(at[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(at, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def first_of_run(values: np.ndarray) -> np.ndarray:
    """True where a sorted array has a new value."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new
