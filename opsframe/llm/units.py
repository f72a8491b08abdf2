"""UTF-8 bytes of Arrow text columns as numpy arrays: blocks of whole texts, words, hashes.

Everything works on blocks of about 256 KB (a longer text is a block of its own), so that a task
holds a small multiple of its longest text whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Byte to byte, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_array(column) -> pa.Array:
    """One Arrow text array without nulls; a null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (one more entry for the end)."""
    array = text_array(column)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, n + 1 + array.offset)[array.offset :].astype(np.int64)
    begin, end = int(offsets[0]), int(offsets[-1])
    if data is None or end == begin:
        return np.zeros(0, np.uint8), offsets - begin
    return np.frombuffer(data, np.uint8)[begin:end], offsets - begin


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, text offsets) of successive whole texts of about ``limit`` bytes."""
    data, offsets = raw(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and per text the place of its first word (one more at the end)."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.full(size, _BASE, np.uint64)
            self.down = np.full(size, _BASE_INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums (mod 2**64) from which ``span_hash`` takes any span.

    Known pairs of long contents agree in these, whatever the base is: good for features and for
    picking places, not for telling contents apart, which ``Spans`` does.
    """
    up, _ = _POWERS.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:-1]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begins, ends) -> np.ndarray:
    """A 64-bit hash of each span's content and length."""
    _, down = _POWERS.to(len(sums))
    lengths = (np.asarray(ends) - np.asarray(begins)).astype(np.uint64)
    return mix((sums[ends] - sums[begins]) * down[begins] ^ lengths * _ODD)


class _Field:
    """Powers of a base and of its inverse modulo a prime below 2**32, as far as asked for."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime = np.uint64(prime)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.factors = [base, pow(base, -1, prime)]

    def to(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            size, prime = len(self.tables[0]), int(self.prime)
            for i, (table, factor) in enumerate(zip(self.tables, self.factors)):
                more = table * np.uint64(pow(factor, size, prime)) % self.prime
                self.tables[i] = np.concatenate([table, more])
        return [table[:n] for table in self.tables]


# The two largest primes below 2**32, and bases drawn at random.
_FIELDS = (_Field(4294967291, 2862933555), _Field(4294967279, 3202034522))


class Spans:
    """64-bit hashes of any span of values: polynomials modulo two primes, 32 bits of each.

    Two contents of n values that differ share a hash with a chance of about (n / 2**32)**2.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.sums = []
        for field in _FIELDS:
            terms = values.astype(np.uint64)
            if values.dtype.itemsize > 2:
                terms %= field.prime
            terms += np.uint64(1)
            terms *= field.to(len(values) + 1)[0][:-1]
            terms %= field.prime
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)

    def hashes(self, begins, ends) -> np.ndarray:
        """Hashes of the contents and lengths of spans."""
        halves = []
        for field, sums in zip(_FIELDS, self.sums):
            part = (sums[ends] - sums[begins]) % field.prime
            part *= field.to(len(sums))[1][begins]
            halves.append(part % field.prime)
        lengths = (np.asarray(ends) - np.asarray(begins)).astype(np.uint64)
        return mix((halves[0] << np.uint64(32) | halves[1]) ^ lengths * _ODD)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data).hashes(begins, ends)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` successive values; ``k - 1`` fewer than there are values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    total = values[:n] * factors[0]
    for j in range(1, k):
        total += values[j : n + j] * factors[j]
    return mix(total)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
