"""A compressed full-text index in numpy: a wavelet matrix over the Burrows-Wheeler transform.

All operations take arrays, so that many patterns are searched in step. Bits are packed 64 to a
word with one running count per word.
"""

from __future__ import annotations

import numpy as np

from opsframe.llm.suffixes import common_prefixes, suffix_array


class BitRow:
    """Packed bits; ``ones(i)`` counts those set before place ``i``."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """The levels of a wavelet tree, each with the zeros of all nodes before the ones."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(BitRow(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        # Where each symbol's run begins on the last level.
        self.run = np.full(1 << bits, -1, np.int64)
        self.run[symbols[::-1]] = np.arange(len(symbols))[::-1]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``i``; the symbols must occur somewhere."""
        for level, row in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = row.ones(i)
            i = np.where(symbol >> level & 1, row.zeros + ones, i - ones)
        return i - self.run[symbol]


class FmIndex:
    """An index of texts (arrays of numbers from 1 up, ``begins`` says where each one begins in
    ``values``); it finds windows of ``window`` symbols by backward search."""

    def __init__(self, values: np.ndarray, begins: np.ndarray, window: int) -> None:
        """A 0 is put before each text, so that no match reaches from one into the next."""
        lengths = np.diff(np.append(begins, len(values)))
        text = np.repeat(np.arange(len(begins)), lengths)
        joined = np.zeros(len(values) + len(begins) + 1, np.int64)
        joined[np.arange(len(values)) + text + 1] = values
        order = suffix_array(joined)
        self.window, self.size = window, len(joined)
        top = int(values.max(initial=0))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=top + 1))])
        self.tree = WaveletMatrix(joined[order - 1], max(top.bit_length(), 1))
        # Neighbours with a whole window in common form a class of equal windows.
        room = np.zeros(len(joined), np.int64)
        places = np.arange(len(values)) + text + 1
        room[places] = (begins + lengths)[text] - np.arange(len(values))
        equal = common_prefixes(joined, order, room) >= window
        heads = np.flatnonzero(~equal)
        self.class_of = np.cumsum(~equal) - 1
        self.class_begin, self.class_end = heads, np.append(heads[1:], len(order))
        # The place in ``values`` that each row's suffix has, -1 for the zeros.
        self.place = np.full(len(joined), -1, np.int64)
        self.place[places] = np.arange(len(values))
        self.place = self.place[order]

    def matches(self, values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, classes): where windows of the streamed texts start that the index holds,
        and the class of rows that equal them.

        Each text is read from its end; a match that has grown beyond the window is cut back to
        it. All symbols have to be in the index; a text in which the match breaks off starts anew.
        """
        ends = np.append(begins[1:], len(values))
        order = np.argsort(begins - ends, kind="stable")
        ends, lengths = ends[order], (ends - begins)[order]
        steps = int(lengths[0]) if len(lengths) else 0
        lanes = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, steps + 1))
        low = np.zeros(len(lengths), np.int64)
        high = np.full(len(lengths), self.size)
        found = np.zeros(len(lengths), np.int64)
        places, classes = [], []
        for step, count in enumerate(lanes):
            at = ends[:count] - 1 - step
            symbol = values[at]
            x = self.below[symbol] + self.tree.rank(symbol, low[:count])
            y = self.below[symbol] + self.tree.rank(symbol, high[:count])
            broken = y <= x
            x = np.where(broken, self.below[symbol], x)
            y = np.where(broken, self.below[symbol + 1], y)
            length = np.where(broken, 1, found[:count] + 1)
            full = length >= self.window
            if full.any():
                own = self.class_of[x[full]]
                x[full], y[full] = self.class_begin[own], self.class_end[own]
                places.append(at[full])
                classes.append(own)
            low[:count], high[:count] = x, y
            found[:count] = np.minimum(length, self.window)
        none = [np.zeros(0, np.int64)]
        return np.concatenate(places or none), np.concatenate(classes or none)
