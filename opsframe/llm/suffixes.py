"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The places of ``values`` (0 and up) in the order of their suffixes.

    Starts with as many symbols as fit one number and doubles the length compared; only groups
    that are still tied are sorted again. With ``depth``, suffixes that agree in that many symbols
    may stay tied, in any order.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(int(values.max() + 1).bit_length(), 1)
    packed = 62 // bits
    padded = np.zeros(n + packed, np.int64)
    padded[:n] = values.astype(np.int64) + 1  # the end of all sorts before any symbol
    key = np.zeros(n, np.int64)
    for i in range(packed):
        key = key << bits | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # one more for places beyond the end
    tied = key[order]
    heads = np.ones(n, bool)
    heads[1:] = tied[1:] != tied[:-1]
    groups = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[order] = groups + 1
    done = packed
    while depth is None or done < depth:
        # Rows of groups that have more than one member.
        single = heads.copy()
        single[:-1] &= heads[1:]
        rows = np.flatnonzero(~single)
        if not len(rows):
            break
        places = order[rows]
        after = rank[np.minimum(places + done, n)]
        resorted = np.argsort(groups[rows] * (n + 2) + after, kind="stable")
        order[rows] = places[resorted]
        after = after[resorted]
        new = heads[rows]
        new[1:] |= after[1:] != after[:-1]
        heads[rows] = new
        groups = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[order[rows]] = groups[rows] + 1
        done *= 2
    return order


def common_prefixes(values: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each row of ``order`` how many symbols its suffix shares with the row before.

    ``order`` may leave places out. A suffix counts as ``room`` symbols long. As in Kasai's scan,
    a place whose left neighbour is matched one to the left, too, has one symbol less in common
    than it; only the others are compared, all at once.
    """
    n = len(values)
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    before = np.full(n + 1, -1, np.int64)  # the place that each place is compared with
    before[order[1:]] = order[:-1]
    places = np.sort(order[1:])
    other = before[places]
    left = places - 1
    follows = (left >= 0) & (other > 0)
    follows &= before[left] == other - 1
    follows &= (values[left] == values[other - 1]) & (room[left] > 1) & (room[other - 1] > 1)
    heads = np.flatnonzero(~follows)
    common = np.zeros(len(places), np.int64)
    x, y = places[heads], other[heads]
    most = np.minimum(room[x], room[y])
    open_rows, length = np.arange(len(heads)), np.zeros(len(heads), np.int64)
    while len(open_rows):
        at = length[open_rows]
        more = at < most[open_rows]
        open_rows, at = open_rows[more], at[more]
        equal = values[x[open_rows] + at] == values[y[open_rows] + at]
        open_rows = open_rows[equal]
        length[open_rows] += 1
    common[heads] = length
    head_of = np.maximum.accumulate(np.where(~follows, np.arange(len(places)), 0))
    common = common[head_of] - (places - places[head_of])
    result = np.zeros(n, np.int64)
    result[places] = common
    shared[1:] = result[order[1:]]
    return shared
