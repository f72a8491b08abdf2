"""Regular expressions over bytes, compiled together into one minimal automaton of arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ANY = (1 << 256) - 1


class _Parser:
    """Literals, escapes, classes, groups, ``|`` and ``? * + {m} {m,} {m,n}``, to a small tree."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def tree(self):
        found = self._choice()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return found

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def _choice(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self._next()
            options.append(self._sequence())
        return ("choice", options) if len(options) > 1 else options[0]

    def _sequence(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeated(self._atom()))
        return ("sequence", items)

    def _repeated(self, atom):
        while (sign := self._peek()) and sign in "?*+{":
            self._next()
            if sign == "{":
                bounds = ""
                while (c := self._next()) != "}":
                    bounds += c
                low, comma, high = bounds.partition(",")
                least, most = int(low), int(high) if high else (None if comma else int(low))
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            atom = ("repeat", atom, least, most)
        return atom

    def _atom(self):
        c = self._next()
        if c == "(":
            found = self._choice()
            if self._next() != ")":
                raise ValueError(f"a group is open in {self.text!r}")
            return found
        if c == "[":
            return ("bytes", self._class())
        if c == ".":
            return ("bytes", _ANY & ~(1 << 10))
        return ("bytes", 1 << (self._escaped() if c == "\\" else ord(c)))

    def _escaped(self) -> int:
        c = self._next()
        if c == "x":
            return int(self._next() + self._next(), 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def _class(self) -> int:
        mask, negated, first = 0, False, True
        if self._peek() == "^":
            self._next()
            negated = True
        while (c := self._next()) != "]" or first:
            first = False
            low = self._escaped() if c == "\\" else ord(c)
            high = low
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self._next()
                c = self._next()
                high = self._escaped() if c == "\\" else ord(c)
            mask |= (1 << (high + 1)) - (1 << low)
        return _ANY & ~mask if negated else mask


class _Net:
    """The patterns' states: byte moves and free moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, begin: int) -> int:
        """The state that ``tree`` leads to from ``begin``."""
        kind = tree[0]
        if kind == "bytes":
            end = self.state()
            self.moves[begin].append((tree[1], end))
            return end
        if kind == "sequence":
            for item in tree[1]:
                begin = self.add(item, begin)
            return begin
        if kind == "choice":
            end = self.state()
            for option in tree[1]:
                start = self.state()
                self.free[begin].append(start)
                self.free[self.add(option, start)].append(end)
            return end
        _, item, least, most = tree
        for _ in range(least):
            begin = self.add(item, begin)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[begin] += [loop, end]
            self.free[self.add(item, loop)] += [loop, end]
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[begin].append(end)
            begin = self.add(item, begin)
        self.free[begin].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``step[state * kinds + kind_of[byte]]`` is the next state; 0 is the first one.

    States from ``accepting`` on are those in which a match ends; ``rules[state]`` has a bit for
    each rule that it ends a match of. ``resets`` are the bytes that lead from any state to 0.
    """

    step: np.ndarray
    kind_of: np.ndarray
    kinds: int
    accepting: int
    rules: np.ndarray
    resets: np.ndarray


def compile_rules(patterns: list[str]) -> Automaton:
    """One automaton for a search of all patterns: subset construction, then minimisation."""
    net, starts, ends = _Net(), [], {}
    for bit, pattern in enumerate(patterns):
        start = net.state()
        starts.append(start)
        ends[net.add(_Parser(pattern).tree(), start)] = 1 << bit
    # Bytes that no pattern tells apart are of one kind.
    masks = sorted({mask for moves in net.moves for mask, _ in moves})
    names: dict[tuple, int] = {}
    kind_of = np.array(
        [names.setdefault(tuple(m >> b & 1 for m in masks), len(names)) for b in range(256)],
        np.uint8,
    )
    sample = [int(np.flatnonzero(kind_of == k)[0]) for k in range(len(names))]

    closures: dict[int, frozenset] = {}

    def closure(state: int) -> frozenset:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for after in net.free[todo.pop()]:
                    if after not in seen:
                        seen.add(after)
                        todo.append(after)
            # Only states that move or end a match tell sets apart.
            closures[state] = frozenset(s for s in seen if net.moves[s] or s in ends)
        return closures[state]

    moves = [
        [frozenset().union(*[closure(to) for mask, to in net.moves[s] if mask >> b & 1]) for b in sample]
        for s in range(len(net.moves))
    ]
    first = frozenset().union(*map(closure, starts))
    found, table, place = {first: 0}, [], [first]
    while len(table) < len(place):
        now, row = place[len(table)], []
        for k in range(len(sample)):
            after = first.union(*[moves[s][k] for s in now])
            if after not in found:
                found[after] = len(place)
                place.append(after)
            row.append(found[after])
        table.append(row)
    step = np.array(table)
    rules = np.array([sum({ends[s] for s in states if s in ends}) for states in place])

    # Minimisation: split states until those of one part have the same moves between parts.
    part = np.unique(rules, return_inverse=True)[1]
    while True:
        shape = np.column_stack([part, part[step]])
        after = np.unique(shape, axis=0, return_inverse=True)[1].ravel()
        if after.max() == part.max():
            break
        part = after
    count = int(part.max()) + 1
    one = np.zeros(count, int)
    one[part[::-1]] = np.arange(len(part))[::-1]
    # The first state is 0, those that end matches come last.
    order = sorted(range(count), key=lambda p: (rules[one[p]] > 0, p != part[0]))
    number = np.empty(count, int)
    number[order] = np.arange(count)
    kept = one[order]
    small = number[part[step[kept]]]
    resets = np.array([(small[:, kind_of[b]] == 0).all() for b in range(256)])
    return Automaton(
        step=small.astype(np.int32).ravel(),
        kind_of=kind_of,
        kinds=len(sample),
        accepting=int((rules[kept] == 0).sum()),
        rules=rules[kept],
        resets=resets,
    )
