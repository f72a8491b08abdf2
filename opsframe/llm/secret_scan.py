"""Secrets in whole texts: one automaton for all rules passes over every byte once.

Rules become one minimal automaton. Its pass runs over many stretches of text in step, one numpy
operation for all of them; stretches begin behind bytes that take every state back to the first,
which no match can contain. Where the automaton ends a match, the rule's expression takes the
spans, leftmost first, from between two such bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from opsframe.llm.automaton import Automaton, compile_rules
from opsframe.llm.units import blocks, text_array

_BLOCK = 1 << 22
_LANES = 2048


@dataclass(frozen=True)
class Rule:
    """``pattern`` is scanned for by the automaton and must end wherever a kept match ends;
    ``exact`` gives the spans; a match counts if its ``group`` has ``least`` bytes or more."""

    kind: str
    pattern: str
    exact: bytes
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
_GITHUB = r"gh[opsur]_[A-Za-z0-9]+"
_SLACK = r"xox[abprs]-[A-Za-z0-9-]+"
_JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"

# Lengths are left to the exact expressions, but for hex: counters multiply the states.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", _ASSIGN, _ASSIGN.encode(), group=2, least=8),
    Rule("access", _ACCESS, _ACCESS.encode(), least=16),
    Rule("hex", r"[0-9a-f]{32,}", rb"[0-9a-f]+", least=32),
    Rule("github", _GITHUB, _GITHUB.encode(), least=24),
    Rule("slack", _SLACK, _SLACK.encode(), least=15),
    Rule("jwt", _JWT, _JWT.encode()),
    Rule("pem", _PEM, _PEM.encode()),
)
_LINE_END = (pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
)


def scan_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, spans) per row: kind, start and end of every match in code points, end exclusive.

    Spans of one rule are leftmost and don't overlap, those of different rules may; they come by
    start, then in the order of ``rules``. Empty and null texts have none. Rows are independent,
    so that repeated rows give equal results. Other columns are ignored. No rule may match a line
    feed.
    """
    automaton = compile_rules([rule.pattern for rule in rules])
    if not automaton.resets[10]:
        raise ValueError("a rule matches over line ends")
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scan(shared, rules),
        f"`{id_col}` {docs.schema[id_col].dataType.simpleString()},"
        " spans array<struct<kind string, start int, end int>>",
    )


def _scan(shared, rules):
    exact = [re.compile(rule.exact) for rule in rules]

    def run(batches):
        for batch in batches:
            # A line feed behind each text keeps its matches from the next one's.
            text = text_array(batch.column("text")).cast(pa.large_binary())
            text = pc.binary_join_element_wise(text, *_LINE_END)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for row, data, offsets in blocks(text, _BLOCK):
                for i, found in _matches(shared.value, rules, exact, data, offsets):
                    spans[row + i] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(spans, _SPANS)], names=["id", "spans"]
            )

    return run


def events(automaton: Automaton, data: np.ndarray, resets: np.ndarray) -> tuple:
    """(places, states) where matches end; ``resets`` are the places of bytes that reset."""
    wanted = np.arange(_LANES) * (len(data) // _LANES + 1)
    after = np.searchsorted(resets, wanted[wanted < len(data)])
    begins = np.unique(np.concatenate([[0], resets[after[after < len(resets)]] + 1]))
    begins = begins[begins < len(data)]
    lengths = np.diff(np.append(begins, len(data)))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    codes = automaton.kind_of[data]
    kinds, step, accepting = automaton.kinds, automaton.step, automaton.accepting
    scaled = (step * kinds).astype(np.int32)  # states times kinds save a multiplication
    open_lanes = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))
    state = np.zeros(len(begins), np.int32)
    limit, places, states = accepting * kinds, [], []
    for t, lanes in enumerate(open_lanes):
        at = begins[:lanes] + t
        state = scaled[state[:lanes] + codes[at]]
        if state.max() >= limit:
            hit = np.flatnonzero(state >= limit)
            places.append(at[hit])
            states.append(state[hit] // kinds)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(states)


def _matches(automaton, rules, exact, data, offsets) -> Iterator[tuple[int, list]]:
    """(text, spans) of the texts that have spans."""
    resets = np.flatnonzero(automaton.resets[data])
    places, states = events(automaton, data, resets)
    if not len(places):
        return
    # The stretch between two resetting bytes, and the rules that end there.
    stretch = np.searchsorted(resets, places)
    order = np.argsort(stretch, kind="stable")
    numbers, firsts = np.unique(stretch[order], return_index=True)
    bits = np.bitwise_or.reduceat(automaton.rules[states][order], firsts)
    found: dict[int, list] = {}
    for i, here in zip(numbers, bits):
        begin = int(resets[i - 1]) + 1 if i else 0
        end = int(resets[i]) if i < len(resets) else len(data)
        text = int(np.searchsorted(offsets, begin, "right")) - 1
        held = data[begin:end].tobytes()
        for n, rule in enumerate(rules):
            if here >> n & 1:
                for match in exact[n].finditer(held):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found.setdefault(text, []).append(
                            (begin + match.start(), n, begin + match.end())
                        )
    for text, spans in found.items():
        begin = offsets[text]
        # Code points before a byte: the bytes that don't continue one.
        before = np.concatenate([[0], np.cumsum((data[begin : offsets[text + 1]] & 0xC0) != 0x80)])
        yield text, [
            {"kind": rules[n].kind, "start": int(before[s - begin]), "end": int(before[e - begin])}
            for s, n, e in sorted(spans)
        ]
