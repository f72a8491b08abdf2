"""Language identification by multinomial naive Bayes on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsframe.llm import tallies
from opsframe.llm.units import blocks

FEATURES = 1 << 16
LENGTHS = (1, 2, 3)
FOLDS = 5

_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SHIFT = np.uint32(32 - (FEATURES.bit_length() - 1))


def held_out(id_col: str) -> Column:
    """Whether a document's fold is the one that nothing is learned from; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    smoothing: float = 0.5,
) -> DataFrame:
    """(id, held_out, lang_pred, score) per row.

    Learns from the text and language of the rows that have both, an id, and a fold other than the
    held-out one; every whole text is counted. ``score`` is the probability of the language
    predicted. A text that is null or has no letter is ``und`` with score 0, as is every text
    where there is nothing to learn from. Languages with equal scores: the first by code point.
    Repeated rows count each time. Other columns are ignored. What is broadcast is one vector of
    log-probabilities per language.
    """
    learned = docs.where(
        F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull()
    )
    learned = learned.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = tallies.summed(
        learned.where("text is not null").mapInArrow(_count, tallies.SCHEMA), FEATURES + 1
    )
    langs = sorted(counts, key=lambda x: x.encode())
    # The last count is the number of texts, which gives the prior.
    table = np.array([counts[x] for x in langs], np.float64).reshape(len(langs), FEATURES + 1)
    grams = table[:, :FEATURES] + smoothing
    weights = np.log(grams / grams.sum(axis=1, keepdims=True))
    prior = np.log(table[:, FEATURES] / max(table[:, FEATURES].sum(), 1))
    model = docs.sparkSession.sparkContext.broadcast((langs, weights, prior))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        held_out(id_col).alias("held_out"),
        F.col(text_col).alias("text"),
    ).mapInArrow(
        _predict(model), f"`{id_col}` long, held_out boolean, lang_pred string, score double"
    )


def _lower_table() -> np.ndarray:
    """Code point to lower-case code point, for the characters whose lower case is one of them."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1 and ord(low) < 0x10000:
            table[c] = ord(low)
    return table


_LOWER: list[np.ndarray] = []


def _features(column) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], bytes, np.ndarray]]:
    """(first row, where each text's characters begin, features by length, bytes, offsets)."""
    if not _LOWER:
        _LOWER.append(_lower_table())
    for row, data, offsets in blocks(column):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        points = np.where(points < 0x10000, _LOWER[0][np.minimum(points, 0xFFFF)], points)
        features, total = [], None
        for length in range(1, max(LENGTHS) + 1):
            term = points[length - 1 :] * _FACTORS[length - 1]
            if total is None:
                total = term
            else:
                total = total[: len(term)]
                total = (total << np.uint32(5) | total >> np.uint32(27)) + term
            if length in LENGTHS:
                features.append(((total ^ total >> np.uint32(15)) * _FACTORS[0]) >> _SHIFT)
        yield row, begins, features, data, offsets


def _spans(begins: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each text's n-grams: those that don't reach into the next text."""
    first = np.minimum(begins[:-1], n)
    return first, np.maximum(np.minimum(begins[1:] - length + 1, n), first)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, begins, features, _, offsets in _features(batch.column("text")):
            texts = len(offsets) - 1
            here = np.array(langs[row : row + texts], object)
            names, which = np.unique(here.astype(str), return_inverse=True)
            for i, name in enumerate(names):
                vector = counts.setdefault(str(name), np.zeros(FEATURES + 1, np.int64))
                vector[FEATURES] += int((which == i).sum())
            for length, found in zip(LENGTHS, features):
                first, end = _spans(begins, len(found), length)
                # The language of each n-gram; those across two texts go to none.
                owner = np.full(len(found) + 1, len(names))
                lengths = end - first
                at = np.repeat(first - np.cumsum(lengths) + lengths, lengths)
                owner[at + np.arange(lengths.sum())] = np.repeat(which, lengths)
                for i, name in enumerate(names):
                    counts[str(name)][:FEATURES] += np.bincount(
                        found[owner[:-1] == i], minlength=FEATURES
                    )
    yield from tallies.parts(counts)


def _predict(model):
    def run(batches):
        langs, weights, prior = model.value
        for batch in batches:
            texts = batch.column("text")
            scores = np.zeros((batch.num_rows, len(langs)))
            letters = np.zeros(batch.num_rows, bool)
            for row, begins, features, data, offsets in _features(texts):
                rows = slice(row, row + len(offsets) - 1)
                scores[rows] = prior
                for length, found in zip(LENGTHS, features):
                    first, end = _spans(begins, len(found), length)
                    for i in range(len(langs)):
                        sums = np.concatenate([[0.0], np.cumsum(weights[i][found])])
                        scores[rows, i] += sums[end] - sums[first]
                letters[rows] = _has_letter(data, offsets)
            best = scores.argmax(axis=1) if langs else np.zeros(batch.num_rows, int)
            known = letters & bool(langs)
            score = np.zeros(batch.num_rows)
            if langs:
                top = scores[np.arange(batch.num_rows), best]
                score = np.where(known, 1 / np.exp(scores - top[:, None]).sum(axis=1), 0.0)
            names = [langs[i] if ok else "und" for i, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return run


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (((data | 32) - 97).astype(np.uint8) < 26) & (data < 128)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(map(str.isalpha, text))
    return found
