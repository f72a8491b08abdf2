"""A quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning: the risk of calling text bad is estimated on unlabelled text, less
what the positives among it contribute, and is kept from going below zero (the non-negative
estimator). With logistic loss the learned score is the probability of being good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsframe.llm.language_id import held_out
from opsframe.llm.units import LOWER, SPACES, blocks, prefix_sums, raw, span_hash, words

#: The classifier is fitted on at most so many rows of each kind, chosen by a hash of the id.
SAMPLE = 12_000
#: A text counts as good from this score on.
THRESHOLD = 0.3

_PAIRS = 256
_SHAPES = 24
FEATURES = _PAIRS + _SHAPES

_KIND = np.zeros(256, np.uint8)  # 0 mark, 1 lower, 2 upper, 3 digit, 4 space, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[SPACES] = 4


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, held_out, score, predicted) per row, and the columns ``keep`` of ``docs`` as ``_`` and
    their name.

    Positives are texts whose label is 1, the unlabelled are texts of any kind; both come from the
    folds that aren't held out, at most ``sample`` of each. The class prior is the part of labels
    that are 1 in these folds. An id with several labels counts with the greatest. Every row is
    scored by its whole text; a null text counts as empty. Where there is no positive or no
    unlabelled text, every score is the prior (0.5 without labels). Repeated rows are scored alike.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    prior = 0.5 if prior is None else float(prior)
    order = F.xxhash64("id", F.lit(41))
    open_ids = texts.select("id").where(F.col("id").isNotNull() & ~held_out("id"))
    chosen = (
        known.where("label = 1").select("id").orderBy(order, "id").limit(sample).withColumn("y", F.lit(1))
    ).unionByName(open_ids.orderBy(F.xxhash64("id", F.lit(43)), "id").limit(sample).withColumn("y", F.lit(0)))
    rows = (
        texts.join(F.broadcast(chosen), "id")
        .select("y", "text")
        .mapInArrow(_described(("y",)), "y int, features binary")
        .toArrow()
    )
    kinds = rows.column("y").to_numpy()
    data, _ = raw(rows.column("features"))
    model = _fit(data.view(np.float32).reshape(-1, FEATURES), kinds, prior)
    del rows, data
    model = spark.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    shape = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    scored = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept
    ).mapInArrow(
        _scored(model, [f"k{i}" for i in range(len(keep))]),
        "id long, score double" + (", " + shape if keep else ""),
    )
    return scored.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *[F.col(f"k{i}").alias(f"_{c}") for i, c in enumerate(keep)],
    )


def features(column) -> Iterator[np.ndarray]:
    """One row of numbers per text, block by block: its shape, and which byte pairs it is made of."""
    for _, data, offsets in blocks(column):
        yield _block_features(data, offsets)


def _block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1).astype(np.float64)

    def total(values) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out = np.zeros((texts, FEATURES), np.float32)
    owner = np.repeat(np.arange(texts), size)
    kind = _KIND[data]
    shares = np.bincount(owner * 6 + kind, minlength=texts * 6).reshape(texts, 6) / some[:, None]
    pair = np.zeros(len(data), np.int64)
    low = LOWER[data].astype(np.int64)
    pair[1:] = (low[:-1] * 31 + low[1:]) * 2654435761 >> 8 & (_PAIRS - 1)
    # A text's first byte has no pair: the byte before it is another text's.
    inside = np.ones(len(data), bool)
    inside[offsets[:-1][size > 0]] = False
    held = np.bincount((owner * _PAIRS + pair)[inside], minlength=texts * _PAIRS)
    out[:, _SHAPES:] = np.sqrt(held.reshape(texts, _PAIRS) / some[:, None])

    begins, ends, first = words(data, offsets)
    number = np.diff(first)
    word_of = np.repeat(np.arange(texts), number)
    many = np.maximum(number, 1).astype(np.float64)
    sums = prefix_sums(data)
    hashes = span_hash(sums, begins, ends)
    order = np.lexsort((hashes, word_of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
    distinct = np.bincount(word_of[order][new], minlength=texts)
    run = np.diff(np.append(np.flatnonzero(new), len(new)))
    common = np.zeros(texts)
    if len(run):
        np.maximum.at(common, word_of[order][new], run)
    again = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
    again = np.bincount(word_of[1:], again * 1.0, minlength=texts) if len(begins) else np.zeros(texts)
    length = np.bincount(word_of, ends - begins, minlength=texts) / many
    upper = (kind[begins] == 2) if len(begins) else np.zeros(0)
    last = kind[ends - 1] if len(ends) else np.zeros(0)
    shout = np.bincount(word_of, (upper & (last == 2)) * 1.0, minlength=texts) if len(begins) else np.zeros(texts)
    mark = np.bincount(word_of, (last == 0) * 1.0, minlength=texts) if len(begins) else np.zeros(texts)

    # Lines: how many repeat one of the same text, and how long they are.
    breaks = np.zeros(256, bool)
    breaks[10] = True
    line_begin, line_end, line_first = words(data, offsets, breaks)
    lines = np.diff(line_first)
    line_of = np.repeat(np.arange(texts), lines)
    line_hash = span_hash(sums, line_begin, line_end)
    order = np.lexsort((line_hash, line_of))
    new = np.ones(len(order), bool)
    new[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct_lines = np.bincount(line_of[order][new], minlength=texts)
    several = np.maximum(lines, 1).astype(np.float64)

    marks = [total(data == ord(c)) / some for c in "!#$%&*|"]
    shape = [
        *shares.T,
        np.log1p(size),
        np.log1p(number),
        distinct / many,
        common / many,
        again / many,
        np.sqrt(again / many),
        length / 10,
        shout / many,
        mark / many,
        distinct_lines / several,
        np.log1p(size / several),
        *marks,
    ]
    out[:, : len(shape)] = np.array(shape).T
    return out


def _described(kept: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            found = [x for block in features(batch.column("text")) for x in block]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([x.tobytes() for x in found], pa.binary())],
                names=[*kept, "features"],
            )

    return run


def _fit(x: np.ndarray, kinds: np.ndarray, prior: float, rounds: int = 60, seed: int = 7) -> dict:
    """A linear model on standardised features, by non-negative risk and logistic loss."""
    model = {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w": np.zeros(FEATURES)}
    model["b"] = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not (kinds == 1).any() or not (kinds == 0).any() or not 0 < prior < 1:
        return model
    # In an order of their own values, so that the fit doesn't depend on how Spark dealt the rows.
    # The driver holds the sample twice at most, in single precision.
    x = x[np.lexsort((*x[:, :_SHAPES].T, kinds))]
    count = int((kinds == 0).sum())
    model["mean"] = x.mean(axis=0, dtype=np.float64)
    model["scale"] = x.std(axis=0, dtype=np.float64) + 1e-3
    for part in np.array_split(x, 64):
        part -= model["mean"].astype(np.float32)
        part /= model["scale"].astype(np.float32)
        np.clip(part, -8, 8, out=part)
    unlabelled, positive = x[:count], x[count:]
    w, b = model["w"], model["b"]
    first, second = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    rng = np.random.default_rng(seed)
    step, size, decay, rate = 0, 512, 1e-4, 0.02
    for turn in range(rounds):
        p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for i in range(max(1, min(len(p), len(u)) // size)):
            xp = positive[np.take(p, range(i * size, (i + 1) * size), mode="wrap")]
            xu = unlabelled[np.take(u, range(i * size, (i + 1) * size), mode="wrap")]
            sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
            # loss(+) = -log s, loss(-) = -log(1 - s); their slopes are s - 1 and s.
            bad = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean()
            bad += prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
            g_bad = _slope(xu, su) - prior * _slope(xp, sp)
            g = prior * _slope(xp, sp - 1) + g_bad if bad >= 0 else -g_bad
            g[:-1] += decay * w
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            now = rate * (1 - turn / rounds)
            w, b = w - now * move[:-1], b - now * move[-1]
    model["w"], model["b"] = w, float(b)
    return model


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _slope(x: np.ndarray, each: np.ndarray) -> np.ndarray:
    return np.append(x.T @ each, each.sum()) / len(x)


def _scored(model, kept: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            scores = [np.zeros(0)]
            for x in features(batch.column("text")):
                x = np.clip((x - m["mean"]) / m["scale"], -8, 8)
                scores.append(_sigmoid(x @ m["w"] + m["b"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate(scores)), *(batch.column(c) for c in kept)],
                names=["id", "score", *kept],
            )

    return run
