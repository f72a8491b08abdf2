"""Named count vectors, filled by tasks and summed by Spark in parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "name string, part int, counts binary"
_PART = 1 << 13


def parts(tallies: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's vectors as rows of one part each; parts without a count are left out."""
    for name, vector in tallies.items():
        cut = [vector[i : i + _PART].astype(np.int64) for i in range(0, len(vector), _PART)]
        rows = [(i, x.tobytes()) for i, x in enumerate(cut) if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows)),
                    pa.array([i for i, _ in rows], pa.int32()),
                    pa.array([x for _, x in rows], pa.binary()),
                ],
                names=["name", "part", "counts"],
            )


def summed(df: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The sums of all tasks by name: ``size`` numbers for each name come to the driver."""

    def run(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for name, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(counts, np.int64)
                at = (name, part)
                totals[at] = totals[at] + values if at in totals else values
        for (name, part), values in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([part], pa.int32()),
                    pa.array([values.tobytes()], pa.binary()),
                ],
                names=["name", "part", "counts"],
            )

    result: dict[str, np.ndarray] = {}
    for row in df.repartition("name", "part").mapInArrow(run, SCHEMA).collect():
        vector = result.setdefault(row["name"], np.zeros(size, np.int64))
        values = np.frombuffer(row["counts"], np.int64)
        vector[row["part"] * _PART : row["part"] * _PART + len(values)] = values
    return result
