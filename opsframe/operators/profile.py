"""Dataset profile: string columns and their longest values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from opsframe.operators.ordering import sample_rows, top_k

SAMPLE_FRACTION = 0.01
TOP_COLUMNS = 5


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_summary(df: DataFrame) -> dict[str, int]:
    """Number of columns and of string columns, from the schema alone."""
    return {"total_columns": len(df.columns), "string_columns": len(string_columns(df))}


def max_string_lengths(
    df: DataFrame, fraction: float | None = None, seed: int = 0, k: int | None = TOP_COLUMNS
) -> DataFrame:
    """``column, max_len`` of the ``k`` longest string columns, in one pass over the data.

    ``max_len`` is null for a column without values. ``fraction`` takes a sample of the rows.
    """
    names = string_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column STRING, max_len INT")
    if fraction is not None:
        df = sample_rows(df, fraction, seed=seed)
    longest = df.agg(
        *[F.max(F.length(F.col(f"`{name}`"))).alias(f"_{i}") for i, name in enumerate(names)]
    )
    pairs = [
        F.struct(F.lit(name).alias("column"), F.col(f"_{i}").alias("max_len"))
        for i, name in enumerate(names)
    ]
    rows = longest.select(F.inline(F.array(*pairs)))
    return rows if k is None else top_k(rows, k, F.desc_nulls_last("max_len"), F.asc("column"))


def dataset_profile(df: DataFrame, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Every string column with its longest value, next to the column counts."""
    counts = {name: F.lit(n).cast("bigint") for name, n in column_summary(df).items()}
    return max_string_lengths(df, fraction, seed, k=None).withColumns(counts)
