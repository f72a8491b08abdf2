"""Set-like functions on array columns."""

from pyspark.sql import Column, functions as F


def _list(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def sorted_distinct(col: Column) -> Column:
    return F.array_sort(F.array_distinct(col))


def array_union_sorted(a: Column, b: Column) -> Column:
    """Sorted union without duplicates; a missing list counts as empty."""
    return F.array_sort(F.array_union(_list(a), _list(b)))


def missing_items(wanted: Column, have: Column) -> Column:
    """Distinct items of ``wanted`` that ``have`` lacks, in the order of ``wanted``."""
    return F.array_except(_list(wanted), _list(have))


def same_set(a: Column, b: Column) -> Column:
    return sorted_distinct(_list(a)).eqNullSafe(sorted_distinct(_list(b)))


def map_documents(col: Column) -> Column:
    """The documents of a ``name -> document`` map."""
    return F.map_values(col)
