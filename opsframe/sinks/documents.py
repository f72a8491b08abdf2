"""JSON sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from opsframe.functions import overlaid
from opsframe.operators.ordering import chunk_rows
from opsframe.operators.policies import ROLE_PAGE_SIZE
from opsframe.schemas import DOCUMENT


def _by_place(a: Column, b: Column) -> Column:
    """Compare by place alone: documents may hold maps, which have no order."""
    before, after = a["place"] < b["place"], a["place"] > b["place"]
    return F.when(before, -1).when(after, 1).otherwise(0)


def write_documents_json(
    df: DataFrame,
    path: str,
    envelope: str | None = None,
    order: Sequence[str] = ("ord",),
    page_size: int = ROLE_PAGE_SIZE,
    mode: str = "error",
) -> None:
    """One document per line, nulls kept; or pages ``{envelope: [..]}``, one per line.

    A page holds at most ``page_size`` documents, so that no task has to hold them all. The
    ``order`` columns place the documents and are not written. Where a scan left the whole document
    in ``doc``, that is written, with the other columns in the places of their names; fields that
    are null, and that the document never had, are not added.
    """
    columns = [c for c in df.columns if c not in order]
    fields = [f for f in df.schema.fields if f.name in columns and f.name != DOCUMENT]
    whole = DOCUMENT in columns
    doc = F.struct(*[f.name for f in fields]) if fields else F.col(DOCUMENT)
    if whole and fields:
        doc = overlaid(F.col(DOCUMENT), doc, StructType(fields))
    if envelope is None:
        if whole:
            df.select(F.to_json(doc).alias("value")).write.mode(mode).text(path)
        else:
            df.select(*columns).write.mode(mode).json(path, ignoreNullFields=False)
        return
    pages = chunk_rows(df, page_size, list(order)).groupBy("chunk_id")
    place = F.struct(*order).alias("place")
    page = F.array_sort(F.collect_list(F.struct(place, doc.alias("doc"))), _by_place)
    out = pages.agg(F.transform(page, lambda p: p["doc"]).alias(envelope)).select(envelope)
    out.write.mode(mode).json(path, ignoreNullFields=False)


def write_summary_json(
    per_user: DataFrame,
    per_hour: DataFrame,
    meta: Mapping[str, int],
    path: str,
    mode: str = "error",
) -> None:
    """The sections ``per_user`` and ``per_hour`` as JSON lines below ``path``, ``meta`` beside.

    The layout is the same for any number of users and hours, so no task holds a section whole.
    """
    per_user.write.mode(mode).json(f"{path}/per_user")
    per_hour.write.mode(mode).json(f"{path}/per_hour")
    values = [F.lit(value).alias(name) for name, value in meta.items()]
    per_user.sparkSession.range(1).select(*values).write.mode(mode).json(f"{path}/meta")
