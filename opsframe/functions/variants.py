"""Whole JSON documents as VARIANT, edited along the paths that typed columns name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_OBJECT = "map<string,variant>"
_LIST = "array<variant>"
_NESTED = (ArrayType, MapType, StructType)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _null() -> Column:
    """The JSON null, which is a value."""
    return F.parse_json(F.lit("null"))


def _members(doc: Column) -> Column:
    """The fields of an object; none where it is anything else."""
    none = F.from_json(F.lit("{}"), _OBJECT)
    return F.coalesce(F.try_variant_get(doc, "$", _OBJECT), none)


def without_field(doc: Column, name: str) -> Column:
    """The document without a field at its top."""
    return F.to_variant_object(F.map_filter(_members(doc), lambda key, _: key != name))


def overlaid(doc: Column, value: Column, kind: DataType) -> Column:
    """The document with a typed value of it written back; what the type does not name stays.

    Fields of structs go to the fields of their name, items of lists to the items of their place,
    entries of maps to the entries of their key; lists and maps get the length of the typed ones.
    A null field is left out if the document has none, and is a JSON null if it has one. Values
    that are equal to the document's are kept as they are written there.
    """
    if isinstance(kind, StructType):
        changed = _let(_members(doc), lambda held: _overlaid_fields(held, value, kind))
    elif isinstance(kind, MapType):
        changed = _let(
            _members(doc),
            lambda held: F.to_variant_object(
                F.transform_values(
                    value,
                    lambda key, v: _let(
                        F.try_element_at(held, key), lambda old: overlaid(old, v, kind.valueType)
                    ),
                )
            ),
        )
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, _NESTED):
        changed = _let(
            F.try_variant_get(doc, "$", _LIST),
            lambda held: F.to_variant_object(
                F.transform(
                    value,
                    lambda v, i: _let(
                        F.get(held, i), lambda old: overlaid(old, v, kind.elementType)
                    ),
                )
            ),
        )
    else:
        same = F.try_variant_get(doc, "$", kind.simpleString()).eqNullSafe(value)
        changed = F.when(same, doc).otherwise(value.cast("variant"))
    return F.when(value.isNull(), _null()).otherwise(changed)


def _overlaid_fields(held: Column, value: Column, kind: StructType) -> Column:
    def entry(field) -> Column:
        part = value[field.name]
        new = _let(
            F.try_element_at(held, F.lit(field.name)),
            lambda old: F.when(part.isNotNull() | old.isNotNull(), overlaid(old, part, field.dataType)),
        )
        return F.struct(F.lit(field.name).alias("key"), new.alias("value"))

    entries = F.filter(F.array(*map(entry, kind.fields)), lambda e: e["value"].isNotNull())
    others = F.map_filter(held, lambda key, _: ~key.isin(kind.names))
    return F.to_variant_object(F.map_concat(others, F.map_from_entries(entries)))
