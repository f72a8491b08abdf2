"""Functions on object keys (``/``-separated paths) and on configuration keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which part of a key is the date folder, from how many parts on a key names
# one, and from how many parts on an object lies inside the folder.
LAYOUTS = {
    "flat": {"folder_part": 1, "min_parts": 3, "inside_parts": 3},
    "clustered": {"folder_part": 3, "min_parts": 4, "inside_parts": 5},
}
DATE_FOLDER_PATTERN = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"

def layout_of(name: str) -> dict[str, int]:
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}, expected one of {sorted(LAYOUTS)}")
    return LAYOUTS[name]


def parse_object_key(key: Column, layout: str = "flat") -> Column:
    """``struct<folder, folder_ts, n_parts>``; folder and time are null where no date folder is."""
    spec = layout_of(layout)
    parts = F.split(key, "/")
    n_parts = F.size(parts)
    name = F.when(n_parts >= spec["min_parts"], F.get(parts, F.lit(spec["folder_part"])))
    day = F.when(name.rlike(DATE_FOLDER_PATTERN), name.try_cast("date"))
    return F.struct(
        F.when(day.isNotNull(), name).alias("folder"),
        day.cast("timestamp_ntz").alias("folder_ts"),
        n_parts.alias("n_parts"),
    )


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def relative_key(key: Column, prefix: str) -> Column:
    """What follows ``prefix``; null for keys outside it."""
    return F.when(key.startswith(prefix), F.substr(key, F.lit(len(prefix) + 1)))


def build_key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def is_password_key(col: Column, wide: bool = True) -> Column:
    """Keystore passwords and, when ``wide``, private-key passwords; in any case."""
    key = F.lower(col)
    subject = key.contains("keystore")
    if wide:
        subject = subject | key.contains("private_key")
    return F.coalesce(subject & key.contains("password"), F.lit(False))
