"""Column functions; all of them stay inside whole-stage codegen or the JVM."""

from opsframe.functions.arrays import (
    array_union_sorted,
    map_documents,
    missing_items,
    same_set,
    sorted_distinct,
)
from opsframe.functions.keys import (
    basename,
    build_key,
    is_password_key,
    parse_object_key,
    relative_key,
)
from opsframe.functions.text import (
    compact_date,
    count_union_all,
    normalize_service_name,
    parse_permissions,
    split_part,
    strip_ws,
    truncate_query,
)
from opsframe.functions.times import (
    epoch_ms_cutoff,
    hour_key,
    iso_ts,
    parse_log_timestamp,
    zone_free,
)
from opsframe.functions.values import (
    default_to,
    expected_pages,
    flag,
    mask_secret,
    ms_to_s,
    number,
    pct,
)
from opsframe.functions.variants import overlaid, without_field

__all__ = [
    "array_union_sorted",
    "basename",
    "build_key",
    "compact_date",
    "count_union_all",
    "default_to",
    "epoch_ms_cutoff",
    "expected_pages",
    "flag",
    "hour_key",
    "is_password_key",
    "iso_ts",
    "map_documents",
    "mask_secret",
    "missing_items",
    "ms_to_s",
    "normalize_service_name",
    "number",
    "overlaid",
    "parse_log_timestamp",
    "parse_object_key",
    "parse_permissions",
    "pct",
    "relative_key",
    "same_set",
    "sorted_distinct",
    "split_part",
    "strip_ws",
    "truncate_query",
    "without_field",
    "zone_free",
]
