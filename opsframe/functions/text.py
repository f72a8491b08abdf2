"""String functions."""

from pyspark.sql import Column, functions as F

# Whitespace as stripped from log fields, the truncation mark, the
# permission letters and the patterns that must match the same text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TRUNCATION_MARK = " --[TRUNCATED]"
PERMISSIONS = {"r": "read", "w": "write", "x": "execute"}
UNION_ALL_PATTERN = r"(?iU)\bUNION[\s\x1c-\x1f]+ALL\b"
SERVICE_SUFFIX_PATTERN = r"[-_]\d+$"


def strip_ws(col: Column) -> Column:
    """Strip all Unicode whitespace at both ends (``trim`` alone strips blanks only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def truncate_query(query: Column, n: int = 20000) -> Column:
    """The first ``n`` characters and a mark, when the text is longer than ``n``."""
    cut = F.concat(F.substring(query, 1, n), F.lit(TRUNCATION_MARK))
    return F.when(F.length(query) > n, cut).otherwise(query)


def count_union_all(query: Column) -> Column:
    """Number of whole-word UNION ALL in any case, words apart by any whitespace."""
    return F.regexp_count(query, F.lit(UNION_ALL_PATTERN))


def split_part(col: Column, delimiter: str, part: int) -> Column:
    """The 1-based part; the whole text when the delimiter does not occur."""
    return F.split_part(col, F.lit(delimiter), F.lit(part))


def parse_permissions(col: Column) -> Column:
    """``'rwx'`` as ``['read', 'write', 'execute']``; other letters are left out."""
    names = F.create_map(*[F.lit(x) for pair in PERMISSIONS.items() for x in pair])
    letters = F.filter(F.split(col, ""), lambda c: c.isin(*PERMISSIONS))
    return F.transform(letters, lambda c: names[c])


def normalize_service_name(col: Column) -> Column:
    """Lower case without a trailing ``-1`` or ``_1``."""
    return F.lower(F.regexp_replace(col, SERVICE_SUFFIX_PATTERN, ""))


def compact_date(col: Column) -> Column:
    """``2024-01-31`` as ``20240131``."""
    return F.replace(col, F.lit("-"), F.lit(""))
