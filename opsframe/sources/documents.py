"""JSON and CSV documents: policies, roles, grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from opsframe.schemas import DOCUMENT, POLICY_DDL, ROLE_DDL

#: Text that doesn't parse, or not as what it should be, is an error rather than no rows.
STRICT = {"mode": "FAILFAST"}


def _texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """One JSON text per file, or per line; with its place in the input."""
    return spark.read.text(path, wholetext=not lines).select(
        F.col("_metadata.file_path").alias("doc_file"),
        F.monotonically_increasing_id().alias("doc_row"),
        F.trim("value").alias("text"),
    ).where("text <> ''")


def _is_list(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n")).startswith("[")


def _has_key(text: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def _members(text: Column, key: str, kind: str) -> Column:
    return F.from_json(text, f"`{key}` ARRAY<{kind}>", STRICT)[key]


def _list_of(text: Column, kind: str) -> Column:
    return F.from_json(text, f"ARRAY<{kind}>", STRICT)


def _struct(ddl: str) -> str:
    if DOCUMENT in StructType.fromDDL(ddl).names:
        raise ValueError(f"the column {DOCUMENT!r} holds the whole document")
    return f"STRUCT<{ddl}>"


def _pairs(typed: Column, whole: Column) -> Column:
    """Typed documents beside the whole ones."""
    return F.arrays_zip(typed.alias("typed"), whole.alias("whole"))


def _rows(texts: DataFrame, pairs: Column) -> DataFrame:
    return texts.select("doc_file", "doc_row", F.posexplode(pairs).alias("doc_pos", "pair")).select(
        "pair.typed.*",
        F.col("pair.whole").alias(DOCUMENT),
        F.struct("doc_file", "doc_row", "doc_pos").alias("ord"),
    )


def _missing(problem: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{problem} in "), "doc_file"))


def scan_documents(
    spark: SparkSession, path: str, ddl: str = ROLE_DDL, lines: bool = False
) -> DataFrame:
    """Documents below ``vList``, else below ``roles``, else of a top-level list.

    The first of the three that is present counts, even when it is empty; a text with none of
    them is an error. ``doc`` is the whole document, with all fields that ``ddl`` does not name;
    ``ord`` keeps the input order. ``lines`` reads one envelope per line, which lets Spark split
    the file.
    """
    texts = _texts(spark, path, lines)
    text = F.col("text")

    def found(kind: str) -> Column:
        return (
            F.when(_is_list(text), _list_of(text, kind))
            .when(_has_key(text, "vList"), _members(text, "vList", kind))
            .when(_has_key(text, "roles"), _members(text, "roles", kind))
            .otherwise(_missing("no document list"))
        )

    return _rows(texts, _pairs(found(_struct(ddl)), found("VARIANT")))


def scan_document_pages(spark: SparkSession, path: str, ddl: str = ROLE_DDL) -> DataFrame:
    """Documents of many pages, one ``{vList: [..]}`` or list per line; empty pages add nothing.

    A page with other fields but without that list is an error. ``doc`` and ``ord`` are as in ``scan_documents``.
    """
    texts = _texts(spark, path, lines=True)
    text = F.col("text")

    def found(kind: str) -> Column:
        return (
            F.when(_is_list(text), _list_of(text, kind))
            .when(_has_key(text, "vList"), _members(text, "vList", kind))
            .when(F.size(F.json_object_keys(text)) > 0, _missing("no document list"))
        )

    return _rows(texts, _pairs(found(_struct(ddl)), found("VARIANT")))


def scan_policy_list(
    spark: SparkSession, path: str, ddl: str = POLICY_DDL, lines: bool = False
) -> DataFrame:
    """A JSON list of policies as rows; anything but a list is an error.

    ``doc`` and ``ord`` are as in ``scan_documents``. ``lines`` reads one policy per line, the
    splittable form that the sink writes.
    """
    texts = _texts(spark, path, lines)
    text = F.col("text")

    def found(kind: str) -> Column:
        if lines:
            # Wrapped, as a text alone can be read as a VARIANT only without the strict mode.
            return _list_of(F.concat(F.lit("["), text, F.lit("]")), kind)
        not_list = _missing("expected a list at the top")
        return F.when(_is_list(text), _list_of(text, kind)).otherwise(not_list)

    return _rows(texts, _pairs(found(_struct(ddl)), found("VARIANT")))


def scan_policy_map(
    spark: SparkSession, path: str, ddl: str = POLICY_DDL, lines: bool = False
) -> DataFrame:
    """The values of a JSON object; a repeated key keeps its first place and its last value.

    ``doc`` and ``ord`` are as in ``scan_documents``. ``lines`` reads one object per line.
    """
    texts = _texts(spark, path, lines)

    def found(kind: str) -> Column:
        return F.map_entries(F.from_json("text", f"MAP<STRING, {kind}>", STRICT))

    entry = F.posexplode(_pairs(found(_struct(ddl)), found("VARIANT"))).alias("doc_pos", "pair")
    return (
        texts.select("doc_file", "doc_row", entry)
        .groupBy("doc_file", "doc_row", F.col("pair.typed.key").alias("doc_key"))
        .agg(F.max_by("pair", "doc_pos").alias("pair"), F.min("doc_pos").alias("doc_pos"))
        .select(
            "pair.typed.value.*",
            F.col("pair.whole.value").alias(DOCUMENT),
            F.struct("doc_file", "doc_row", "doc_pos").alias("ord"),
        )
    )


def scan_grants_csv(spark: SparkSession, path: str) -> DataFrame:
    """Grants from a headered CSV, found by column name; ``row_no`` sorts as the rows came."""
    return spark.read.csv(path, header=True).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("row_no"),
        "policy_name",
        "group_name",
        "permissions",
    )
