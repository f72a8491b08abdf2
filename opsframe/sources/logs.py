"""Log files as lines that keep their global order.

A line's place is ``(file_rank, block, line_no)``: the place of its file's argument in the list
with the file's path, the offset of the split it was read from, and an id that grows inside the
split. Only the order of ``line_no`` means something, and only inside one ``(file_rank, block)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REPLACEMENT = "\ufffd"
_GLOB = re.compile(r"[*?\[{]")


def _text(value: Column) -> Column:
    """The line without bytes that are no UTF-8."""
    repaired = F.replace(F.make_valid_utf8(value), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(repaired)


def _full_path(spark: SparkSession, path: str) -> str:
    """The path of a file or folder name without scheme and host, from the root."""
    if not urlparse(path).path.startswith("/"):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        path = hadoop.getFileSystem(conf).makeQualified(hadoop).toUri().getPath()
    else:
        path = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path)
    return path.rstrip("/") or "/"


def _pattern(path: str) -> str:
    """A file name pattern as an expression over paths; what it matches may be a folder."""
    rules = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    parts = re.findall(r"\\.|\[[^\]]*\]|[*?{},]|[^\\\[*?{},]+", path)
    in_braces, out = 0, []
    for part in parts:
        in_braces += (part == "{") - (part == "}")
        if part.startswith("["):
            out.append(part.replace("[^", "[^/"))
        elif part.startswith("\\"):
            out.append(re.escape(part[1:]))
        elif part in rules and (part != "," or in_braces):
            out.append(rules[part])
        else:
            out.append(re.escape(part))
    return f"^{''.join(out)}(/.*)?$"


def _argument(spark: SparkSession, paths: list[str], file: Column) -> Column:
    """The place in the argument list of the argument that a file was read for: its own name, the
    nearest folder above it, or the first pattern that matches."""
    full = [_full_path(spark, p) for p in paths]
    plain = {p: i for i, p in enumerate(full) if not _GLOB.search(p)}
    place = F.lit(None).cast("int")
    if plain:
        table = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
        parts = F.split(file, "/")
        depths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
        above = F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        named = F.transform(above, lambda p: F.try_element_at(table, F.when(p == "", "/").otherwise(p)))
        place = F.get(F.filter(named, lambda i: i.isNotNull()), F.lit(0))
    for i, path in enumerate(full):
        if _GLOB.search(path):
            place = F.when(place.isNull() & file.rlike(_pattern(path)), i).otherwise(place)
    return place


def scan_log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of plain or ``.gz`` logs: ``file_rank, block, line_no, line, source_log``.

    Files rank in argument order; those of one folder or pattern rank by path. The rank is worked
    out from a file's own name, so that nothing has to list or number the files. ``source_log`` is
    a plain file's name as given, for others the name that was found.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths or len(set(paths)) < len(paths):
        raise ValueError("log paths must be given, each of them once")
    # A filter on lines moves below all that is worked out from the file's name.
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        _text(F.col("value")).alias("line"),
    )
    uri = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(uri, r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "")
    lines = lines.select("*", uri.alias("uri"), path.alias("path"))
    lines = lines.withColumn("argument", _argument(spark, paths, F.col("path")))
    given = F.get(F.array(*[F.lit(p) for p in paths]), F.col("argument"))
    full = F.get(F.array(*[F.lit(_full_path(spark, p)) for p in paths]), F.col("argument"))
    return lines.select(
        F.struct("argument", "path").alias("file_rank"),
        "block",
        "line_no",
        "line",
        F.when(full == F.col("path"), given).otherwise(F.col("uri")).alias("source_log"),
    )


def stream_log_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Lines as a stream over a folder of finished log files.

    A stream has no argument list: inside a micro-batch files rank by path, which therefore
    stands in for ``file_rank`` as text. ``line_no`` is given per micro-batch.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("file_rank"),
        F.col("_metadata.file_block_start").alias("block"),
        _text(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("source_log"),
    )
