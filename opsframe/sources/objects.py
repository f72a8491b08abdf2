"""Object listings through the file source, without reading any content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LISTING_DDL = "key STRING, length BIGINT, modified TIMESTAMP"


def scan_object_listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``key, length, modified`` of every object below ``root`` whose key starts with ``prefix``.

    Only folders that can hold the prefix are listed. A prefix without objects gives no rows.
    """
    root = root.rstrip("/")
    folder = prefix.rpartition("/")[0]
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(f"{root}/{folder}" if folder else root)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LISTING_DDL)
        raise
    marker = root.split("://", 1)[-1]
    marker = marker.removeprefix("file:")
    return files.select(
        F.substr(
            "path", F.instr("path", marker) + F.lit(len(marker) + 1)
        ).alias("key"),
        "length",
        F.col("modificationTime").alias("modified"),
    ).where(F.col("key").startswith(prefix))
