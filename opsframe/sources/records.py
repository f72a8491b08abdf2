"""Query records as landed JSON pages."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsframe.functions import zone_free
from opsframe.schemas import QUERY_RECORD_DDL


def scan_query_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of all pages ``{queries: [..]}``: one page per file, or per line.

    Start times with a zone become UTC wall times; a time that doesn't parse is an error.
    """
    as_text = QUERY_RECORD_DDL.replace("startTime TIMESTAMP_NTZ", "startTime STRING")
    pages = spark.read.schema(f"queries ARRAY<STRUCT<{as_text}>>").json(
        path, multiLine=not lines, mode="FAILFAST"
    )
    records = pages.selectExpr("inline(queries)")
    return records.withColumn("startTime", zone_free(F.col("startTime")))
