"""Session helpers: a local session for tests, staged tables, literals."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_CHECKPOINT_DIR = "spark.checkpoint.dir"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", app: str = "opsframe", **conf: str) -> SparkSession:
    """A local session as used by the tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_local_checkpoint_dir(spark: SparkSession) -> None:
    """Names a folder for intermediate tables in a local session that names none.

    For tests, benches and smoke runs. A cluster has to name one that all executors reach.
    """
    if _checkpoint_dir(spark) is None and spark.sparkContext.master.startswith("local["):
        spark.conf.set(_CHECKPOINT_DIR, tempfile.mkdtemp(prefix="opsframe-"))


def _checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder all executors see.

    Everything an application leaves there is below one folder with its id.
    """
    base = _checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/opsframe-{application}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that later branches agree on every row and a lost executor costs a
    re-read rather than a re-run. The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``staged`` wrote for these tables; nothing may read them afterwards."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            delete_folder(table.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables on whatever storage it lies; a missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path.getFileSystem(conf).delete(path, True)


def as_instant(now: str | date | datetime | Column | None) -> Column:
    """``now`` as a zone-free timestamp; an aware datetime becomes its UTC wall time.

    Goes by way of text: a datetime literal would be read in the zones of Python and session.
    """
    if isinstance(now, Column):
        return now
    if isinstance(now, datetime):
        if now.tzinfo is not None:
            now = now.astimezone(timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ")
    elif isinstance(now, date):
        now = now.isoformat()
    return F.lit(now).cast("timestamp_ntz")
