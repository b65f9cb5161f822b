"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Parquet looks at the size of pages and row groups every hundred rows at first, and its reader takes up to 4096 rows of a row
#: group at once. For rows of megabytes it looks at each row, and a row group has few.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20), "parquet.block.row.count.limit": "8", "parquet.enable.dictionary": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local one where the driver is the executor
    too (tests); on a cluster each executor would write to its own disk, so that raises."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str, instead_of: DataFrame | None = None, large_rows: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and reread it: lineage is cut and no executor's loss matters.

    instead_of: a staged table that nothing reads any more once df is written; it is deleted then. Others stay until the
    application ends, as what is returned to a caller may be read at any time. large_rows: rows of megabytes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**LARGE_ROWS if large_rows else {}).parquet(path)
    old = getattr(instead_of, "_staged_at", None)
    if old:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send tasks' Arrow batches of at most so many rows, for tables of very large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
