"""Tables written to the shared folder so that later jobs do not redo earlier ones."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, if executors share it.

    A warehouse in a local folder is shared only where all runs in one process;
    on a cluster that is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return f"{warehouse}/_staged"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and lets
    the next job read only the columns it needs.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.staged_at = path
    return again


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads, through Hadoop's file system (they may be remote)."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of jobs that are over go when the driver's collector finds their plans; it is told to look."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """Tasks for groups that cost more time than bytes, which adaptive plans would put together by size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(column: str) -> Column:
    """A column by its whole name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns, whatever their names, as one."""
    return F.struct(*(named(c) for c in docs.columns))
