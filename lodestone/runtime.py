"""Sessions, and tables kept between jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC and adaptive execution."""
    b = SparkSession.builder.appName("lodestone")
    if master:
        b = b.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    return b.config(map=own | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse, if executors share it.

    A warehouse in a local folder is shared only where all runs in one process;
    on a cluster that is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return f"{warehouse}/_kept"


def kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number", parts: int | None = None) -> DataFrame:
    """``rows`` with dense numbers from 0 in ``order`` (equal rows in any order among themselves).

    Rows are dealt by range and ordered inside it; how many each range holds
    tells where the next begins, so no task sees more than a range, and only
    the counts (a row for each range) come to the driver.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row inside its range and that of the range are in one: monotonically_increasing_id has 33 bits for the first.
    placed = kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, upto = [], 0
    for p in sorted(sizes):
        starts.append((p, upto))
        upto += sizes[p]
    begins = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))  # a row for each range
    own = placed.join(begins, F.shiftright("_at", 33) == F.col("_p"))
    return own.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_start")
