"""Facts that hold between two days, both included; null is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective(day: Column, since: Column, until: Column) -> Column:
    return F.coalesce(since <= day, F.lit(True)) & F.coalesce(until >= day, F.lit(True))


def facts_on(rows: DataFrame, day_col: str, facts: DataFrame) -> DataFrame:
    """Each row with the facts in force on its day: a range join, through the months in which both lie.

    A fact without a first or last day is set against the span of the rows, so
    every pair meets in one month and no join is a cross product.
    """
    span = rows.agg(F.min(day_col).alias("low"), F.max(day_col).alias("high"))
    f = facts.crossJoin(F.broadcast(span))  # span: one row
    since, until = F.greatest(F.coalesce("effective_from", "low"), F.col("low")), F.least(F.coalesce("effective_until", "high"), F.col("high"))
    f = f.where(since <= until).withColumn("month", F.explode(F.sequence(F.trunc(since, "month").cast("date"), F.trunc(until, "month").cast("date"), F.expr("interval 1 month")))).drop("low", "high")
    r = rows.withColumn("month", F.trunc(day_col, "month").cast("date"))
    return r.join(f, "month").where(effective(F.col(day_col), F.col("effective_from"), F.col("effective_until"))).drop("month")


def in_range(rows: DataFrame, number: str, ranges: DataFrame, low: str, high: str, width: int = 32) -> DataFrame:
    """Rows with the ranges that hold their number (both ends included), met through buckets of ``width`` numbers."""
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return rows.withColumn("bucket", F.floor(F.col(number) / width)).join(r, "bucket").where(F.col(number).between(F.col(low), F.col(high))).drop("bucket")


def block_text(facts: DataFrame, group: str, order: str) -> DataFrame:
    """group, facts: its facts in order as lines, each with its source if it has one."""
    line = F.concat(F.lit("- "), F.col("fact"), F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.concat(F.lit("("), F.col("source"), F.lit(")"))).otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return facts.groupBy(group).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("facts"))
