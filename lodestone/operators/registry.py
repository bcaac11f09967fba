"""Late submissions: what a message says, checked against the roster, and appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def first_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key wins."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def status(student: Column, name: Column, listed: Column, roster_empty: Column) -> Column:
    """What is wrong, in this order: no id, no roster, id not in it, another name; a missing name passes."""
    wrong = F.concat(F.lit("姓名不匹配(名单为 "), listed, F.lit(")"))
    return F.when(student.isNull(), "缺学号").when(roster_empty, "名单缺失").when(listed.isNull(), "学号不在名单").when(name.isNotNull() & (name != listed), wrong).otherwise("OK")


def extracted(messages: DataFrame, roster: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds student_id, name, homework and status. roster: student_id, name, one row each.

    The roster is as large as it is: Spark broadcasts it only below its own threshold.
    """
    listed = roster.select(F.col("student_id").alias("roster_id"), F.col("name").alias("roster_name"))
    size = listed.agg((F.count("*") == 0).alias("roster_empty"))
    rows = messages.withColumn("student_id", T.student_id(text_col)).join(listed, F.col("student_id") == F.col("roster_id"), "left").crossJoin(F.broadcast(size))  # size: one row
    rows = rows.withColumn("name", T.person_name(text_col, F.col("roster_name"))).withColumn("homework", T.homework_number(text_col))
    return rows.withColumn("status", status(F.col("student_id"), F.col("name"), F.col("roster_name"), F.col("roster_empty"))).drop("roster_id", "roster_name", "roster_empty")


def reply(name: str = "name", student: str = "student_id", homework: str = "homework", state: str = "status") -> Column:
    labelled = lambda label, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(label), F.col(c)))
    return F.concat_ws("  ", F.lit("✅ 已登记补交"), labelled("姓名:", name), labelled("学号:", student), labelled("作业:", homework), labelled("校验:", state))


def submission_rows(checked: DataFrame, at: Column, text_col: str = "text") -> DataFrame:
    """The six columns of the table, null as empty, time to the minute."""
    values = [F.date_format(at, "yyyy-MM-dd HH:mm"), *(F.coalesce(c, F.lit("")) for c in ("student_id", "name", "homework")), F.col(text_col), F.col("status")]
    return checked.select(*(v.alias(h) for v, h in zip(values, C.SUBMISSION_HEADERS, strict=True)))


def repeated_within(rows: DataFrame, keys: list[str], time_col: str, seconds: int = 86_400) -> DataFrame:
    """Adds ``repeated``: whether the same keys came up to so long before. An option; nothing refuses such rows."""
    before = F.lag(time_col).over(W.partitionBy(*keys).orderBy(time_col))
    return rows.withColumn("repeated", F.coalesce(F.unix_timestamp(F.col(time_col).cast("timestamp")) - F.unix_timestamp(before.cast("timestamp")) <= seconds, F.lit(False)))
