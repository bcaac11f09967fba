"""Reading order of recognised boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reading_order(boxes: DataFrame, page: str, tolerance: float = 0.6) -> DataFrame:
    """page, text: boxes (x, y, h, text) from top to bottom, those of a line from left to right.

    A box is on the line of the one above it if their tops are no further apart
    than ``tolerance`` of the larger of its height and the line's first. That
    is an ordered fold over one page's boxes.
    """
    rows = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y", "x", "h", "text"))).alias("boxes"))
    kind = "array<struct<line:int,x:double,text:string>>"
    start = F.struct(F.lit(0).alias("line"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("h"), F.array().cast(kind).alias("out"))

    def step(a: Column, b: Column) -> Column:
        same = F.coalesce(F.abs(b["y"] - a["y"]) <= F.greatest(a["h"], b["h"]) * tolerance, F.lit(False))
        line = a["line"] + F.when(same, 0).otherwise(1)
        item = F.struct(line.alias("line"), b["x"].alias("x"), b["text"].alias("text"))
        return F.struct(line.alias("line"), b["y"].alias("y"), F.when(same, a["h"]).otherwise(b["h"]).alias("h"), F.concat(a["out"], F.array(item)).alias("out"))

    placed = rows.select(page, F.explode(F.aggregate("boxes", start, step, lambda a: F.array_sort(a["out"]))).alias("i"))
    lines = placed.groupBy(page, "i.line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i.x", "i.text"))), lambda b: b["text"]), " ").alias("text"))
    return lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda b: b["text"]), "\n").alias("text"))
