"""Rosters and histories in workbooks, event logs, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from .office import xlsx_rows

EVENT = "ts timestamp_ntz, event string, message string, kind string, faq_hit boolean, faq_top double, n_facts int, facts_used boolean, path string, n_hits int, top_score double, sources array<string>"


def workbook_rows(files: DataFrame) -> DataFrame:
    """path, sheet, row_no (from 1), cells of workbooks given as path, content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, sheet, n, cells) for path, content in zip(f["path"], f["content"], strict=True) for sheet, table in xlsx_rows(bytes(content)) for n, cells in enumerate(table, 1)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row_no int, cells array<string>")


def roster_rows(rows: DataFrame, scan_rows: int = 12, least_digits: int = 6) -> DataFrame:
    """student_id, name, row_no, problem of each row below the header.

    The header is the first of the top rows that has a header of either kind;
    its columns are found by their texts, never by place. problem: null, id,
    name, or duplicate; the first of equal ids counts. rows: row_no, cells.
    """
    cells = F.transform("cells", T.cell_text)
    rows = rows.select("row_no", cells.alias("cells"))
    at = lambda names: F.array_max(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("cells", n)))
    heads = rows.where(F.col("row_no") <= scan_rows).select("row_no", at(C.ROSTER_ID_HEADERS).alias("id_col"), at(C.ROSTER_NAME_HEADERS).alias("name_col")).where("id_col > 0 AND name_col > 0")
    head = heads.agg(F.min(F.struct("row_no", "id_col", "name_col")).alias("head")).where("head IS NOT NULL")
    body = rows.crossJoin(F.broadcast(head)).where(F.col("row_no") > F.col("head.row_no"))  # head: one row
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.col(c).cast("int")), F.lit(""))
    body = body.select("row_no", cell("head.id_col").alias("student_id"), cell("head.name_col").alias("name")).where("student_id <> '' OR name <> ''")
    wrong = F.when(~F.col("student_id").rlike(rf"^\d{{{least_digits},}}$"), "id").when(F.col("name") == "", "name")
    body = body.withColumn("problem", wrong)
    nth = F.row_number().over(W.partitionBy("student_id", F.col("problem").isNull()).orderBy("row_no"))
    return body.withColumn("problem", F.coalesce("problem", F.when(nth > 1, "duplicate")))


def roster(rows: DataFrame, **options) -> DataFrame:
    """student_id, name: one row for each id; ids are text."""
    return roster_rows(rows, **options).where("problem IS NULL").select("student_id", "name")


def roster_report(found: DataFrame, id_digits: int = 8) -> DataFrame:
    """One row: how many, lengths of ids, bad rows, duplicates, and whether any id has the length that messages are searched for."""
    lengths = found.where("problem IS NULL").groupBy(F.length("student_id").alias("digits")).agg(F.count("*").alias("n"))
    lengths = lengths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("digits", "n")))).alias("id_lengths"))
    counts = found.agg(F.count_if(F.col("problem").isNull()).alias("count"), F.count_if(F.col("problem").isin("id", "name")).alias("skipped_rows"), F.count_if(F.col("problem") == "duplicate").alias("duplicates"))
    return counts.crossJoin(lengths).withColumn("usable", F.map_contains_key("id_lengths", F.lit(id_digits)))  # one row each


def history(rows: DataFrame, headers: tuple[str, ...] = C.SUBMISSION_HEADERS) -> DataFrame:
    """Rows of a submission table by their headers; empty rows go. rows: row_no, cells, the first being the header."""
    body = rows.where("row_no > 1").withColumn("cells", F.transform("cells", T.cell_text)).where(F.exists("cells", lambda c: c != ""))
    return body.select("row_no", *(F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(h) for k, h in enumerate(headers)))


def asks(lines: DataFrame, names: list[str] = (), line: str = "value") -> DataFrame:
    """text, kind, faq_hit, top_score of the questions in event lines; half-written lines go, personal data is masked on reading."""
    whole = F.try_parse_json(F.trim(line)).isNotNull()
    event = F.from_json(line, EVENT)
    rows = lines.where(whole).select(event.alias("e")).where("e.event = 'qa_kind' AND trim(e.message) <> ''")
    return rows.select(T.redact(F.trim("e.message"), names).alias("text"), F.coalesce("e.kind", F.lit("?")).alias("kind"), F.coalesce("e.faq_hit", F.lit(False)).alias("faq_hit"), F.col("e.top_score").alias("top_score"))


def read_asks(spark: SparkSession, folder: str, names: list[str] = ()) -> DataFrame:
    """As asks, from the month files YYYY-MM.log of a folder; other logs are not opened."""
    return asks(spark.read.option("pathGlobFilter", "[0-9][0-9][0-9][0-9]-[0-9][0-9].log").text(folder), names)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Results of a stored evaluation; a missing file is an error."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
