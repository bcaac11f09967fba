"""New FAQ entries: parsed, checked, written as a new version, read back, or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parsers import parse_record
from ..sources import versions
from . import bm25
from .route import personal_data, too_long


def checked(records: DataFrame, faq: DataFrame, roster_names: list[str] = (), body: str = "body") -> DataFrame:
    """Adds question, answer, reason (null: accepted) and duplicate_of (the first entry's pos). faq: pos, question, answer.

    Order of reasons: form, personal data in the question and then the answer,
    length, duplicate. The names are a class list; for a large register join on
    names instead.
    """
    names = F.array(*map(F.lit, roster_names)).cast("array<string>")
    rows = records.withColumn("p", parse_record(body)).select(*records.columns, "p.question", "p.answer", F.nullif("p.error", F.lit("")).alias("error"))
    known = faq.groupBy(T.normal_question("question").alias("normal")).agg(F.min("pos").alias("duplicate_of"))
    rows = rows.withColumn("normal", T.normal_question("question")).join(known, "normal", "left").drop("normal")
    private = F.coalesce(personal_data("question", names), personal_data("answer", names))
    reason = F.coalesce("error", F.concat(F.lit("personal data: "), private), F.concat(F.lit("too long: "), too_long("question", "answer")), F.when(F.col("duplicate_of").isNotNull(), F.lit("duplicate")))
    return rows.withColumn("reason", reason).drop("error")


def resembling(asked: DataFrame, asked_id: str, faq_index: bm25.Index, tokens: Column, least: float = 4.0) -> DataFrame:
    """asked_id, pos, score: the entry that a question finds first, if it is near enough to be the same. A warning, no refusal."""
    best = bm25.search(faq_index, asked, asked_id, tokens, 1, "floored")
    return best.where(F.col("score") >= least).select(asked_id, F.col("id").alias("pos"), "score")


def self_hits(faq: DataFrame, faq_index: bm25.Index, kind: Column, tokens: Column, least: float = 4.0) -> DataFrame:
    """Entries on course business whose own question finds something near enough: those whose answers can be compared. faq: pos, question, answer."""
    business = faq.where(kind == "admin")
    asked = business.select(F.col("pos").alias("asked"), F.col("question").alias("text"))
    return business.join(resembling(asked, "asked", faq_index, tokens, least).select(F.col("asked").alias("pos"), "score"), "pos")


def reply(entries: Column, question: Column, answer: Column, near: Column, near_question: Column, no_roster: Column, path: Column | str, most: int = 120) -> Column:
    """What the writer is told: the entry, one that is like it if any, and whether names could not be checked. ``entries``: how many there are now."""
    p = F.col(path) if isinstance(path, str) else path
    alike = F.concat(F.lit("提醒:库里已有一条很像的(第 "), near.cast("string"), F.lit(" 条):"), near_question, F.lit("\n如果那是同一条,建议你手工把它删掉;不是的话忽略这句。"))
    unchecked = F.when(no_roster, F.lit("⚠ 花名册没读到,这次只查了学号、没查姓名 —— 记之前请自己确认没有学生姓名。"))
    head = F.concat(F.lit("✅ 已记录,FAQ 现在能被检索到 "), entries.cast("string"), F.lit(" 条。"))
    entry = F.concat(F.lit("问:"), question, F.lit("\n答:"), T.squeezed(answer, most))
    return F.concat_ws("\n\n", head, entry, alike, unchecked, F.concat(F.lit("文件:"), p))


class Duplicate(ValueError):
    """An entry with the same normal question is there already."""


def add_entry(spark: SparkSession, folder: str, question: str, answer: str) -> int:
    """Appends one entry to the FAQ table in ``folder`` and returns its pos.

    The entry is written aside as a part of its own and read back; only if it is
    found does the pointer move, and only from the version that the entry was
    checked against (see sources.versions). If another writer was faster, the
    table is read and checked for duplicates again. A refused or failed write
    leaves the table as it was. A missing table is an error.
    """
    told = []

    def entry(table: DataFrame, base: versions.Version) -> DataFrame:
        asked = spark.createDataFrame([(question, answer)], "question string, answer string").select("question", "answer", T.normal_question("question").alias("normal"))
        alike = table.where(T.normal_question("question") != "").select(T.normal_question("question").alias("normal")).join(asked, "normal", "left_semi")
        if not alike.isEmpty():
            raise Duplicate(question)
        told.append((table.agg(F.max("pos")).collect()[0][0] or 0) + 1)
        return asked.select(F.lit(told[-1]).cast(table.schema["pos"].dataType).alias("pos"), "question", "answer")

    def found(written: DataFrame) -> None:
        if written.where((F.col("question") == question) & (F.col("answer") == answer)).isEmpty():
            raise OSError("the entry was not found after writing; nothing was changed")

    versions.appended(spark, folder, entry, found)
    return told[-1]


def create(entries: DataFrame, folder: str) -> None:
    """A first version. entries: pos, question, answer."""
    version = versions.new_version(folder)
    entries.select("pos", "question", "answer").write.parquet(version)
    versions.publish(entries.sparkSession, folder, version)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the version in force, read anew each time."""
    return versions.read(spark, folder)
