"""Chunks with overlap, and what each chunk inherits from its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import anchor_of


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def pieces(text: Column, size: int, ends: str = C.SENTENCE_ENDS) -> Column:
    """Paragraphs, the long ones cut after what ends a sentence; blank pieces go."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), _strip), lambda p: p != "")
    cut = lambda p: F.filter(F.split(p, f"(?<=[{ends}])"), lambda s: _strip(s) != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))


def split_text(text: Column | str, size: int = 400, overlap: int = 50, ends: str = C.SENTENCE_ENDS) -> Column:
    """Chunks of a text, as an array: an ordered fold that stays in generated code.

    Pieces are joined without a separator while they fit; a chunk that is full
    hands its last characters on; a piece that is too long is a chunk whole.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, s: Column) -> Column:
        fits = a["open"].isNull() | (F.length(a["open"]) + F.length(s) <= size)
        tail = F.concat(F.right(a["open"], F.lit(overlap)), s) if overlap > 0 else s
        return F.when(fits, F.struct(a["done"].alias("done"), F.concat(F.coalesce(a["open"], F.lit("")), s).alias("open"))).otherwise(F.struct(F.concat(a["done"], F.array(_strip(a["open"]))).alias("done"), tail.alias("open")))

    last = lambda a: F.filter(F.concat(a["done"], F.array(_strip(F.coalesce(a["open"], F.lit(""))))), lambda c: c != "")
    return F.aggregate(pieces(t, size, ends), start, step, last)


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 400, overlap: int = 50, ends: str = C.SENTENCE_ENDS) -> DataFrame:
    """id_col, chunk_no (from 0), text, and anchor of its document."""
    return docs.select(id_col, anchor_of(F.coalesce(text_col, F.lit(""))).alias("anchor"), F.posexplode(split_text(text_col, size, overlap, ends)).alias("chunk_no", "text"))


def with_context(parts: DataFrame, id_col: str, mark: str = C.PAGE_MARK, carry: str = "first") -> DataFrame:
    """Chunks that lack them get the document's anchor line, then the page mark in force.

    ``carry``: which mark of a chunk with several goes on, ``first`` or ``last``.
    """
    found = F.regexp_extract_all("text", F.lit(mark), F.lit(1))
    own = F.element_at(found, 1 if carry == "first" else -1)
    parts = parts.withColumn("own", F.when(F.size(found) > 0, own))
    before = W.partitionBy(id_col).orderBy("chunk_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("page", F.last("own", ignorenulls=True).over(before))
    lead = F.when((F.col("chunk_no") > 0) & (F.col("anchor") != "") & ~F.col("text").startswith(F.col("anchor")), F.concat("anchor", F.lit("\n"))).otherwise("")
    page = F.when(F.col("own").isNull() & F.col("page").isNotNull(), F.concat(F.lit("[教材 P"), "page", F.lit("]\n"))).otherwise("")
    return parts.select(id_col, "chunk_no", F.concat(lead, page, "text").alias("text"), "page")
