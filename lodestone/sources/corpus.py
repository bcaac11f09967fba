"""Files of a corpus, parsed by type."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..runtime import kept, numbered
from . import office

Parser = Callable[[bytes], str]


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def pdf_text(data: bytes) -> str:
    """Pages with text, each under its number. Needs pdfplumber, which is optional."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        pages = [(n, page.extract_text() or "") for n, page in enumerate(pdf.pages, 1)]
    return "\n\n".join(f"[第{n}页]\n{text}" for n, text in pages if text.strip())


def doc_text(data: bytes, seconds: int = 60) -> str:
    """Old word files, through LibreOffice if the worker has it; the file lives only as long as the call."""
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "in.doc").write_bytes(data)
        subprocess.run(["libreoffice", "--headless", "--convert-to", "docx", "--outdir", folder, f"{folder}/in.doc"], check=True, capture_output=True, timeout=seconds)
        return office.docx_text((Path(folder) / "in.docx").read_bytes())


PARSERS: Mapping[str, Parser] = {".pdf": pdf_text, ".docx": office.docx_text, ".doc": doc_text, ".xlsx": office.xlsx_text, ".xlsm": office.xlsx_text, ".pptx": office.pptx_text, ".txt": plain_text, ".md": plain_text}


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def indexed(name: Column, types: tuple[str, ...] = C.INDEXED_TYPES, skipped: tuple[str, ...] = C.SKIPPED_NAMES) -> Column:
    """Whether a file of this name belongs in the index."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    keep = suffix.isin(*types)
    for s in skipped:
        keep &= ~name.startswith(s)
    return keep


def scan(spark: SparkSession, folder: str, types: tuple[str, ...] = C.INDEXED_TYPES, skipped: tuple[str, ...] = C.SKIPPED_NAMES) -> DataFrame:
    """path, source (the name), content of all files below ``folder`` that belong; names are tested before contents are parsed. A missing folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", file_name("path").alias("source"), "content").where(indexed(F.col("source"), types, skipped))


def parse(files: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """path, source, text, error: a file that cannot be parsed has an empty text and says why, and fails nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source, content in zip(f["path"], f["source"], f["content"], strict=True):
                suffix = Path(source).suffix.lower()
                try:
                    rows.append((path, source, parsers[suffix](bytes(content)), None))
                except Exception as e:  # noqa: BLE001  any parser may fail on any file
                    rows.append((path, source, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "source", "text", "error"])

    return files.mapInPandas(run, "path string, source string, text string, error string")


def documents(spark: SparkSession, folder: str, **options) -> DataFrame:
    """doc_id by order of paths, path, source, text of all files with text: the same ids for the same files."""
    texts = kept(parse(scan(spark, folder, **options)).where(F.trim("text") != ""))  # parsed once
    numbers = numbered(texts.select("path"), ["path"], "doc_id")  # texts stay where they are
    return texts.join(numbers, "path").select("doc_id", "path", "source", "text")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """page, text of cached pages p<number>.txt; other names are passed over."""
    files = spark.read.option("pathGlobFilter", "p*.txt").text(folder, wholetext=True).withColumn("name", file_name(F.input_file_name()))
    number = F.regexp_extract("name", r"^p(\d+)\.txt$", 1)
    return files.where(number != "").select(number.cast("int").alias("page"), F.col("value").alias("text"))


def recognise(pages: DataFrame, engine: Callable[[bytes], list[tuple[float, float, float, str]]], done: DataFrame | None = None) -> DataFrame:
    """page, boxes (y, x, h, text), error for pages not among ``done``; ``engine`` is any recogniser. pages: page, image."""
    todo = pages if done is None else pages.join(done.select("page"), "page", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, image in zip(f["page"], f["image"], strict=True):
                try:
                    boxes = [{"y": float(y), "x": float(x), "h": float(h), "text": t} for x, y, h, t in engine(bytes(image))]
                    rows.append((page, boxes, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((page, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page", "boxes", "error"])

    return todo.select("page", "image").mapInPandas(run, "page int, boxes array<struct<y:double,x:double,h:double,text:string>>, error string")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, source, text of the folder's .md files whose names do not begin with an underscore. A missing folder is empty."""
    return _whole(spark, folder, "*.md").where(~F.col("source").startswith("_"))


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", pattern).option("ignoreMissingFiles", True).text(path, wholetext=True)
    return texts.select(F.input_file_name().alias("path"), file_name(F.input_file_name()).alias("source"), F.col("value").alias("text"))


def text_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """text of one optional file; without the file, no rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "text string")
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def load_facts(spark: SparkSession, path: str, day: Column | None = None) -> DataFrame:
    """The facts of an optional file that are in force on a day, today by default; without the file, no rows."""
    from ..functions.parsers import parse_facts
    from ..operators.validity import effective

    found = parse_facts(text_or_empty(spark, path))
    return found.where(effective(F.current_date() if day is None else day, F.col("effective_from"), F.col("effective_until")))
