"""Pages of files as a Spark data source, and a cache of pages that a stopped run goes on with.

Reading plans ranges of pages as partitions, so a long file is worked on by many
tasks; pages that the cache has are left out of the plan. The cache is
written by the tasks that work on the pages: each commits a file after every so
many pages, so a stop loses fewer than that in each task. What is worked on is left to an engine, a class named by its
place (``package.module:Name``): ``count(data)`` tells the pages of a file,
``page(data, number)`` the text of one, whether it is extracted or rendered and
recognised. Files are reached through pyarrow's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

FORMAT = "lodestone_pages"
SCHEMA = "path string, page int, text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])


class FormFeeds:
    """Text files whose pages end with form feeds, as programs that print pages write them."""

    suffixes = (".txt",)

    def count(self, data: bytes) -> int:
        return len(self._pages(data))

    def page(self, data: bytes, number: int) -> str:
        return self._pages(data)[number - 1].decode("utf-8", "replace")

    def _pages(self, data: bytes) -> list[bytes]:
        pages = data.split(b"\f")
        return pages if pages[-1].strip() or len(pages) == 1 else pages[:-1]


class PdfText:
    """Text of PDF pages, through the optional pdfplumber."""

    suffixes = (".pdf",)

    def __init__(self):
        self.held = (None, None)

    def _open(self, data: bytes):
        import io

        import pdfplumber

        if self.held[0] is not data:
            self.held = (data, pdfplumber.open(io.BytesIO(data)))
        return self.held[1]

    def count(self, data: bytes) -> int:
        return len(self._open(data).pages)

    def page(self, data: bytes, number: int) -> str:
        return self._open(data).pages[number - 1].extract_text() or ""


def _engine(name: str):
    module, _, cls = name.partition(":")
    return getattr(import_module(module), cls)()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Range(D.InputPartition):
    """Pages of a file; ``error``: the file could not be opened."""

    path: str = ""
    numbers: tuple[int, ...] = ()
    error: str | None = None


class Reader(D.DataSourceReader):
    """Options: path, engine, pages_per_task (50), cache (a folder of pages that are done, or none), plan_only (rows without texts)."""

    def __init__(self, options):
        self.path, self.engine = options["path"].rstrip("/"), options["engine"]
        self.size, self.cache = int(options.get("pages_per_task", 50)), options.get("cache")
        self.plan_only = options.get("plan_only", "false").lower() == "true"

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.path)
        engine = _engine(self.engine)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else store.get_file_info([path])
        done, out = finished(self.cache) if self.cache else {}, []
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.lower().endswith(tuple(engine.suffixes)):
                continue
            try:
                with store.open_input_stream(info.path) as f:
                    left = [n for n in range(1, engine.count(f.read()) + 1) if n not in done.get(info.path, ())]
            except Exception as e:  # noqa: BLE001  any engine may fail on any file
                out.append(Range(info.path, (), f"{type(e).__name__}: {e}"))
                continue
            out += [Range(info.path, tuple(left[k : k + self.size])) for k in range(0, len(left), self.size)]
        return out or [Range()]

    def read(self, partition):
        told = {"path": partition.path, "text": "", "error": partition.error}
        if partition.error is not None:
            yield pa.RecordBatch.from_pylist([told | {"page": None}], schema=_ARROW)
        elif self.plan_only and partition.numbers:
            yield pa.RecordBatch.from_pylist([told | {"page": n} for n in partition.numbers], schema=_ARROW)
        elif partition.numbers:
            worker = Worker(self.path, self.engine)
            for n in partition.numbers:
                yield pa.RecordBatch.from_pylist([worker.page(partition.path, n)], schema=_ARROW)


class Worker:
    """An engine and the file that it works on."""

    def __init__(self, path: str, engine: str):
        self.store, self.engine, self.held = _store(path)[0], _engine(engine), (None, b"")

    def page(self, path: str, number: int) -> dict:
        try:
            if self.held[0] != path:
                with self.store.open_input_stream(path) as f:
                    self.held = (path, f.read())
            return {"path": path, "page": number, "text": self.engine.page(self.held[1], number), "error": None}
        except Exception as e:  # noqa: BLE001
            return {"path": path, "page": number, "text": "", "error": f"{type(e).__name__}: {e}"}


@dataclass
class Kept(D.WriterCommitMessage):
    pages: int


class Writer(D.DataSourceArrowWriter):
    """Options: path (of the cache), every (10): pages of a committed file; source and engine: works on the planned pages itself.

    Pages with an error are not kept, so they are done again.
    """

    def __init__(self, options):
        self.path, self.every = options["path"].rstrip("/"), int(options.get("every", 10))
        self.source, self.engine = options.get("source"), options.get("engine")

    def write(self, iterator: Iterator[pa.RecordBatch]):
        import pyarrow.parquet as pq

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        held: list[dict] = []
        total = 0

        def commit() -> None:
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_pylist(held, schema=_ARROW), f"{path}/_{name}", filesystem=store)
            store.move(f"{path}/_{name}", f"{path}/pages-{name}")
            held.clear()

        worker = Worker(self.source, self.engine) if self.source else None
        for b in iterator:
            for row in b.to_pylist():
                if worker is not None and row["page"] is not None:
                    row = worker.page(row["path"], row["page"])
                if row["error"] is None and row["page"] is not None:
                    held.append(row)
                    total += 1
                if len(held) >= self.every:
                    commit()
        if held:
            commit()
        return Kept(total)

    def commit(self, messages):
        pass  # files of the cache count as soon as they are there

    def abort(self, messages):
        pass  # and stay if the run does not end


def finished(cache: str) -> dict[str, set[int]]:
    """The numbers of the pages of each file that the cache has."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = _store(cache)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return {}
    files = [i.path for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("pages-")]
    done: dict[str, set[int]] = {}
    if files:
        for b in ds.dataset(files, filesystem=store, format="parquet").to_batches(columns=["path", "page"]):
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                done.setdefault(p, set()).add(n)
    return done


class Source(D.DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def scan(spark: SparkSession, path: str, engine: str = "lodestone.sources.pages:FormFeeds", **options: str) -> DataFrame:
    """path, page (from 1), text, error of all pages of a file or of the files of a folder; a file that cannot be opened is a row without a page."""
    spark.dataSource.register(Source)
    return spark.read.format(FORMAT).options(engine=engine, **options).load(path)


def cached(spark: SparkSession, path: str, cache: str, engine: str = "lodestone.sources.pages:FormFeeds", every: int = 10, pages_per_task: int = 50) -> DataFrame:
    """path, page, text of all pages: those in the cache, and the others, put into it first. A run after a stop does only what is left."""
    todo = scan(spark, path, engine, cache=cache, pages_per_task=str(pages_per_task), plan_only="true")
    todo.write.format(FORMAT).options(every=str(every), source=path, engine=engine).mode("append").save(cache)
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "pages-*").parquet(cache).groupBy("path", "page").agg(F.max("text").alias("text"))


def documents(pages: DataFrame, marks: bool = True, mark: Column | None = None) -> DataFrame:
    """path, text: cleaned pages of each file in their order, each behind its mark (by default [教材 P12]) if ``marks``; empty pages are left out."""
    told = F.concat(F.lit(C.PAGE_MARK_WRITTEN), F.col("page").cast("string"), F.lit("]\n")) if mark is None else mark
    rows = pages.where(F.col("page").isNotNull()).select("path", "page", T.clean_spaces(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    one = F.concat(told, F.col("text")) if marks else F.col("text")
    whole = rows.select("path", "page", one.alias("text")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return whole.select("path", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
