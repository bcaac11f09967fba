"""Append-only logs, submission tables, corpus files, caches and reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from . import versions


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def append_events(events: DataFrame, folder: str, ts: str = "ts") -> None:
    """JSON lines, in a folder for each month."""
    events.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("month").json(folder)


def model_calls(calls: DataFrame, user: str, out: str) -> DataFrame:
    """What is logged of calls to a model: lengths, never texts."""
    return calls.select("ts", "ok", "model", F.length(user).alias("user_len"), F.length(out).alias("out_len"), "elapsed_s")


def append_submissions(rows: DataFrame, folder: str) -> DataFrame:
    """Appends and returns the table as it is afterwards; without the folder's parent nothing is written."""
    spark = rows.sparkSession
    fs, where = _fs(spark, folder)
    if not fs.exists(where.getParent()):
        raise FileNotFoundError(f"{where.getParent()} does not exist; nothing was written")
    rows.select(*C.SUBMISSION_HEADERS).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def write_corpus(rows: DataFrame, folder: str) -> None:
    """The texts of a guarded merge (see operators.assemble.guarded) as a new version; the old one is in force until it is written.

    If another writer publishes meanwhile, the merge is out of date: versions.Conflict, and nothing changes.
    """
    base, version = versions.current(rows.sparkSession, folder).number, versions.new_version(folder)
    rows.write.parquet(version)
    versions.publish(rows.sparkSession, folder, version, base)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(versions.in_force(spark, folder))


def write_texts(rows: DataFrame, folder: str, text: str = "text") -> None:
    rows.select(text).coalesce(1).write.mode("overwrite").text(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A manifest or an evaluation: JSON lines; written again it is the same."""
    report.coalesce(1).write.mode("overwrite").json(folder)


def cached(jobs: DataFrame, folder: str, run: Callable[[DataFrame], DataFrame], parts: int = 10) -> DataFrame:
    """Results of all jobs: those in the cache, and the others, appended a part at a time so that a stop loses one part.

    jobs: key and more; ``run``: jobs to key, text. Empty results are done again next time.
    """
    spark = jobs.sparkSession
    fs, where = _fs(spark, folder)
    read = lambda: spark.read.schema("key string, text string").parquet(folder) if fs.exists(where) else spark.createDataFrame([], "key string, text string")
    done = read().where("text <> ''").select("key")
    todo = jobs.join(done, "key", "left_anti")
    for k in range(parts):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        run(part).select("key", "text").write.mode("append").parquet(folder)
    last = read().where("text <> ''").groupBy("key").agg(F.max("text").alias("text"))
    return jobs.join(last, "key", "left")


def resumable(jobs: DataFrame, folder: str, work: Callable[[dict], str], every: int = 10) -> DataFrame:
    """key, text, error of all jobs: those in the cache, and the others, which tasks write to it as they go.

    jobs: key and more; ``work``: a row to its text, anything that takes long.
    A task commits a file of results after every so many rows, so a stop loses
    fewer than that in each task. A file appears whole or not at all (written
    aside and renamed, through pyarrow's file systems: shared folders, HDFS, S3,
    GCS). A row that fails has an error and, like an empty text, is done again
    next time; of a key that was done twice one text counts.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    spark, columns = jobs.sparkSession, jobs.columns
    fs, where = _fs(spark, folder)
    told = pa.schema([("key", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def read() -> DataFrame:
        there = fs.exists(where) and len(fs.listStatus(where)) > 0
        return spark.read.schema("key string, text string, error string").parquet(folder) if there else spark.createDataFrame([], "key string, text string, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.parquet as pq
        from pyarrow import fs as stores

        store, path = stores.FileSystem.from_uri(folder)
        held: list[dict] = []
        done = 0

        def commit() -> None:
            name = f"{uuid.uuid4().hex}.parquet"
            store.create_dir(path, recursive=True)
            pq.write_table(pa.Table.from_pylist(held, schema=told), f"{path}/_{name}", filesystem=store)
            store.move(f"{path}/_{name}", f"{path}/batch-{name}")
            held.clear()

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                try:
                    held.append({"key": row["key"], "text": work(row), "error": None})
                except Exception as e:  # noqa: BLE001
                    held.append({"key": row["key"], "text": "", "error": f"{type(e).__name__}: {e}"})
                done += 1
                if len(held) >= every:
                    commit()
        if held:
            commit()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    finished = read().where("text <> ''").select("key").distinct()
    jobs.join(finished, "key", "left_anti").select(*columns).mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one row
    best = read().groupBy("key").agg(F.max(F.struct((F.col("text") != "").alias("done"), "text", "error")).alias("r"))
    return jobs.join(best.select("key", "r.text", "r.error"), "key", "left")


def reply_line(reply: dict) -> tuple[str, int]:
    """One JSON line and the exit status of a command: 1 for errors only."""
    return json.dumps(reply, ensure_ascii=False, sort_keys=True), int(reply.get("type") == "error")


def fingerprint(content: Column | str) -> Column:
    """Of a file's bytes: outputs carry it instead of a clock, so writing again changes nothing."""
    return F.substring(F.sha2(F.col(content) if isinstance(content, str) else content, 256), 1, 8)
