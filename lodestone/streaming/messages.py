"""Messages and events as streams. An extension: the batch operators, run on micro-batches.

Sinks are folders with a part for each micro-batch, written anew if a batch is
run again, so a retry changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, IntegralType, StructField, StructType

from ..operators.route import message_class, question_kind, route

_BATCH = "batch"
#: Groups of keys whose state is held together.
BUCKETS = 1024
#: The time of a key that has not come up; far from both ends, so that differences do not overflow.
_NEVER = -(1 << 61)


def routed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless: route, body, class and kind of each message."""
    rows = messages.withColumn("r", route(text_col)).select(*messages.columns, "r.route", "r.body")
    return rows.withColumns({"class": message_class("body"), "kind": question_kind("body")})


def gap_counts(asks: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Questions that the FAQ did not answer, by window and kind; rows later than the watermark are left out."""
    rows = asks.withWatermark(ts, late).where(~F.coalesce("faq_hit", F.lit(False)))
    return rows.groupBy(F.window(ts, width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "kind", "n")


def first_submissions(rows: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Submissions without those that repeat one within the time."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def repeated_within(rows: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 86_400, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``repeated``, as operators.registry has it, on a stream: whether the same keys came up to so long before.

    A key's state is the time of its last row; a timer drops it once the
    watermark shows that nothing can repeat it any more. Keys lie in BUCKETS
    groups, and a call works on all rows of a bucket, so its cost is that of
    rows, not of keys; ``buckets`` is fixed with a checkpoint. Rows of a key
    within one micro-batch are taken in order of time; one that comes after a
    later one, but inside the watermark, is held against the last before it that
    is remembered. Rows behind the watermark are dropped, and counted by Spark
    (numRowsDroppedByWatermark in the query's progress). Rows without a time
    repeat nothing.
    """
    schema = rows.schema
    # pandas has whole numbers with nulls among them as floats: zeros stand for them, with a mark.
    whole = [f.name for f in schema if isinstance(f.dataType, IntegralType)]
    marks = {f"_null_{k}": F.col(f"`{c}`").isNull() for k, c in enumerate(whole)}

    def held(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        keys_, lasts = state.get if state.exists else ([], [])
        known = pd.Series(lasts, index=pd.Index(keys_, dtype=object), dtype="int64")
        if not state.hasTimedOut:
            frame = pd.concat(list(frames), ignore_index=True).sort_values(ts, kind="stable", ignore_index=True)
            timed = frame.loc[frame[ts].notna(), ["_key", "_second"]]
            codes, names = pd.factorize(timed["_key"])
            second = timed["_second"].to_numpy("int64")
            order = np.argsort(codes, kind="stable")  # by key, then time
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            from_state = known.reindex(names, fill_value=_NEVER).to_numpy("int64")
            before = np.concatenate([[_NEVER], second[order][:-1]])[: len(order)]
            before[first] = _NEVER
            before = np.maximum(before, from_state[codes[order]])
            since = second[order] - before
            told = np.zeros(len(frame), bool)
            told[timed.index.to_numpy()[order]] = (before != _NEVER) & (since >= 0) & (since <= seconds)
            newest = np.maximum(second[order][np.append(first[1:], len(order)) - 1] if len(order) else np.zeros(0, "int64"), from_state)
            known = pd.concat([known.drop(names, errors="ignore"), pd.Series(newest, index=names, dtype="int64")])
            yield frame.drop(columns=["_bucket", "_key", "_second"]).assign(repeated=told)
        known = known[(known + seconds + 1) * 1000 > now]
        if len(known):
            state.update((known.index.tolist(), known.tolist()))
            state.setTimeoutTimestamp(max((int(known.min()) + seconds + 1) * 1000, now + 1))
        elif state.exists:
            state.remove()

    sign = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    text = lambda c: sign(F.hex(c) if isinstance(schema[c].dataType, BinaryType) else F.col(f"`{c}`").cast("string"))
    key = F.concat(*map(text, keys))
    marked = rows.withWatermark(ts, late).withColumns({"_key": key, "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)), "_second": F.coalesce(F.unix_seconds(F.col(f"`{ts}`").cast("timestamp")), F.lit(0)), **marks}).withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(schema[c].dataType)) for c in whole})
    out = StructType([*schema.fields, *(StructField(m, BooleanType()) for m in marks), StructField("repeated", BooleanType())])
    found = marked.groupBy("_bucket").applyInPandasWithState(held, out, "keys array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.when(~F.col(m), F.col(f"`{c}`")) for c, m in zip(whole, marks, strict=True)}).drop(*marks)


def written(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", make: Callable[[DataFrame], DataFrame] | None = None, **trigger: Any):
    """Starts writing the micro-batches of a stream (or what ``make`` makes of them) to ``sink``, each to a part of its own number."""

    def run(batch: DataFrame, number: int) -> None:
        (make(batch) if make else batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/{_BATCH}={number}")

    started = stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint)
    return (started.trigger(**trigger) if trigger else started).start()


def answered(messages: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger: Any):
    """Starts answering: each micro-batch reads the knowledge anew through ``answer``, so a write is seen by the next batch."""
    return written(messages, sink, checkpoint, make=answer, **trigger)


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """What a query in update mode has told last of each key."""
    rows = spark.read.parquet(sink)
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(_BATCH).desc()))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", _BATCH)
