"""Stages and batch functions that turn a failing row into a row with its error, and let the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import kept


def guarded(rows: DataFrame, stage: Callable[[DataFrame], DataFrame], id_col: str, most_errors: int = 100) -> tuple[DataFrame, DataFrame]:
    """What ``stage`` makes of the rows that it can work on, and errors (id_col, error) of the others.

    The stage runs as it is; only if it fails are the rows halved, by a hash of
    their ids, until those are alone that make it fail, so a faulty row costs
    some runs over smaller and smaller parts. The stage must work on rows (or on
    those of one id) alone: what it makes of a row must not depend on others.
    More than ``most_errors`` faulty ids are an error, as then the stage is at fault.
    """
    rows = kept(rows)
    schema = stage(rows.limit(0)).schema
    good: list[DataFrame] = []
    bad: list[tuple] = []

    def attempt(part: DataFrame, depth: int) -> None:
        try:
            good.append(kept(stage(part)))
            return
        except Exception as e:  # noqa: BLE001  any stage may fail on any row
            if part.select(id_col).distinct().limit(2).count() < 2:
                bad.append((part.select(id_col).first()[0], _told(e)))
                if len(bad) > most_errors:
                    raise
                return
        side = F.pmod(F.xxhash64(id_col, F.lit(depth)), F.lit(2))
        for half in (0, 1):
            some = part.where(side == half)
            if not some.isEmpty():
                attempt(some, depth + 1)

    if not rows.isEmpty():
        attempt(rows, 0)
    spark = rows.sparkSession
    out = spark.createDataFrame([], schema)
    for part in good:
        out = out.unionByName(part)
    return out, spark.createDataFrame(bad, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, error string")


def _told(e: Exception) -> str:
    """The last line that says what was wrong; Spark puts stack traces around it."""
    lines = [x.strip() for x in str(e).split("\n") if x.strip()]
    named = [x for x in lines if x.split(":")[0].split(".")[-1].endswith(("Error", "Exception")) and ":" in x]
    return (named[-1] if named else lines[0] if lines else type(e).__name__)[:500]


def guarded_batches(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, id_col: str) -> DataFrame:
    """id_col, the columns of ``schema``, error: ``function`` on Arrow batches, a row for each row and in their order.

    A batch that fails is halved until the failing rows are alone; they have an
    error and nulls. No job is run again.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def attempt(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            made = function(frame.reset_index(drop=True))
            if len(made) != len(frame):
                raise ValueError(f"{len(made)} rows for {len(frame)}")
            yield made[names].reset_index(drop=True).assign(error=None, **{id_col: frame[id_col].reset_index(drop=True)})
        except Exception as e:  # noqa: BLE001
            if len(frame) == 1:
                yield pd.DataFrame({**{n: [None] for n in names}, "error": [f"{type(e).__name__}: {e}"], id_col: frame[id_col].tolist()})
            else:
                middle = len(frame) // 2
                yield from attempt(frame.iloc[:middle])
                yield from attempt(frame.iloc[middle:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                for part in attempt(f):
                    yield part[[id_col, *names, "error"]]

    return rows.mapInPandas(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {schema}, error string")
