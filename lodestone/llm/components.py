"""Connected components of a large edge table, and rows met group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """a, b (one orderable type) -> node, root: the least node of each node's component.

    Alternating large and small stars (Kiveris et al. 2014): each round hangs
    neighbours on the least one they know, until every node hangs on its root.
    Rounds grow with the logarithm of the longest path. A node with very many
    edges meets them in a combined aggregation and in a join that Spark splits
    (it splits joins of plain tables, so the least nodes are written first).
    """
    # Smaller node first: parent, child.
    e = staged(edges.where("a <> b").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("c")).distinct(), "edges")
    mark = _mark(e)
    while True:
        both = e.select(F.col("p").alias("u"), F.col("c").alias("v")).unionByName(e.select(F.col("c").alias("u"), F.col("p").alias("v")))
        nearest = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(nearest, "u").where("v > u").select(F.col("m").alias("p"), F.col("v").alias("c")).where("p <> c").distinct()
        large = staged(large, "edges")
        least = staged(large.groupBy("c").agg(F.min("p").alias("m")), "least")
        small = large.join(least, "c")
        small = small.select(F.col("m").alias("p"), F.col("c")).unionByName(small.select(F.col("m").alias("p"), F.col("p").alias("c"))).where("p <> c").distinct()
        before, e = e, staged(small, "edges")
        drop_staged(before, nearest, large, least)
        now = _mark(e)
        if now == mark:
            return e.groupBy("c").agg(F.min("p").alias("root")).select(F.col("c").alias("node"), "root")
        mark = now


def _mark(e: DataFrame) -> tuple:
    """A digest of the edges; the same twice means that a round changed nothing."""
    h = F.xxhash64("p", "c")
    r = e.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).collect()[0]
    return r["n"], r["x"], r["s"]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of each group, from batches sorted by their first ``keys`` columns (no nulls there)."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in range(keys):
            c = batch.column(k)
            change[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        change[0] = mark is not None and any(batch.column(k)[0].as_py() != mark[k] for k in range(keys))
        cuts = [0, *np.flatnonzero(change[1:]) + 1, n]
        if change[0]:
            yield _joined(held)
            held = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i:
                yield _joined(held)
                held = []
            held.append(batch.slice(i, j - i))
        mark = [batch.column(k)[n - 1].as_py() for k in range(keys)]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
