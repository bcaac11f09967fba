"""Long repeats across documents, found by recompression.

Rounds rewrite the words of each document as ever fewer symbols: a run of one
symbol becomes a symbol, and a pair of neighbours becomes one if the left falls
in one half of all names and the right in the other. A name is a hash of what
it stands for, so a run or pair has the same name in every document without any
exchange, and rounds need no shuffle. Each symbol carries the stretch of words
on which its being there depends. If that lies inside a window, every copy of
the window has the symbol at the same place: of the symbols of the highest such
level, the one with the least name is the window's anchor.

Windows next to each other with one anchor are one row: the anchor's name and a
hash of all words that these windows cover. Only names that two documents share
go on. Rows alike in both are equal repeats and are settled at once. Where one
name has several surroundings, two of them can share a window only if they
share the anchor together with half of the window's other words on its left or
on its right: what shares neither is done. For the rest, the windows of one
document for each surrounding are compared by 128-bit hashes. Names come from
one hash of each word's bytes and surroundings from another that has nothing in
common with it, so what is called equal is so in about 128 bits everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import drop_staged, named, release, staged
from .words import Spans, Words, mix, slices, text_bytes, windows

U = np.uint64
WINDOW = 50
#: Rounds of pairs, and those of them that begin with runs. With more, symbols are longer and fewer of
#: them fit in a window, so an anchor serves fewer windows; with less, short symbols are shared by chance.
ROUNDS, RUNS_BEFORE = 6, (0,)
_FAR = 1 << 40


def _ends(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run, given whether an item equals the one before it."""
    first = np.flatnonzero(~same)
    return first, np.append(first[1:], len(same)) - 1


def _runs(name, row, lo, hi):
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
    first, last = _ends(same)
    size = last - first + 1
    # That a run ends depends on its neighbours; at the ends of a text, on what is not there.
    before = np.where((first > 0) & (row[np.maximum(first - 1, 0)] == row[first]), lo[np.maximum(first - 1, 0)], -_FAR)
    after = np.minimum(last + 1, len(name) - 1)
    after = np.where((last + 1 < len(name)) & (row[after] == row[last]), hi[after], _FAR)
    made = np.where(size > 1, mix(name[first] * U(3) + size.astype(U) * U(0xD1342543DE82EF95)), name[first])
    return made, row[first], np.minimum(lo[first], before), np.maximum(hi[last], after)


def _pairs(name, row, lo, hi, turn: int):
    n = len(name)
    left = (mix(name + U(turn * 2 + 1)) & U(1)).astype(bool)
    next_in = np.zeros(n, bool)
    next_in[:-1] = row[1:] == row[:-1]
    opens = np.zeros(n, bool)
    opens[:-1] = left[:-1] & ~left[1:] & next_in[:-1]
    closes = np.zeros(n, bool)
    closes[1:] = opens[:-1]
    # A symbol stays alone because of the neighbour on the side where it could have joined.
    low, high = lo.copy(), hi.copy()
    alone_left, alone_right = left & ~opens, ~left & ~closes
    after = np.full(n, _FAR)
    after[:-1][next_in[:-1]] = hi[1:][next_in[:-1]]
    before = np.full(n, -_FAR)
    before[1:][next_in[:-1]] = lo[:-1][next_in[:-1]]
    high[alone_left] = np.maximum(high, after)[alone_left]
    low[alone_right] = np.minimum(low, before)[alone_right]
    at = np.flatnonzero(opens)
    made = name.copy()
    made[at] = mix(name[at] * U(0x9FB21C651E98DF25) + mix(name[at + 1] + U(turn)))
    low[at] = np.minimum(lo[at], lo[at + 1])
    high[at] = np.maximum(hi[at], hi[at + 1])
    keep = ~closes
    return made[keep], row[keep], low[keep], high[keep]


def _least_in(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least of values[first..last] for each pair, by minima over stretches of 1, 2, 4, ..."""
    best = np.zeros(len(first), np.int64)
    size, step, have = last - first + 1, 1, np.arange(len(values))
    while len(first):
        now = (size >= step) & (size < 2 * step)
        x, y = have[first[now]], have[last[now] - step + 1]
        best[now] = np.where(values[x] <= values[y], x, y)
        if not (size >= 2 * step).any():
            break
        x, y = have[:-step], have[step:]
        have = np.where(values[x] <= values[y], x, y)
        step *= 2
    return best


def anchors(hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Name, identity, and first and last word (exclusive) of the anchor of each window; windows with one identity are next to each other."""
    at = np.arange(len(hashes))
    state = (hashes, rows, at, at + 1)
    levels = [state]
    for turn in range(ROUNDS):
        if turn in RUNS_BEFORE:
            state = _runs(*state)
        state = _pairs(*state, turn)
        levels.append(state)
    name = np.zeros(len(starts), U)
    who, low, high = np.zeros((3, len(starts)), np.int64)
    open_ = np.arange(len(starts))
    given = 0
    for level, (names, _, lo, hi) in reversed(list(enumerate(levels))):
        fit = hi - lo <= width
        names, lo, hi = mix(names[fit] + U(level + 1)), lo[fit], hi[fit]
        if not len(names) or not len(open_):
            continue
        s = starts[open_]
        first, last = np.searchsorted(lo, s), np.searchsorted(hi, s + width, "right") - 1
        ok = last >= first
        k = _least_in(names, first[ok], last[ok])
        found = open_[ok]
        name[found], who[found], low[found], high[found] = names[k], given + k, lo[k], hi[k]
        given += len(names)
        open_ = open_[~ok]
    return name, who, low, high


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _identity(id_col: str, text_col: str) -> list[Column]:
    """Order of a document (null ids first) and hash of its text: together, all that matters of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text")]


def _side(spans: Spans, first: np.ndarray, last: np.ndarray, there: np.ndarray) -> pa.Array:
    """32 bits of the hashes of words first to last, null where they are not ``there``; only to tell what cannot be equal."""
    out = np.zeros(len(first), np.uint32)
    out[there] = spans.hashes(first[there], last[there]).astype(np.uint32)
    return pa.array(out.view(np.int32), mask=~there)


def _surroundings(texts: DataFrame, width: int) -> DataFrame:
    """A row for each anchor: doc, body, name, around (hash of the words its windows cover), left, right, start, n (windows).

    left, right: the anchor with half of a window's other words before or after
    it. A window has them on one side at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(2))
            doc, body = (batch.column(k).to_numpy() for k in (0, 1))
            for i, j in slices(offsets):
                w = Words(offsets[i : j + 1], data)
                starts, rows = windows(w.at, width)
                if not len(starts):
                    continue
                name, who, low, high = anchors(w.hashes, w.rows, starts, width)
                same = np.zeros(len(starts), bool)
                same[1:] = (who[1:] == who[:-1]) & (rows[1:] == rows[:-1]) & (name[1:] == name[:-1])
                first, last = _ends(same)
                spans = Spans(w.hashes_of(1), 1)
                around = spans.hashes(starts[first], starts[last] + width)
                low, high, r = low[first], high[first], rows[first]
                more = (width - (high - low) + 1) // 2
                left = _side(spans, low - more, high, starts[first] <= low - more)
                right = _side(spans, low, high + more, starts[last] + width >= high + more)
                yield pa.RecordBatch.from_arrays([pa.array(doc[i + r]), pa.array(body[i + r]), _signed(name[first]), _signed(around), left, right, pa.array((starts[first] - w.at[r]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["doc", "body", "name", "around", "left", "right", "start", "n"])

    return texts.mapInArrow(run, "doc long, body long, name long, around long, left int, right int, start int, n int")


def _window_hashes(tasks: DataFrame, width: int) -> DataFrame:
    """doc, body, start, a, b: 128-bit hashes of the windows asked for in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(2))
            doc, body = (batch.column(k).to_numpy() for k in (0, 1))
            asked = batch.column(3)
            cuts = asked.offsets.to_numpy().astype(np.int64)
            start, n = (x.to_numpy().astype(np.int64) for x in asked.values.flatten()) if len(asked.values) else (np.zeros(0, np.int64),) * 2
            for i, j in slices(offsets):
                w = Words(offsets[i : j + 1], data)
                own = slice(cuts[i], cuts[j])
                rows = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1]))
                at, size = start[own] + w.at[rows], n[own]
                rows = np.repeat(rows, size)
                at = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
                one, two = (Spans(w.hashes_of(lane), lane).hashes(at, at + width) for lane in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(doc[i + rows]), pa.array(body[i + rows]), pa.array((at - w.at[rows]).astype(np.int32)), _signed(one), _signed(two)], ["doc", "body", "start", "a", "b"])

    return tasks.mapInArrow(run, "doc long, body long, start int, a long, b long")


def covered_windows(texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc, body, ranges: (start, n) of n windows whose words also start in a document with a smaller id.

    Hot names and windows meet only in aggregations that are combined before
    they are shuffled and in joins that Spark splits; it splits joins of plain
    tables, so what was aggregated is written first, without what only one
    document has. Tables go as soon as the next ones are there.
    """
    rows = staged(_surroundings(texts, width), "surroundings")
    names = staged(rows.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("name"), "names")
    shared = staged(rows.join(names, "name"), "shared-names")
    drop_staged(rows, names)
    release(texts.sparkSession)
    kinds = staged(shared.groupBy("name", "around").agg(F.min("doc").alias("least"), F.min("left").alias("left"), F.min("right").alias("right")), "kinds")
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("words")), F.struct(F.lit(1).alias("side"), F.col("right").alias("words"))))
    sides = kinds.select("name", "around", "least", sides).where("words IS NOT NULL")
    met = sides.groupBy("name", "side", "words").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("name", "side", "words")
    met = staged(met, "met")
    mixed = staged(sides.join(met, ["name", "side", "words"]).select("name", "around").distinct().withColumn("mixed", F.lit(True)), "mixed")
    kinds_mixed = staged(kinds.select("name", "around", "least").join(mixed, ["name", "around"], "left"), "kinds-mixed")
    judged = shared.join(kinds_mixed, ["name", "around"]).where("doc > least OR mixed").select("doc", "body", "start", "n", (F.col("doc") > F.col("least")).alias("settled"))
    judged = staged(judged, "judged")
    drop_staged(shared, kinds, met, mixed, kinds_mixed)
    release(texts.sparkSession)
    settled = judged.where("settled").select("doc", "body", "start", "n")
    tasks = judged.where("NOT settled").groupBy("doc", "body").agg(F.collect_list(F.struct("start", "n")).alias("asked"))  # of one text
    tasks = staged(tasks, "asked")
    hashed = texts.join(tasks, ["doc", "body"]).select("doc", "body", "text", "asked").dropDuplicates(["doc", "body"])
    hashed = staged(_window_hashes(hashed, width), "windows")
    least = hashed.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("a", "b", "least")
    least = staged(least, "least")
    found = hashed.join(least, ["a", "b"]).where("doc > least").select("doc", "body", "start", F.lit(1).alias("n"))
    ranges = settled.unionByName(found).groupBy("doc", "body").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))  # of one text
    ranges = staged(ranges, "ranges")
    drop_staged(judged, tasks, hashed, least)
    release(texts.sparkSession)
    return ranges


def remove_repeats(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_text, whole_text, and the columns in ``carry``.

    A word is removed if a window of ``width`` words of its document covers it
    whose words also start in a document with a smaller id; windows are judged
    on the input. kept_text: the other words joined by one space; whole_text:
    the text as it was (null: empty). Null texts
    have no words; null ids come before all others; documents of one id never
    take from each other; equal rows get equal results; an empty table gives no
    rows. No other columns are read.
    """
    source = docs.select(F.col(id_col).alias("id"), *_identity(id_col, text_col), *(named(c).alias(f"c{k}") for k, c in enumerate(carry)))
    texts = docs.select(*_identity(id_col, text_col))
    joined = source.join(covered_windows(texts, width), ["doc", "body"], "left")
    carried = [f"c{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            given = batch.column(2)
            lengths = np.array([0 if x is None else x for x in given.value_lengths().to_pylist()], np.int64)
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            start, n = (x.to_numpy().astype(np.int64) for x in given.flatten().flatten()) if cuts[-1] else (np.zeros(0, np.int64),) * 2
            rest = [batch.column(k) for k in range(3, batch.num_columns)]
            for i, j in slices(offsets):
                w = Words(offsets[i : j + 1], data)
                rows = np.repeat(np.arange(j - i), lengths[i:j])
                own = slice(cuts[i], cuts[j])
                cover = np.zeros(len(w.starts) + 1, np.int64)
                at = start[own] + w.at[rows]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n[own] + width - 1, -1)
                kept = np.cumsum(cover[:-1]) <= 0
                removed = np.concatenate([[0], np.cumsum(~kept)])[w.at]
                words_at = np.concatenate([[0], np.cumsum(kept)])[w.at]
                s, e = w.starts[kept], w.ends[kept]
                size = e - s + 1  # with the space after it
                ends = np.cumsum(size)
                source = np.repeat(s - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                out = np.append(w.data, np.uint8(0x20))[source]
                out[ends - 1] = 0x20
                row_ends = np.concatenate([[0], ends])[words_at]
                full = np.diff(words_at) > 0
                drop = row_ends[1:][full] - 1  # the space after a row's last word
                out = np.delete(out, drop)
                lens = np.diff(row_ends) - full
                at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(w.counts().astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), text, batch.column(1)[i:j], *(c[i:j] for c in rest)], ["id", "n_words", "n_removed", "kept_text", "whole_text", *carried])

    columns = joined.select("id", "text", "ranges", *carried)
    given = columns.schema
    fields = [T.StructField("id", given["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("whole_text", T.StringType())]
    out = columns.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, given[c].dataType) for c in carried)]))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", "whole_text", *(F.col(k).alias(c) for k, c in zip(carried, carry, strict=True)))
