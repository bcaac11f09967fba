"""Harmonic packing of tokenised documents into sequences.

Documents of n tokens, C / (k + 1) < n <= C / k for the capacity C, are class k:
k of them, uncut, fill a bin of their class. Each worker fills its own bins as
documents come, so nothing is shuffled and no class meets in one place. What a
full bin has left is filled from documents longer than the capacity, which have
to be cut anyway. Where those do not suffice, a short document goes whole into
the open rest it fits best, and only if it fits none is it cut over several.
The bins not yet full at the end of a worker's part are taken apart, their
documents fill the rests still open, and what is left follows each other in
sequences, so a part has one sequence with padding beside rests that nothing
was left for.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged
from .tokens import byte_level, sliced_texts

CAPACITY = 1024
END_ID = 0
#: Tokens of long documents that a worker holds back for rests, in capacities; rests that it leaves open before short documents fill them.
RESERVE, OPEN_RESTS = 64, 256


class Document:
    """Ids not yet placed of one document."""

    __slots__ = ("row", "ids", "at", "n")

    def __init__(self, row, ids: bytes):
        self.row, self.ids, self.at, self.n = row, ids, 0, len(ids) // 4

    @property
    def left(self) -> int:
        return self.n - self.at

    def cut(self, size: int) -> tuple:
        """row, start, length, checksum, tokens of the document of the next ``size`` ids."""
        start, self.at = self.at, self.at + size
        return self.row, start, size, zlib.crc32(memoryview(self.ids)[4 * start : 4 * self.at]), self.n


class Bins:
    """The sequences of one part. Finished pieces gather in ``out``: (row, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.made, self.out = capacity, 0, []
        self.classes: dict[int, list[Document]] = {}
        self.rests: list[tuple[int, int]] = []  # (open places, sequence), ascending
        self.reserve: list[Document] = []
        self.held = 0

    def _place(self, piece: tuple, sequence: int, offset: int) -> None:
        self.out.append((*piece, sequence, offset))

    def _sequence(self) -> int:
        self.made += 1
        return self.made - 1

    def _into_rests(self, doc: Document) -> None:
        """What is left of the document goes into open rests, the largest first."""
        while doc.left and self.rests:
            room, sequence = self.rests.pop()
            size = min(room, doc.left)
            self._place(doc.cut(size), sequence, self.capacity - room)
            if room > size:
                insort(self.rests, (room - size, sequence))

    def _whole_into_rest(self, doc: Document) -> bool:
        """A document goes uncut into the smallest rest that holds it, if there is one."""
        k = bisect_left(self.rests, (doc.left, -1))
        if k == len(self.rests):
            return False
        room, sequence = self.rests.pop(k)
        size = doc.left
        self._place(doc.cut(size), sequence, self.capacity - room)
        if room > size:
            insort(self.rests, (room - size, sequence))
        return True

    def add(self, doc: Document) -> None:
        if doc.n > self.capacity:
            self._into_rests(doc)
            if doc.left and self.held < RESERVE * self.capacity:
                self.reserve.append(doc)
                self.held += doc.left
                return
            while doc.left >= self.capacity:
                self._place(doc.cut(self.capacity), self._sequence(), 0)
            if not doc.left:
                return
            if doc.at:
                self._shelve(doc)
                return
        if len(self.rests) >= OPEN_RESTS:
            if self._whole_into_rest(doc):
                return
            if len(self.rests) >= 2 * OPEN_RESTS:
                self._into_rests(doc)
                return
        self._shelve(doc)

    def _shelve(self, doc: Document) -> None:
        """Into its class; a class that has its number makes a sequence."""
        k = self.capacity // doc.left
        shelf = self.classes.setdefault(k, [])
        shelf.append(doc)
        if len(shelf) < k:
            return
        sequence, at = self._sequence(), 0
        for d in shelf:
            size = d.left
            self._place(d.cut(size), sequence, at)
            at += size
        shelf.clear()
        while at < self.capacity and self.reserve:
            d = self.reserve[-1]
            size = min(self.capacity - at, d.left)
            self._place(d.cut(size), sequence, at)
            at, self.held = at + size, self.held - size
            if not d.left:
                self.reserve.pop()
        if at < self.capacity:
            insort(self.rests, (self.capacity - at, sequence))

    def end(self) -> None:
        """Everything still held is placed."""
        held = sorted((d for shelf in self.classes.values() for d in shelf), key=lambda d: -d.left)
        self.classes.clear()
        for d in self.reserve:
            while d.left >= self.capacity:
                self._place(d.cut(self.capacity), self._sequence(), 0)
            if d.left:
                held.append(d)
        self.reserve, self.held = [], 0
        held = [d for d in held if not self._whole_into_rest(d)]
        sequence, at = None, self.capacity
        for d in held:
            if self.rests and d.left <= sum(room for room, _ in self.rests[-8:]):
                self._into_rests(d)
            while d.left:
                if at == self.capacity:
                    sequence, at = self._sequence(), 0
                size = min(self.capacity - at, d.left)
                self._place(d.cut(size), sequence, at)
                at += size

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]


def _packed(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of each part, sequences numbered from 0 in each; one pass over the texts."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, end, id_type = Bins(capacity), np.array([end_id], "<u4").tobytes(), pa.int64()

        def told() -> pa.RecordBatch:
            columns = list(zip(*bins.taken(), strict=True)) or [()] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], _NAMES)

        for batch in batches:
            ids = batch.column(0)
            id_type = ids.type
            for i, j, texts in sliced_texts(batch.column(1)):
                counts, flat = byte_level(path).ids(texts)
                data, ends = flat.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                for row, e, n in zip(ids.slice(i, j - i).to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                    bins.add(Document(row, data[e - 4 * n : e] + end))
                yield told()
        bins.end()
        yield told()

    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in _NAMES[1:])).withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and ``end_id``; its
    pieces follow each other without gaps. Sequences are numbered from 0, part
    by part. Nothing is dropped. Null ids are kept; equal rows are packed as
    often as they occur; an empty table gives no rows. Other columns are not
    read, whatever their names. Which documents share a sequence depends on
    the parts in which Spark reads the table; they are pinned in a table.
    """
    pieces = staged(_packed(docs, path, capacity, end_id, id_col, text_col), "pack-pieces")
    parts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("sequences"))  # a row for each part
    before = F.coalesce(F.sum("sequences").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(parts.select("part", before.alias("before")), "part")
    return numbered.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")
