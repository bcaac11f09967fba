"""Names of a register in texts, where there are too many to go through them one by one.

Up to MOST_SENT names go to all workers, and each builds one automaton
(Aho-Corasick) that finds all of them in a single walk over a text. Of a larger
register a bitmap of hashes goes to them: the places of a text whose hash is
marked are joined with the names. Both find the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..runtime import kept
from .tokenize import _col

#: Names that are sent to all workers; more are joined.
MOST_SENT = 500_000
#: Bits of the bitmap for each name, its size at most (as a power of two: 128 MB), bits set for each name, and signs that are hashed at a time.
NAME_BITS, MOST_BITS, SET, SLICE = 32, 30, 3, 1 << 20


def register(names: DataFrame, name: str = "name", no: str = "no") -> DataFrame:
    """no, name: distinct names, each with its least number; null and empty ones are left out."""
    return names.where(F.col(name) != "").groupBy(F.col(name).alias("name")).agg(F.min(no).alias("no")).select("no", "name")


def _sent(names: DataFrame, most: int) -> list[tuple[int, str]] | None:
    rows = names.select("no", "name").limit(most + 1).collect()  # most + 1 rows
    return None if len(rows) > most else sorted((r["no"], r["name"]) for r in rows)


class Automaton:
    """All names at once; built on first use in a worker."""

    def __init__(self, names: list[tuple[int, str]]):
        self.names, self.made = names, None

    def __getstate__(self):
        return self.names

    def __setstate__(self, names):
        self.names, self.made = names, None

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """place in the list, start, end (exclusive) of every occurrence of every name, those inside others included."""
        import ahocorasick

        if self.made is None:
            self.made = ahocorasick.Automaton()
            for k, (_, name) in enumerate(self.names):
                self.made.add_word(name, (k, len(name)))
            self.made.make_automaton()
        return [(k, end + 1 - n, end + 1) for end, (k, n) in self.made.iter(text)] if self.names and text else []

    def masked(self, text: str, mask: str) -> str:
        """As if each name in turn were replaced from left to right: a place that an earlier name has taken is gone for later ones."""
        taken, spans = bytearray(len(text)), []
        for _, start, end in sorted(self.found(text)):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                spans.append((start, end))
        out, at = [], 0
        for start, end in sorted(spans):
            out += [text[at:start], mask]
            at = end
        return "".join([*out, text[at:]])


def find(texts: DataFrame, id_col: str, text: str, names: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """id, no, name: the names (no, name; see register) that each text holds anywhere, each once. Null texts hold none."""
    names = kept(names.select("no", "name"))
    if names.count() > most_sent:
        return _joined(texts, id_col, text, names)
    sent = _sent(names, most_sent)
    shared = texts.sparkSession.sparkContext.broadcast(Automaton(sent))

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield t.map(lambda x: sorted({k for k, _, _ in shared.value.found(x)}) if x else [])

    held = texts.select(F.col(id_col).alias("id"), F.explode(places(text)).alias("place"))
    listed = texts.sparkSession.createDataFrame([(k, no, name) for k, (no, name) in enumerate(sent)], "place int, no long, name string")
    return held.join(listed, "place").select("id", F.col("no").cast(names.schema["no"].dataType).alias("no"), "name")


def _joined(texts: DataFrame, id_col: str, text: str, names: DataFrame) -> DataFrame:
    """Stretches of a text that are as long as a name and whose hash is marked meet the names, each once for a text.

    A text is hashed once for each length that names have. What is marked by
    chance goes in the join, where signs are compared.
    """
    told = names.agg(F.count("*").alias("n"), F.collect_set(F.length("name")).alias("lengths")).first()  # one row
    if not told["n"]:
        return names.limit(0).crossJoin(texts.select(F.col(id_col).alias("id")).limit(0)).select("id", "no", "name")
    lengths, bits = sorted(told["lengths"]), min(MOST_BITS, max(15, (NAME_BITS * told["n"] - 1).bit_length()))
    marks = texts.sparkSession.sparkContext.broadcast(_marks(names, bits))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in _slices(batch.column(1)):
                row, found = _marked(values, lengths, marks.value, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), pa.array(found, pa.string())], names=["id", "name"])

    body = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    found = body.mapInArrow(stretches, f"id {body.schema['id'].dataType.simpleString()}, name string")
    return found.join(names, "name").select("id", "no", "name")


def _marks(names: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all names: 2 ** ``bits`` bits, put together where the names lie; the driver gets the bitmap only."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values in _slices(batch.column(0)):
                hashes = Hashed(values).whole()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_bit(hashes, k, bits) for k in range(SET)]) + 1)], names=["bit"])

    marked = names.select("name").mapInArrow(places, "bit long").select(F.bitmap_bucket_number("bit").alias("part"), F.bitmap_bit_position("bit").alias("at"))
    parts = marked.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))  # dealt first: a part is made once
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():  # the bitmap
        begin = (r["part"] - 1) * len(r["bits"])
        out[begin : begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of slices of about SLICE signs."""
    first, values, size = 0, [], 0
    for n, x in enumerate(texts):
        values.append(x.as_py())
        size += len(values[-1])
        if size >= SLICE:
            yield first, values
            first, values, size = n + 1, [], 0
    if values:
        yield first, values


#: Odd, so that it has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15


def _scramble(x: np.ndarray) -> np.ndarray:
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _bit(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit of each hash."""
    return ((hashes + np.uint64(k) * (hashes >> np.uint64(32) | np.uint64(1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Hashed:
    """Texts in a row, with sums from which the hash of any stretch follows: equal stretches of equal length have equal hashes."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        signs = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.row = np.repeat(np.arange(len(texts)), sizes)
        raised = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(signs), base, np.uint64)]))
        self.back = raised(pow(_BASE, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_scramble(signs + np.uint64(1)) * raised(_BASE)[:-1])])

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _scramble((self.sums[end] - self.sums[begin]) * self.back[begin])

    def whole(self) -> np.ndarray:
        return self.of(self.begins, self.ends)


def _marked(texts: list[str], lengths: list[int], marks: np.ndarray, bits: int) -> tuple[np.ndarray, list[str]]:
    """The row of each marked stretch, and the stretch, each once for a text."""
    own, rows, found = Hashed(texts), [np.zeros(0, np.int64)], []
    left = own.ends[own.row] - np.arange(len(own.row))  # signs from each place to the end of its text
    for n in lengths:
        if n > len(own.row):
            break
        hashes = own.of(slice(0, len(own.sums) - n), slice(n, None))
        at = np.flatnonzero(left[: len(hashes)] >= n)
        for k in range(SET):
            bit = _bit(hashes[at], k, bits)
            at = at[(marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        row, pieces = own.row[at], [own.text[i : i + n] for i in at.tolist()]
        once = list(dict.fromkeys(zip(row.tolist(), pieces, strict=True)))
        rows.append(np.array([r for r, _ in once], np.int64))
        found += [x for _, x in once]
    return np.concatenate(rows), found


def redactor(names: DataFrame, mask: str = C.STUDENT_MASK, most_sent: int = MOST_SENT) -> Callable[[Column | str], Column]:
    """A column function like text.redact for a register (no, name; in order of no): names and long numbers give way to masks.

    Names that share a sign with the mask could match what replaced another name,
    and registers beyond ``most_sent`` names cannot be sent: both are errors.
    """
    sent = _sent(names, most_sent)
    if sent is None:
        raise ValueError(f"more than {most_sent} names; mask what find() returns")
    if any(set(name) & set(mask) for _, name in sent):
        raise ValueError("a name shares signs with the mask")
    shared = names.sparkSession.sparkContext.broadcast(Automaton(sent))

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield t.map(lambda x: shared.value.masked(x, mask) if x else x)

    return lambda text: F.regexp_replace(masked(_col(text)), C.LONG_NUMBER, C.NUMBER_MASK)
