"""Token ids in files, by canonical length-limited Huffman coding.

File format. A table of blocks, in parts that follow each other in document
order. A block holds whole documents and stands for itself: their ids (doc_id),
the number of token ids of each, the codes of all these one after another
(most significant bit first), and the bit offset of every ``STEP``-th code. The
code book (id, length) lies beside the blocks; codes are canonical, so lengths
are enough. Decoding looks up the next ``LIMIT`` bits in a table, for all
checkpoints of a block side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import new_path, staged
from .tokens import byte_level, sliced_texts
from .words import slices, text_bytes

LIMIT = 18
STEP = 128
#: Ids in a block; a longer document is a block of its own.
BLOCK = 1 << 18
END_ID = 2
#: Bytes of ids that are counted at a time.
COUNTED = 8 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); counts are positive."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, chosen = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        chosen.append(at < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(chosen):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (min(take, len(is_leaf)) - k)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Book:
    """Canonical codes: shorter first, then by id. symbols ascend."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = np.asarray(symbols, np.uint32), np.asarray(lengths, np.int64)
        order = np.lexsort((self.symbols, self.lengths))
        sizes = self.lengths[order]
        steps = np.left_shift(np.int64(1), LIMIT - sizes)
        starts = np.cumsum(steps) - steps  # codes as LIMIT-bit numbers, left-aligned
        self.codes = np.zeros(len(order), np.int64)
        self.codes[order] = starts >> (LIMIT - sizes)
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        self.of = np.zeros(size, np.int64)
        self.of[self.symbols] = np.arange(len(self.symbols))
        self.table_symbol = np.zeros(1 << LIMIT, np.uint32)
        self.table_length = np.ones(1 << LIMIT, np.uint8)
        used = int(steps.sum())
        self.table_symbol[:used] = np.repeat(self.symbols[order], steps)
        self.table_length[:used] = np.repeat(sizes.astype(np.uint8), steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes' bits and the bit offset of every STEP-th code."""
        at = self.of[ids]
        lengths, codes = self.lengths[at], self.codes[at].astype(np.uint64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        bits = int(ends[-1]) if len(ends) else 0
        words = np.zeros((bits + 31) // 32 + 2, np.uint64)
        if bits:
            word, room = begins >> 5, (64 - (begins & 31) - lengths).astype(np.uint64)
            placed = codes << room  # in the 64 bits that begin at this word
            edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sums = np.add.reduceat(placed, edges)  # no two codes share a bit
            own = word[edges]  # each once
            words[own] += sums >> np.uint64(32)
            words[own + 1] += sums & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: (bits + 7) // 8], begins[::STEP]

    def decode(self, data: bytes, n: int, marks: np.ndarray) -> np.ndarray:
        """The n ids that encode() was given."""
        words = np.frombuffer(data + bytes(-len(data) % 4 + 8), ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.array(marks, np.int64)
        out = np.zeros((len(at), STEP), np.uint32)
        whole = len(at)
        for k in range(STEP):
            if k and n % STEP and k == n % STEP:  # the last checkpoint's codes end here
                whole -= 1
            live = at[:whole]
            seen = (pairs[live >> 5] >> (64 - LIMIT - (live & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)
            out[:whole, k] = self.table_symbol[seen]
            at[:whole] += self.table_length[seen]
        return out.reshape(-1)[:n]


_books: dict[str, Book] = {}


def _book(key: str, symbols: np.ndarray, lengths: np.ndarray) -> Book:
    """One for each worker."""
    if key not in _books:
        _books.clear()
        _books[key] = Book(symbols, lengths)
    return _books[key]


def _tokenised(texts: DataFrame, path: str, end_id: int) -> DataFrame:
    """id, n, ids, start (the ids before the document in its part, that is, in its task), part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in sliced_texts(batch.column(1)):
                counts, flat = byte_level(path).ids(texts)
                cuts = np.cumsum(counts)
                ends = cuts + np.arange(1, len(cuts) + 1)
                with_end = np.insert(flat, cuts, end_id).astype("<u4").view(np.uint8)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int64)
                tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(with_end)])
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(counts + 1), tokens.cast(pa.binary()), pa.array(done + ends - counts - 1)], ["id", "n", "ids", "start"])
                done += int(ends[-1])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n long, ids binary, start long").withColumn("part", F.spark_partition_id())


def _totals(tokens: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))  # all documents of a batch at once
            for i, j in slices(offsets, COUNTED):
                more = np.bincount(data[offsets[i] : offsets[j]].copy().view("<u4"), minlength=len(seen))
                more[: len(seen)] += seen
                seen = more
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, to: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending id order; returns the folder.

    Null ids come first, null texts are empty, equal rows are written as often
    as they occur, an empty table gives files without blocks. Other columns are
    not read.
    """
    spark = docs.sparkSession
    to = to or new_path(spark, "token-ids")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Each part is a range of documents in order; which rows a part holds is fixed by the table.
    # Texts are put in order, not ids: choosing the ranges reads the rows once more.
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    tokens = staged(_tokenised(texts, path, end_id), "ids")
    totals = np.array([(r["token"], r["n"]) for r in _totals(tokens, 1 << 16).collect()], np.int64).reshape(-1, 2)  # a row for each id of the vocabulary
    totals = totals[np.argsort(totals[:, 0])]
    symbols, lengths = totals[:, 0], code_lengths(totals[:, 1])
    key = to
    sent = spark.sparkContext.broadcast((symbols, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(key, *sent.value)
        held: list[tuple] = []

        def block():
            part, start = held[0][0], held[0][4]
            ids, counts, data = [h[1] for h in held], [h[2] for h in held], b"".join(h[3] for h in held)
            bits, marks = book.encode(np.frombuffer(data, "<u4"))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([marks], pa.list_(pa.int64()))], ["part", "start", "doc_ids", "counts", "codes", "marks"])

        # A task may read any stretches of the parts: a block ends where the next row does not follow.
        size, follows, kind = 0, None, pa.int64()
        for batch in batches:
            kind = batch.column(1).type
            for p, i, n, start, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                if held and ((p, start) != follows or size + n > BLOCK):
                    yield block()
                    size = 0
                held.append((p, i, n, ids.as_buffer().to_pybytes(), start))
                size += n
                follows = (p, start + n)
        if held:
            yield block()

    doc_type = tokens.schema["id"].dataType.simpleString()
    blocks = tokens.select("part", "id", "n", "start", "ids").mapInArrow(run, f"part int, start long, doc_ids array<{doc_type}>, counts array<long>, codes binary, marks array<long>")
    blocks.write.option("compression", "none").parquet(f"{to}/blocks")
    book = spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths, strict=True)], "token long, length int")
    book.coalesce(1).write.parquet(f"{to}/book")
    sent.unpersist()
    return to


def read_ids(spark: SparkSession, folder: str, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row per document of write_ids: id_col, start (ids of all documents before), n_tokens, and ids (array) or ids_crc32.

    A folder written from an empty table gives no rows; one without files is an error.
    """
    rows = spark.read.parquet(f"{folder}/book").collect()  # a row for each id of the vocabulary
    rows.sort(key=lambda r: r["token"])
    sent = spark.sparkContext.broadcast((np.array([r["token"] for r in rows], np.int64), np.array([r["length"] for r in rows], np.int64)))
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    doc_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(folder, *sent.value)
        for batch in batches:
            for part, start, ids, counts, codes, marks in zip(*(batch.column(c) for c in range(6)), strict=True):
                counts = counts.values.to_numpy(zero_copy_only=False)
                flat = book.decode(codes.as_py(), int(counts.sum()), marks.values.to_numpy(zero_copy_only=False))
                ends = np.cumsum(counts)
                begins = ends - counts
                if digest:
                    data = memoryview(flat.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part.as_py()), pa.int32()), ids.values, pa.array(begins + start.as_py()), pa.array(counts), last], ["part", id_col, "begin", "n_tokens", "ids_crc32" if digest else "ids"])

    last = "ids_crc32 long" if digest else "ids array<long>"
    docs = blocks.mapInArrow(run, f"part int, `{id_col}` {doc_type}, begin long, n_tokens long, {last}")
    docs = docs.join(F.broadcast(totals), "part")  # a row for each part
    return docs.select(id_col, (F.col("before") + F.col("begin")).alias("start"), "n_tokens", last.split()[0])
