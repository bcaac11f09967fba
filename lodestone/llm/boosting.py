"""Quality scores by histogram gradient-boosted trees over document statistics.

Trees are grown level by level from histograms of binned statistics and laid
flat in arrays (feature, threshold, children, value), through which all rows of
a batch go down together. Labels, language, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics

TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 150, 4, 0.1, 64, 20, 1.0
#: Labelled rows learnt from at most: those whose hashed id is smallest.
SAMPLE = 20_000


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each text: sizes as logarithms, the rest as shares."""
    words = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["n_bytes"] - s["n_more"], 1)
    lines = np.maximum(s["n_lines"], 1)
    parts = [np.log1p(s["n_words"]), s["word_chars"] / words, s["longest_word"], s["long_words"] / words]
    parts += [s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_distinct_words"] / words]
    parts += [np.log(np.maximum(s["n_distinct_words"], 1)) / np.log(words + 1)]
    parts += [s[f"n_{k}"] / chars for k in ("lower", "upper", "digit", "space", "newline", "stop", "mark", "lead")]
    parts += [words / lines, s["n_marked_words"] / words, s["n_ended_words"] / words, s["n_dup_lines"], s["n_stop"] / words]
    return np.stack(parts, 1).astype(np.float64)


@dataclass
class Forest:
    """Trees of DEPTH levels, each in 2**(DEPTH + 1) - 1 places of the arrays; a leaf's children are itself."""

    start: float
    feature: np.ndarray  # trees x places
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                down = x[rows, self.feature[t][at]] <= self.threshold[t][at]
                at = np.where(down, self.left[t][at], self.right[t][at])
            total += self.value[t][at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss. Without rows, or with one kind of label, a constant."""
    places = 2 ** (DEPTH + 1) - 1
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        none = np.zeros((0, places))
        return Forest(start, none.astype(int), none, none.astype(int), none.astype(int), none)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, width = x.shape
    shift = binned + np.arange(width) * BINS
    out = {k: np.zeros((TREES, places)) for k in ("threshold", "value")} | {k: np.tile(np.arange(places), (TREES, 1)) for k in ("left", "right")} | {"feature": np.zeros((TREES, places), int)}
    total = np.full(n, start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH + 1):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                out["value"][t, node] = -RATE * gs / (hs + RIDGE)
                if level == DEPTH or len(rows) < 2 * LEAST_ROWS:
                    continue
                flat = shift[rows].ravel()
                size = width * BINS
                gh = np.bincount(flat, np.repeat(g[rows], width), size).reshape(width, BINS).cumsum(1)
                hh = np.bincount(flat, np.repeat(h[rows], width), size).reshape(width, BINS).cumsum(1)
                ch = np.bincount(flat, minlength=size).reshape(width, BINS).cumsum(1)
                gain = gh**2 / (hh + RIDGE) + (gs - gh) ** 2 / (hs - hh + RIDGE) - gs**2 / (hs + RIDGE)
                gain[(ch < LEAST_ROWS) | (len(rows) - ch < LEAST_ROWS)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-9 or b >= len(edges[f]):
                    continue
                out["feature"][t, node], out["threshold"][t, node] = f, edges[f][b]
                out["left"][t, node], out["right"][t, node] = 2 * node + 1, 2 * node + 2
                down = binned[rows, f] <= b
                at[rows] = np.where(down, 2 * node + 1, 2 * node + 2)
        total += out["value"][t][at]
    return Forest(start, out["feature"], out["threshold"], out["left"], out["right"], out["value"])


def held_out(id_col: str):
    """True for the fifth of ids that is never learnt from; a null id is never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fits a forest on at most ``sample`` labelled documents outside the held-out fifth; both tables are read whole.

    Of several labels of one id the largest counts; null labels and ids, and
    labels without a document, are passed over; a document that is repeated is
    learnt as often. Without labelled documents the forest is a constant.
    """
    chosen = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("key")).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s in statistics.of_batch(batch.column(2)):
                x = features(s)
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], values], ["id", "label", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"id {kind}, label int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(sample).toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64) if rows.num_rows else np.zeros((0, 1))
    return fit(x, rows["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted.

    Every whole text is scored; null texts as empty ones. Null ids are kept and
    count as held out; equal texts get equal scores; an empty table gives no
    rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s in statistics.of_batch(batch.column(2)):
                p = forest.score(features(s))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
