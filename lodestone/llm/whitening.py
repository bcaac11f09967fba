"""Whitening of embeddings along their leading components, without forming a covariance matrix.

Vectors become whole numbers, x = floor(256 c). What is fitted is each distinct
x once. The leading eigenvectors of its covariance come from block Lanczos:
in each round Spark passes over the fit list once and returns the covariance
times a block of directions; the block is orthogonalised twice against all
directions so far, and the Rayleigh quotients in their span give eigenvectors
and, from the same products, their true residuals. A block that loses rank is
filled up with new directions; where the basis would grow past MOST_BLOCKS it
is restarted from its best eigenvectors. The rounds end when the residuals are
at the limit of double precision or the basis spans the space.

A pass returns one row of numbers for each task and direction, summed by Spark;
the driver holds the basis, which has as many rows as a vector has entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, named, staged

#: Entries are kept to this part of one.
UNIT = 256
#: Directions of a pass; blocks before the basis is restarted.
BLOCK, MOST_BLOCKS = 16, 16
#: A residual of this part of the largest eigenvalue is rounding; one of NEAR_TOLERANCE too, if rounds no longer halve it.
TOLERANCE, NEAR_TOLERANCE = 1e-14, 1e-11
#: Eigenvalues below this part of the trace are zero.
NOTHING = 1e-13
_SEED = 20_611


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>) of the vectors whose entries are all finite numbers.

    -0 is 0; entries past the range of a long stop at its ends. An empty vector stays.
    """
    e = named(embedding)
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    x = F.transform(e, lambda c: F.floor(c.cast("double") * UNIT))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(named(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _small(x: np.ndarray, n: int, s: list[int]) -> bool:
    """Whether n * x - s, its squares and their sum fit 64 bits."""
    largest = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, s), default=0)
    return largest * largest * max(x.shape[1], 1) < 2**62


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum over entries of (n * x - s) ** 2 for each row, exact."""
    if _small(x, n, s):
        d = x * n - np.array(s, np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(s, object)
    return (d * d).sum(1).tolist() if d.shape[1] else [0] * len(x)


@dataclass
class Model:
    """n and s (sums of entries) of the fit list; vectors (a column for each component), values, trace; error of the whitening."""

    n: int
    s: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None

    @property
    def scaled(self) -> np.ndarray:
        """Components over the deviation along them; nothing (nan) where there is none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > NOTHING * self.trace, self.vectors / np.sqrt(self.values), np.nan)


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    return x.astype(np.float64) - np.array([v / n for v in s])


def _summed(fit: DataFrame, rows: int, columns: int, part) -> np.ndarray:
    """Sum over all batches of ``part(x)`` (rows x columns), a row for each task and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for b in batches:
            if b.num_rows:
                total += part(b.column(0))
        at = np.arange(rows * columns)
        yield pa.RecordBatch.from_arrays([pa.array(at // columns, pa.int32()), pa.array(at % columns, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((rows, columns))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # rows x columns numbers
        out[r["i"], r["j"]] = r["v"]
    return out


def covariance_times(fit: DataFrame, n: int, s: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of the fit list times a block of directions, in one pass; and its trace, from the exact deviations."""
    d, b = block.shape

    def part(column: pa.Array) -> np.ndarray:
        x = _matrix(column, d)
        c = _centred(x, n, s)
        spread = np.zeros((1, b))
        spread[0, 0] = float(sum(deviations(x, n, s))) / n / n
        return np.concatenate([c.T @ (c @ block), spread])

    got = _summed(fit, d + 1, b, part) / n
    return got[:d], float(got[d, 0])


def _orthonormal(block: np.ndarray, basis: np.ndarray, room: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """At most ``room`` directions that span ``block`` outside the basis; lost ones are replaced by new ones (a breakdown)."""
    out = np.zeros((len(block), 0))
    for k in range(min(block.shape[1], room)):
        v, least = block[:, k], 1e-10 * scale
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                v = v / size
                for _ in range(2):  # what was left may have been mostly rounding
                    v = v - basis @ (basis.T @ v)
                    v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, least = rng.standard_normal(len(block)), 1e-3
    return out


def block_lanczos(times, d: int, wanted: int, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric map of dimension d.

    ``times``: the map, applied to a block of directions.
    """
    rng = np.random.default_rng([_SEED, d])
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthonormal(rng.standard_normal((d, min(max(block, wanted), d))), basis, d, 1.0, rng)
    best, stays = np.inf, 0
    while True:
        image = times(new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        k = min(wanted, len(values))
        vectors = basis @ turns[:, :k]
        left = np.linalg.norm(images @ turns[:, :k] - vectors * values[:k], axis=0)
        scale = max(abs(values[0]), np.finfo(float).tiny)
        stays = 0 if left.max() < best / 2 else stays + 1
        best = min(best, left.max())
        if basis.shape[1] >= d or left.max() <= TOLERANCE * scale or stays > 2 and left.max() <= NEAR_TOLERANCE * scale:
            return values[:k], vectors / np.linalg.norm(vectors, axis=0)
        follow = image
        if basis.shape[1] + new.shape[1] > most_blocks * block:
            keep = turns[:, : max(2 * wanted, block)]
            # the residuals of what is kept lie in the next block, so they are taken from the whole basis first
            follow = image - basis @ (basis.T @ image)
            basis, images = basis @ keep, images @ keep
        new = _orthonormal(follow, basis, d - basis.shape[1], scale, rng)


def fit_model(fit: DataFrame, d: int, components: int = 4) -> Model:
    """Components of the distinct vectors (one column x) of d entries."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, object)
        for b in batches:
            x = _matrix(b.column(0), d)
            safe = len(x) * float(np.abs(x.astype(np.float64)).max(initial=0)) < 2**62
            s = s + (x.sum(0).astype(object) if safe else x.astype(object).sum(0))
            n += len(x)
        if n:
            parts = [n, *map(int, s)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(v) for v in parts])], names=["i", "v"])

    told = fit.mapInArrow(sums, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # d + 1 numbers
    total = {r["i"]: int(r["v"]) for r in told}
    n, s = total[0], [total[k + 1] for k in range(d)]
    trace: list[float] = []

    def times(block: np.ndarray) -> np.ndarray:
        image, spread = covariance_times(fit, n, s, block)
        trace.append(spread)
        return image

    values, vectors = block_lanczos(times, d, components)
    model = Model(n, s, vectors, values, trace[0], None)
    some = np.isfinite(model.scaled).all(0)
    if some.any():
        w = model.scaled[:, some]
        k = w.shape[1]

        def part(column: pa.Array) -> np.ndarray:
            y = _centred(_matrix(column, d), n, s) @ w
            return np.concatenate([y.T @ y, y.sum(0)[None]])

        got = _summed(fit, k + 1, k, part) / n
        model.error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    return model


def project(rows: DataFrame, model: Model) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of vectors (vec_id, x) of the model's dimension."""
    scaled, d = model.scaled, len(model.s)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = scaled.shape[1]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                x = _matrix(some.column(1), d)
                deviation = pa.array([v if v < 1 << 63 else None for v in deviations(x, model.n, model.s)], pa.int64())
                white = (_centred(x, model.n, model.s) @ scaled).ravel()
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                shares = [float(v / model.trace) if model.trace > 0 else None for v in np.maximum(model.values, 0)]
                columns = [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)), deviation.take(each), pa.array(white, mask=np.isnan(white)), pa.array(shares * m, pa.float64()), pa.array([model.error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every vector of finite entries.

    Vectors that are null or hold null, NaN or infinite entries give no rows, nor
    do empty ones. Vectors of different lengths are fitted apart, each length by
    itself (one loop of jobs for each). Repeated vectors count once in the fit
    and each give rows; null ids stay. A component without variance (fewer
    distinct vectors than components) has a null ``whitened`` and the share 0;
    a single distinct vector has no trace, so its shares are null. Vectors of
    fewer entries than components have as many components as entries. A deviation
    past 63 bits is null. Of an empty table nothing comes. Other columns are ignored.
    """
    rows = whole_numbers(vectors, vec_id, embedding)
    fit = staged(rows.select("x").distinct().select("x", F.size("x").alias("d")), "fit")
    dims = [r["d"] for r in fit.groupBy("d").agg(F.count("*")).orderBy("d").collect() if r["d"] > 0]  # one row for each length
    out = None
    for d in dims:
        model = fit_model(fit.where(F.col("d") == d).select("x"), d, components)
        part = project(rows.where(F.size("x") == d), model)
        out = part if out is None else out.unionByName(part)
    drop_staged(fit)
    if out is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        out = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out
