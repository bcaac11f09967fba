"""Quality rules: fixed base rules, then robust multivariate outliers.

The statistics of every document that passes the base rules are transformed to
a short vector. For each language and source, for each language, and for all
together, centre and covariance are those of the half of the documents that has
the least determinant of its covariance (minimum covariance determinant).
Concentration steps look for it: distances to the present estimate, the share
SUPPORT of documents nearest to it, their mean and covariance, and so on. Each
group begins from three estimates (median and floors, median and the spread of
the middle, mean and covariance of all); after TRIED steps the one of least
determinant goes on until its determinant stays. Each step is two small
aggregations; the nearest documents are found by a histogram of distances, so
no group is ever gathered. The rows of the step in which the share is reached
count in part, so that they add up to the share and a group of copies never
enters beyond it.

A group of n documents weighs n / (n + SHRINK) in its own estimate; the rest is
its language's, and a language's likewise that of all documents. Documents
whose squared Mahalanobis distance from the estimate of their language and
source is beyond CUTOFF are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import statistics
from .staging import drop_staged, named, staged

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The vector, and the least standard deviation of each part: below it,
#: differences do not matter, however alike the other documents are. At the
#: floor of root_dup_lines, a share of repeated lines over two thirds is beyond
#: CUTOFF by itself; of root_repeats, the base rules have taken what is far.
PARTS = {"log_word": 0.10, "root_symbols": 0.05, "root_dup_lines": 0.12, "root_repeats": 0.10}
SUPPORT = 0.5
#: Steps of all starts; the best then goes on as long as the logarithm of its determinant falls by more than STABLE.
TRIED, STABLE = 2, 1e-3
#: chi-square with four degrees of freedom: one in 10^9 documents that follow the estimate lies beyond.
CUTOFF = 47.0
#: The factor that makes the covariance of the nearest SUPPORT of normal vectors in four dimensions that of all.
CONSISTENT = 1.0 / 0.4741
#: A group of so many documents counts for half in its own estimate.
SHRINK = 60
#: And its correlations for half, so that no few rows have a covariance without an inverse.
FEW = 2
#: Steps of the distance histogram to a doubling of 1 + distance.
FINE = 32


def base_statistics(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """id, carried columns and BASE and n_lines of each text."""
    names = (*BASE, "n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            for i, j, s in statistics.of_batch(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in rest), *(pa.array(s[n].astype(np.int64)) for n in names)], ["id", *carried, *names])

    carried = [f"c{k}" for k in range(len(carry))]
    source = docs.select(F.col(id_col).alias("id"), *(named(c).alias(k) for c, k in zip(carry, carried, strict=True)), F.col(text_col).alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, ", ".join([kept, *(f"{n} long" for n in names)]))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("log_word"),
        F.sqrt(F.col("n_symbols") / n).alias("root_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("root_dup_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("root_repeats"),
    ]


_P = tuple(PARTS)
_K = len(_P)
_CROSS = [(i, j) for i in range(_K) for j in range(i, _K)]
_FLOORS = np.array(list(PARTS.values())) ** 2
_ESTIMATE = "grp string, start int, n double, mean array<double>, cov array<double>, inverse array<double>, logdet double"


def _told(grp: str, start: int, n: float, mean: np.ndarray, cov: np.ndarray) -> tuple:
    return grp, start, n, mean.round(12).tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().round(9).tolist(), float(np.linalg.slogdet(cov)[1])


def floored(cov: np.ndarray, n: float) -> np.ndarray:
    """Added to the diagonal only as far as a part lacks it; correlations of parts at their floor go, and those of few (n) rows count less."""
    own = np.maximum(np.diag(cov), 0)
    scale = np.sqrt(np.minimum(1.0, own / _FLOORS))
    cov = cov * np.outer(scale, scale) * (n / (n + FEW))
    np.fill_diagonal(cov, np.maximum(own, _FLOORS))
    return cov


def _moments(rows: DataFrame, weight: str = "1.0D", factor: float = CONSISTENT) -> DataFrame:
    """The estimate of each group and start from its rows, which count by ``weight``."""
    w = F.expr(weight)
    sums = [F.sum(w * F.col(p)).alias(p) for p in _P] + [F.sum(w * F.col(_P[i]) * F.col(_P[j])).alias(f"x{i}{j}") for i, j in _CROSS]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[p] for p in _P]) / r["n"]
                cov = np.zeros((_K, _K))
                for i, j in _CROSS:
                    cov[i, j] = cov[j, i] = r[f"x{i}{j}"] / r["n"] - mean[i] * mean[j]
                out.append(_told(r["grp"], r["start"], r["n"], mean, floored(cov * factor, r["n"])))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _ESTIMATE.split(", ")])

    return rows.groupBy("grp", "start").agg(F.sum(w).alias("n"), *sums).mapInPandas(solve, _ESTIMATE)


def _starts(rows: DataFrame) -> DataFrame:
    """0: medians (to a hundredth) and the floors; 1: medians and half the width of the middle two thirds; 2: mean and covariance of all."""
    parts = F.posexplode(F.array(*(F.round(F.col(p) * 100).cast("int") for p in _P))).alias("part", "bin")
    bins = rows.select("grp", parts).groupBy("grp", "part", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("grp", "part").orderBy("bin"))
    total = F.sum("n").over(W.partitionBy("grp", "part"))
    reached = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bin") / 100.0))
    parts = bins.select("grp", "part", "bin", upto.alias("upto"), total.alias("total")).groupBy("grp", "part").agg(F.max("total").alias("n"), reached(0.16).alias("low"), reached(0.5).alias("m"), reached(0.84).alias("high"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                told = sorted(r["parts"], key=lambda x: x["part"])
                middle = np.array([x["m"] for x in told])
                spread = np.array([(x["high"] - x["low"]) / 2 for x in told])
                out += [_told(r["grp"], 0, r["n"], middle, np.diag(_FLOORS)), _told(r["grp"], 1, r["n"], middle, np.diag(np.maximum(spread**2, _FLOORS)))]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _ESTIMATE.split(", ")])

    medians = parts.groupBy("grp").agg(F.max("n").cast("double").alias("n"), F.collect_list(F.struct("part", "low", "m", "high")).alias("parts"))  # an entry for each part
    return medians.mapInPandas(solve, _ESTIMATE).unionByName(_moments(rows.withColumn("start", F.lit(2)), factor=1.0))


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with their squared distance from each estimate of their group."""
    d = [F.col(p) - F.col("mean")[i] for i, p in enumerate(_P)]
    square = sum((d[i] * d[j] * F.col("inverse")[i * _K + j] * (1 if i == j else 2) for i, j in _CROSS), F.lit(0.0))
    return rows.join(estimate.select("grp", "start", "mean", "inverse"), "grp").withColumn("distance", F.greatest(square, F.lit(0.0))).drop("mean", "inverse")


def _nearest(measured: DataFrame) -> DataFrame:
    """The rows up to the histogram step in which the share SUPPORT of their group is reached, with their ``weight``: in that step the part of it that is needed, 1 before."""
    key = ["grp", "start"]
    measured = measured.withColumn("step", F.floor(F.log2(F.col("distance") + 1) * FINE).cast("int"))
    steps = measured.groupBy(*key, "step").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    needed = F.sum("n").over(W.partitionBy(*key)) * SUPPORT - before
    steps = steps.select(*key, "step", (needed / F.col("n")).alias("part")).where("part > 0")
    # Written, so that Spark knows its size, and can split a hot group where it is too large to broadcast.
    edge = staged(steps.groupBy(*key).agg(F.max("step").alias("edge"), F.least(F.lit(1.0), F.max_by("part", "step")).alias("part")), "edge")
    weight = F.when(F.col("step") < F.col("edge"), 1.0).otherwise(F.col("part"))
    return measured.join(edge, key).where("step <= edge").withColumn("weight", weight).drop("edge", "part", "step")


def _concentrated(rows: DataFrame) -> DataFrame:
    """grp, start, n, mean, cov and so on of the least determinant that the steps find for each group.

    Each group goes on by itself until its determinant falls no more; only
    groups that still fall are measured again. Determinants are bounded below
    by the floors of the parts, so a group takes finitely many steps.
    """
    estimate = staged(_starts(rows), "estimate")
    for _ in range(TRIED):
        before, estimate = estimate, staged(_moments(_nearest(_measured(rows, estimate)), "weight"), "estimate")
        drop_staged(before)
    best = estimate.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    falling, done = staged(estimate.join(best, ["grp", "start"]), "best-start"), []
    columns = [F.col(c) for c in estimate.columns]
    while True:
        new = _moments(_nearest(_measured(rows, falling)), "weight")
        was = falling.select("grp", F.struct(*columns).alias("was"))
        pair = staged(new.join(was, "grp").select(F.struct(*columns).alias("now"), "was", (F.col("was.logdet") - F.col("logdet")).alias("fell")), "estimate")
        done.append(pair.where(F.col("fell") <= STABLE).select(F.when(F.col("fell") >= 0, F.col("now")).otherwise(F.col("was")).alias("e")).select("e.*"))
        falling = pair.where(F.col("fell") > STABLE).select("now.*")
        if falling.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return staged(out, "estimate")


def shrunk(n: float, mean: np.ndarray, cov: np.ndarray, to_mean: np.ndarray, to_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group of n documents and of what it belongs to, by its weight."""
    w = n / (n + SHRINK)
    return w * mean + (1 - w) * to_mean, w * cov + (1 - w) * to_cov


def _final(estimate: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, start, mean, inverse for each language and source; groups: all_grp, lang_grp, grp, n and lang_n (documents)."""
    e = estimate.select("grp", "mean", "cov")
    rows = groups
    for k, name in enumerate(("all_grp", "lang_grp", "grp")):
        rows = rows.join(e.select(F.col("grp").alias(f"g{k}"), F.col("mean").alias(f"mean{k}"), F.col("cov").alias(f"cov{k}")), F.col(name) == F.col(f"g{k}")).drop(f"g{k}")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                (m0, c0), (m1, c1), (m2, c2) = ((np.array(r[f"mean{k}"]), np.array(r[f"cov{k}"]).reshape(_K, _K)) for k in range(3))
                mean, cov = shrunk(r["n"], m2, c2, *shrunk(r["lang_n"], m1, c1, m0, c0))
                out.append((r["grp"], 0, mean.tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pd.DataFrame(out, columns=["grp", "start", "mean", "inverse"])

    return rows.mapInPandas(solve, "grp string, start int, mean array<double>, inverse array<double>")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, BASE, base_failed, distance, kept.

    base_failed: fewer than ten words, or over 20 % of words in repeated 5-word
    windows; such documents take no part in the estimates, have no distance and
    are not kept. Null texts are empty (base_failed); null languages and
    sources are values of their own; null ids are kept; equal rows get equal
    verdicts; an empty table gives no rows. Columns in ``carry`` are returned
    as c2, c3, ...; no other columns are read.
    """
    rows = staged(base_statistics(docs, id_col, text_col, (lang_col, source_col, *carry)), "document-statistics")
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    rows = rows.withColumn("base_failed", failed)
    others = [f"c{k + 2}" for k in range(len(carry))]
    names = {"all_grp": F.lit("all"), "lang_grp": F.to_json(F.struct(F.col("c0").alias("l"))), "grp": F.concat(F.lit("s"), F.to_json(F.struct(F.col("c0").alias("l"), F.col("c1").alias("s"))))}
    passing = staged(rows.where("NOT base_failed").select("id", *others, *BASE, *vector(), *(c.alias(n) for n, c in names.items())), "document-vectors")
    # The steps need the vectors alone, in each of their three groups.
    vectors = passing.select(F.explode(F.array(*names)).alias("grp"), *_P)
    groups = staged(passing.groupBy(*names).agg(F.count("*").alias("n")), "groups")
    groups = groups.withColumn("lang_n", F.sum("n").over(W.partitionBy("lang_grp")))  # a row for each language and source
    estimate = staged(_final(_concentrated(vectors), groups), "estimate")
    good = _measured(passing, estimate).select("id", *others, *BASE, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= CUTOFF).alias("kept"))
    bad = rows.where("base_failed").select("id", *others, *BASE, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad).withColumnRenamed("id", id_col)
