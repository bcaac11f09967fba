"""Approximate nearest neighbours by cross-polytope hashing.

In each table a vector is turned by a few pseudo-rotations (each three times
random signs and a fast Hadamard transform); the signed axes that it is nearest
to in each of them are together its key, so the number of buckets grows with
the number of rotations in a key. A query looks at the keys of each table in
order of the sum of its entries on their axes. What it finds is ranked by exact
cosine.

How many tables, rotations in a key and probes are needed depends on dimension,
number and structure of the vectors. It is measured: for a bounded sample of
queries the true neighbours are found by looking at everything, and the
cheapest plan is taken that finds the share TARGET of them, for each dimension
and at every size of a table. Queries that hold fewer rows than they could go on
to everything.

Equal vectors are indexed once, with their smallest ids. Rows are dealt by
table and part of the keys; a query goes once to each part that holds any of
its keys. A hot part is split into tiles of vectors and of queries, so no task
meets a whole one, and a task returns only the best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import groups
from .staging import drop_staged, release, staged, tasks
from .words import mix

U = np.uint64
#: Queries whose true neighbours are looked up to choose a plan (those of least hash), and the share of these that it has to find.
SAMPLE, TARGET = 64, 0.97
#: What plans are chosen from; most probes of a table.
TABLES, ROTATIONS, MOST_PROBES = (1, 2, 4, 8), (1, 2, 3), 4096
#: Entries of a rotated vector that probes combine, by the number of rotations.
_AXES = {1: 1 << 12, 2: 128, 3: 40}
#: What a table, and a probe of it, cost a query beside the rows that it looks at, in comparisons.
_TABLE_COST, _PROBE_COST = 20, 0.01
SEED = 20_240_601
TILE, QUERY_TILE = 4096, 1024
#: What rounding may take from a product of unit vectors; pairs measured again at a time.
MARGIN, PAIRS = 1e-12, 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; rows have a power of two of entries."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of unit rows, padded with zeros to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([SEED, d, table]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def _both_ends(x: np.ndarray, turn: int) -> np.ndarray:
    """Entries on the signed axes of a rotation: 2 * axis + (1 if its positive end)."""
    y = rotate(x, turn)
    return np.stack([-y, y], 2).reshape(len(y), -1)


def keys_of(x: np.ndarray, table: int, rotations: int, probes: int = 1) -> np.ndarray:
    """The keys of each unit row in a table, best first: numbers of as many digits as rotations, one for each nearest signed axis."""
    total, key = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    few = 1 if probes == 1 else _AXES[rotations]
    for r in range(rotations):
        ends = _both_ends(x, table * max(ROTATIONS) + r)
        n = min(few, ends.shape[1])
        near = ends.argmax(1)[:, None] if n == 1 else np.argpartition(-ends, n - 1, axis=1)[:, :n]
        total = (total[:, :, None] + np.take_along_axis(ends, near, 1)[:, None, :]).reshape(len(x), -1)
        key = (key[:, :, None] * ends.shape[1] + near[:, None, :]).reshape(len(x), -1)
    if total.shape[1] == 1:
        return key
    # Ties are settled by key, so that every machine looks at the same ones.
    n = min(probes, total.shape[1])
    least = -np.partition(-total, n - 1, axis=1)[:, n - 1]
    out = np.empty((len(x), n), np.int64)
    for row, (sums, names, last) in enumerate(zip(total, key, least, strict=True)):
        some = np.flatnonzero(sums >= last)
        out[row] = names[some[np.lexsort((names[some], -sums[some]))[:n]]]
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are brought near 1 by powers of two first, so no square is lost or infinite."""
    a, b = _near_one(a), _near_one(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _near_one(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _units(x: np.ndarray) -> np.ndarray:
    x = _near_one(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(U)) % U(parts)).astype(np.int64)


#: dims -> tables, rotations in a key, probes (0: all), parts of a table.
Plan = dict[int, tuple[int, int, int, int]]


def _dealt(vectors: DataFrame, plan: Plan, asks: bool) -> DataFrame:
    """dims, tab, part, keys, number, vector: each vector in each table, by its own key or, if it asks, once for each part with the keys that it looks at there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64 if asks else 512):
                cut = batch.slice(i, 64 if asks else 512)
                lengths = cut.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths).tolist():
                    own = cut.take(pa.array(np.flatnonzero(lengths == d)))
                    x = _units(np.stack(_rows(own.column(1))))
                    tables, rotations, probes, parts = plan.get(d, (1, 1, 0, 1))
                    for t in range(tables):
                        if asks and not probes:  # no keys: everything
                            row, part = np.repeat(np.arange(len(x)), parts), np.tile(np.arange(parts), len(x))
                            cuts, keys = np.zeros(len(row) + 1, np.int32), np.zeros(0, np.int64)
                        else:
                            keys = keys_of(x, t, rotations, probes if asks else 1)
                            row = np.repeat(np.arange(len(x)), keys.shape[1])
                            keys = keys.ravel()
                            part = _part(keys, parts)
                            order = np.lexsort((keys, part, row))
                            keys, row, part = keys[order], row[order], part[order]
                            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
                            cuts, row, part = np.append(first, len(keys)).astype(np.int32), row[first], part[first]
                        for k in range(0, len(row), 4096):
                            e = min(k + 4096, len(row))
                            n, out = e - k, own.take(pa.array(row[k:e]))
                            told = pa.ListArray.from_arrays(pa.array(cuts[k : e + 1] - cuts[k]), pa.array(keys[cuts[k] : cuts[e]]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(part[k:e]), told, *out.columns], ["dims", "tab", "part", "keys", *out.schema.names])

    return vectors.select("number", "vector", "first").mapInArrow(run, f"dims int, tab int, part long, keys array<long>, number long, vector {vectors.schema['vector'].dataType.simpleString()}, first long")


def _best(pairs: DataFrame, keep: int) -> DataFrame:
    """dims, tab, part, i, j, asks, keys, number, vector, first (least id) -> the ``keep`` best of each asking vector in each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 5):
            asks = g.column(5).to_numpy()
            q, c = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
            if not len(q) or not len(c):
                continue
            keys, cuts = g.column(6).flatten().to_numpy(), np.concatenate([[0], np.cumsum(g.column(6).value_lengths().to_numpy())])
            own = keys[cuts[c]]
            order = np.argsort(own, kind="stable")
            c, own = c[order], own[order]
            x = np.stack(_rows(g.column(8)))
            unit = _units(x)
            number, first = g.column(7).to_numpy(), g.column(9).to_numpy()
            found, near = unit[c], [[], [], []]
            for a in q.tolist():
                looked = keys[cuts[a] : cuts[a + 1]]
                if len(looked):
                    lo, hi = np.searchsorted(own, looked, "left"), np.searchsorted(own, looked, "right")
                    n = hi - lo
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                else:
                    at = np.arange(len(c))
                if not len(at):
                    continue
                score = found[at] @ unit[a]
                some = min(len(at), keep)
                # Rounding of the product may change places, and any number may tie: all that come near the last are measured again.
                close = c[at[score >= np.partition(score, len(at) - some)[len(at) - some] - MARGIN]]
                exact = np.concatenate([cosines(np.broadcast_to(x[a], (len(part), x.shape[1])), x[part]) for part in np.split(close, range(PAIRS, len(close), PAIRS))])
                best = np.lexsort((first[close], -exact))[:some]
                for column, values in zip(near, (np.full(some, number[a]), number[close[best]], exact[best]), strict=True):
                    column.append(values)
            if near[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in near], ["asker", "found", "score"])

    sort = ["dims", "tab", "part", "i", "j"]
    return pairs.repartition(tasks(pairs.sparkSession), *sort).sortWithinPartitions(*sort, "asks", "number").mapInArrow(run, "asker long, found long, score double")


def _search(classes: DataFrame, asking: DataFrame, plan: Plan, keep: int) -> DataFrame:
    """asker, found, score: the ``keep`` best that each asking vector finds in all its tiles."""
    place = ["dims", "tab", "part"]
    index = staged(_dealt(classes, plan, False), "index")
    asked = staged(_dealt(asking, plan, True), "probes")
    load = index.groupBy(*place).agg(F.ceil(F.count("*") / (2 * TILE)).cast("int").alias("tiles"))
    load = staged(load.join(asked.groupBy(*place).agg(F.ceil(F.count("*") / QUERY_TILE).cast("int").alias("parts")), place), "load")
    row = [*place, "i", "j", "asks", "keys", "number", "vector", "first"]
    no = F.lit(0)
    left = index.join(load, place).withColumns({"i": F.pmod(F.xxhash64("number"), F.col("tiles")).cast("int"), "j": F.explode(F.sequence(no, F.col("parts") - 1)), "asks": no})
    right = asked.join(load, place).withColumns({"i": F.explode(F.sequence(no, F.col("tiles") - 1)), "j": F.pmod(F.xxhash64("number", F.lit(1)), F.col("parts")).cast("int"), "asks": F.lit(1)})
    found = _best(left.select(*row).unionByName(right.select(*row)), keep).groupBy("asker", "found").agg(F.max("score").alias("score"))
    found = staged(found, "found")
    drop_staged(index, asked, load)
    release(classes.sparkSession)
    return found


def _plan(classes: DataFrame, k: int, tables: tuple[int, ...], rotations: tuple[int, ...]) -> Plan:
    """Measured on a sample: for each dimension the cheapest plan of tables and keys that finds TARGET of its true neighbours.

    Only where no such plan does (vectors of very many entries without
    structure), everything is looked at.
    """
    counts = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    plan = {d: (1, 1, 0, max(1, n // TILE)) for d, n in counts.items()}
    rank = F.row_number().over(W.partitionBy(F.size("vector")).orderBy(F.xxhash64("number"), "number"))
    sample = staged(classes.where("asks").withColumn("r", rank).where(F.col("r") <= SAMPLE).drop("r"), "sample")
    found = _search(classes, sample, plan, k + 1).where("asker <> found")
    vectors = classes.select("number", "vector", "first")
    pairs = found.join(vectors.withColumnsRenamed({"number": "found", "vector": "y"}), "found")
    true = pairs.withColumn("r", F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k)
    pairs = true.join(sample.select(F.col("number").alias("asker"), F.col("vector").alias("x")), "asker").select("x", "y").collect()  # at most SAMPLE * k for each dimension
    by_size: dict[int, list] = {}
    for r in pairs:
        by_size.setdefault(len(r["x"]), []).append((r["x"], r["y"]))
    for d, own in by_size.items():
        x, y = (_units(np.array([p[c] for p in own], np.float64)) for c in (0, 1))
        if (found := _cheapest(x, y, counts[d], tables, rotations)) is not None:
            plan[d] = (*found, max(1, counts[d] // TILE))
    drop_staged(sample)
    return plan


def _cheapest(x: np.ndarray, y: np.ndarray, n: int, tables: tuple[int, ...], rotations: tuple[int, ...]) -> tuple[int, int, int] | None:
    """Tables, rotations, probes by which TARGET of the pairs (x, y) meet among n vectors, at the least cost of a query."""
    axes, best = 2 << max(0, x.shape[1] - 1).bit_length(), None
    for m in rotations:
        buckets = axes**m
        if m > 1 and buckets > 64 * n or buckets > 1 << 62:
            continue
        place = np.full((max(tables), len(x)), MOST_PROBES)
        for t in range(max(tables)):
            for i in range(0, len(x), 64):
                hit = keys_of(x[i : i + 64], t, m, MOST_PROBES) == keys_of(y[i : i + 64], t, m)
                place[t, i : i + 64] = np.where(hit.any(1), hit.argmax(1), MOST_PROBES)
        for t in tables:
            needed = np.sort(place[:t].min(0))[int(np.ceil(TARGET * len(x))) - 1]
            probes = min(int(needed) + 1, buckets)
            cost = t * (_TABLE_COST + probes * (_PROBE_COST + n / buckets))
            if needed < MOST_PROBES and (best is None or cost < best[0]):
                best = (cost, (t, m, probes))
    return best and best[1]


def usable(column: str):
    """Not null, without null or non-finite components, and not zero."""
    c = F.col(column).cast("array<double>")
    plain = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(c) > 0) & plain & F.exists(c, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: tuple[int, ...] = TABLES, rotations: tuple[int, ...] = ROTATIONS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the ``k`` nearest found of each query row, itself left out; all candidates, if fewer.

    ``is_query``: a condition on the columns. All usable rows are indexed; ties
    in score go to smaller ids. Null, zero and non-finite vectors take no part,
    nor do rows with a null id; vectors of other dimensions are never
    candidates; a row repeated with its id counts once. No rows come of an
    empty table. Other columns are not read. Components are taken in double
    precision.
    """
    number = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(F.col(vector_col), lambda v: v + F.lit(0).cast(number)).alias("vector"))
    rows = rows.withColumn("class", F.unhex(F.md5(F.to_json("vector").cast("binary"))))
    rows = staged(rows, "vectors")
    ids = rows.select("class", "id", "asks").distinct()
    # Of equal vectors the k + 1 smallest ids are enough; the limit is applied before rows are shuffled.
    few = ids.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.groupBy("class").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = rows.groupBy("class").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks"))
    classes = staged(classes.join(few, "class").withColumns({"number": F.monotonically_increasing_id(), "first": F.col("ids")[0].cast("long")}), "vector-classes")  # which pins the numbers
    found = _search(classes, classes.where("asks"), plan := _plan(classes, k, tables, rotations), k + 1)
    # What could have more goes on to look at everything.
    there = classes.groupBy(F.size("vector").alias("d")).agg(F.sum(F.size("ids")).alias("ids"))
    held = found.join(classes.select(F.col("number").alias("found"), F.size("ids").alias("n")), "found").groupBy("asker").agg(F.sum("n").alias("held"))
    short = classes.where("asks").join(there.withColumnRenamed("ids", "most"), F.size("vector") == F.col("d")).join(held, F.col("number") == F.col("asker"), "left")
    short = staged(short.where(F.coalesce("held", F.lit(0)) < F.least(F.col("most"), F.lit(k + 1))).select("number", "vector", "first"), "short")
    if any(p[2] for p in plan.values()) and not short.isEmpty():
        everything = {d: (1, 1, 0, p[3]) for d, p in plan.items()}
        found = found.unionByName(_search(classes, short, everything, k + 1)).groupBy("asker", "found").agg(F.max("score").alias("score"))
    found = found.join(classes.select(F.col("number").alias("found"), "ids", "first"), "found")
    best = W.partitionBy("asker").orderBy(F.desc("score"), "first")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("asker", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("asker", "score", "vec_id")
    asking = ids.where("asks").select("class", F.col("id").alias("query_id")).join(classes.select("class", "number"), "class")
    out = asking.join(found, F.col("number") == F.col("asker")).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
