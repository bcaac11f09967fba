"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled but fixed order (by MD5
of the id), repeated as often as needed. Serving a source at a rate given by
its target, a document is finished at the virtual time (size of what was served
before it in its source + its size) / target. Half a document is taken off, so
that cutting rounds to the nearest document and not down. The mix is the
documents in order of virtual time, cut at the total budget. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Stretches of the virtual time that are summed, twice, before rows are sorted.
STRETCHES = 4096
#: Documents that a stretch of a source's queue has at most on average; the number of stretches follows.
STRETCH_ROWS = 1 << 16


def words_in(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources in order of code points, null last, take the weights in turn and
    share the total. A share ends at ``most`` times its source's size; what is
    over is shared again by weight until no share is above. That is one water
    level: target = min(most * size, level * weight). One row per source.
    """
    turn = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy(F.lit(0))
    filled = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything), "cap_before": F.coalesce(F.sum("cap").over(filled), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(filled), F.lit(0))})
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before")))
    # Holding the next source to its cap raises the level while that cap is below it, and lowers it afterwards.
    return t.withColumn("water", F.max("level").over(everything)).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.lit(0.0))).alias("target"))


def _queued(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Each document with its source's size and target, and ``upto``: the words of its source up to and with it."""
    sized = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), words_in(F.col(text_col)).alias("size"), F.md5(F.col(id_col).cast("string").cast("binary")).alias("shuffled"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    sized = staged(sized, "mix-sizes")
    digits = 3
    while sized.count() > STRETCH_ROWS << 4 * digits:
        digits += 1
    sized = sized.withColumn("stretch", F.coalesce(F.conv(F.substring("shuffled", 1, digits), 16, 10).cast("long"), F.lit(0)))
    # Two steps of sums: a hot source is spread over its stretches first.
    by_stretch = sized.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    by_stretch = by_stretch.select(F.col("source").alias("s"), F.col("stretch").alias("k"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    # Written, so that Spark knows its size, and can split a hot source where it is too large to broadcast.
    wanted = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "s"), "mix-targets")
    inside = W.partitionBy("source", "stretch").orderBy(F.asc_nulls_first("shuffled"), "size", "body").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = sized.withColumn("here", F.sum("size").over(inside))
    q = q.join(by_stretch, q["source"].eqNullSafe(by_stretch["s"]) & (q["stretch"] == by_stretch["k"]), "left").drop("s", "k")
    q = q.join(wanted, q["source"].eqNullSafe(wanted["s"]), "left").drop("s")
    return q.select("source", "id", "body", "size", "shuffled", "source_size", "target", (F.col("before") + F.col("here")).alias("upto"))


def _times(most: int) -> Column:
    """The virtual time of each repeat; of documents that have a size and a target."""
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.array(*[((F.col("source_size") * k + F.col("upto")).cast("double") - F.col("size") / F.lit(2.0)) / F.col("target") for k in range(most)])).otherwise(F.array().cast("array<double>"))


def _cut(q: DataFrame, budget: int, most: int):
    """The last place (time, shuffled, size, repeat) inside the budget, or None if all are.

    Virtual time is cut in stretches and each stretch summed; only the stretch
    in which the budget ends is cut again, and only the rows of that smaller
    one are sorted. The driver gets a row a step. All copies end by time 2.
    """
    copies = q.select("size", "shuffled", F.posexplode(_times(most)).alias("k", "time")).where("time < 2")
    spent, finer = 0, 1.0
    for _ in range(2):
        finer *= STRETCHES
        copies = copies.withColumn("b", F.floor(F.col("time") * finer))
        sums = copies.groupBy("b").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(W.orderBy("b")))
        over = sums.where(F.col("upto") > budget - spent).orderBy("b").limit(1).collect()
        if not over:
            return None  # only at the first step: a later one holds the end
        spent += over[0]["upto"] - over[0]["words"]
        copies = copies.where(F.col("b") == over[0]["b"])
        low = over[0]["b"] / finer
    order = [F.col("time"), F.col("shuffled"), F.col("size"), F.col("k")]
    last = copies.withColumn("upto", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = last.where(F.col("upto") - F.col("size") / 2 <= budget - spent).orderBy(*[c.desc() for c in order]).limit(1).collect()
    return (last[0]["time"], last[0]["shuffled"] or "", last[0]["size"], last[0]["k"]) if last else (low, "", 0, -1)


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, most: int) -> DataFrame:
    """The queues with ``times``: how often the mix takes the document."""
    q = staged(_queued(docs, id_col, text_col, source_col), "mix-queues")
    budget = q.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).collect()[0]["n"]
    cut = _cut(q, budget, most) if budget else None
    times = _times(most)
    if cut is None:
        return q.withColumn("times", F.size(F.filter(times, lambda t: t < 2)))
    time, shuffled, size, k = cut
    place = F.struct(F.lit(time).alias("a"), F.lit(shuffled).alias("b"), F.lit(size).cast("long").alias("c"), F.lit(k).alias("d"))
    own = lambda t, i: F.struct(t.alias("a"), F.coalesce("shuffled", F.lit("")).alias("b"), F.col("size").alias("c"), i.alias("d"))
    return q.withColumn("times", F.size(F.filter(times, lambda t, i: own(t, i) <= place)))


def mix_to_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_REPEATS) -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, taken.

    size: words of the text (null: 0); taken: words that the mix takes from the
    document, repeats counted, so a multiple of size and at most ``most`` times
    it. The order depends on ids alone: reruns agree. Null sources are one
    source, the last; null ids go first in their queue; equal rows are
    interchangeable; documents without words, and those of a source without
    words, are taken 0 times. An empty table gives no rows. Other columns are
    not read.
    """
    q = _planned(docs, id_col, text_col, source_col, most)
    return q.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: every column of ``docs``, each document as often as mix_to_weights takes it.

    Rows alike in id and text stand for each other: that whose other columns
    have the least hash is taken for all. Other columns are carried whatever
    their names. Documents without words, null texts among them, are not taken;
    an empty table gives no rows.
    """
    q = _planned(docs, id_col, text_col, source_col, most).groupBy("id", "body").agg(F.sum("times").alias("times")).where("times > 0")
    q = q.select(F.struct("id", "body").alias("mix_key"), "times")
    one = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    rows = docs.select(whole_row(docs).alias("row"), one.alias("mix_key")).groupBy("mix_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    taken = rows.join(q, "mix_key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return taken.select("row.*")
