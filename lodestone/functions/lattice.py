"""Words of text written without spaces: the cheapest path through a lattice of dictionary words.

A word that makes up the share p of all words costs -ln p, in whole millionths,
so costs of paths are exact sums and the best path does not depend on the order
of additions. A sign that begins no word there counts as a word seen once. Of
paths of equal cost the one whose first word is longest is taken, then its
second, and so on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenize import WORD, _col

HAN = r"\p{IsHan}+"
_HAN_OR_WORD = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"
UNIT = 1_000_000
#: A dictionary is sent to all workers; a larger one is refused.
MOST_WORDS = 2_000_000
#: Runs of which a worker remembers the words.
_REMEMBERED = 1 << 16


def costs(dictionary: DataFrame) -> DataFrame:
    """word, cost (long) of a dictionary (word, n); words that are null, empty or seen never are left out, repeated ones added up."""
    words = dictionary.where("n > 0 AND word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).select("word", F.round(UNIT * (F.log("total") - F.log("n"))).cast("long").alias("cost"), F.round(UNIT * F.log("total")).cast("long").alias("unknown"))  # total: one row


class Lattice:
    """Costs of words by their beginnings."""

    def __init__(self, cost: dict[str, int], unknown: int):
        self.cost, self.unknown = cost, unknown
        lengths: dict[str, set[int]] = {}
        for w in cost:
            if len(w) > 1:
                lengths.setdefault(w[0], set()).add(len(w))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.known: dict[str, list[str]] = {}

    def cut(self, text: str) -> list[str]:
        found = self.known.get(text)
        if found is None:
            found = self._path(text)
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[text] = found
        return found

    def _path(self, text: str) -> list[str]:
        n, cost = len(text), self.cost
        best, first = [0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            c = text[i]
            least, size = cost.get(c, self.unknown) + best[i + 1], 1
            for k in self.lengths.get(c, ()):
                if i + k > n:
                    break
                own = cost.get(text[i : i + k])
                if own is not None and own + best[i + k] <= least:
                    least, size = own + best[i + k], k
            best[i], first[i] = least, size
        out, i = [], 0
        while i < n:
            out.append(text[i : i + first[i]])
            i += first[i]
        return out


def tokenizer(dictionary: DataFrame, every_run: bool = False) -> Callable[[Column | str], Column]:
    """A tokenizer: runs of Han characters (with ``every_run``: all runs of letters and digits) are cut by the lattice, other runs are words.

    dictionary: word, n; it is sent to all workers, so more than MOST_WORDS words are an error.
    Case is folded. A null text has no tokens; without a dictionary each sign is a token.
    """
    spark = dictionary.sparkSession
    table = costs(dictionary)
    if table.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words; leave out rare ones")
    rows = table.collect()
    shared = spark.sparkContext.broadcast(({r["word"]: r["cost"] for r in rows}, rows[0]["unknown"] if rows else 0))

    @F.pandas_udf("array<string>")
    def words_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(*shared.value)
        for runs in batches:
            yield runs.map(lambda own: [w for r in own for w in (lattice.cut(r) if every_run or _han(r) else (r,))])

    def tokens(text: Column | str) -> Column:
        t = F.lower(F.coalesce(_col(text), F.lit("")))
        return words_of(F.regexp_extract_all(t, F.lit(WORD if every_run else _HAN_OR_WORD), F.lit(0)))

    return tokens


def _han(run: str) -> bool:
    """Whether a run is one of Han characters: runs are of one kind, and other letters and digits lie in other blocks."""
    c = ord(run[0])
    return c == 0x3005 or c == 0x3007 or 0x3021 <= c <= 0x3029 or 0x3038 <= c <= 0x303B or 0x2E80 <= c <= 0x2FD5 or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAD9 or 0x20000 <= c <= 0x3FFFF


def learn(texts: DataFrame, text: str = "text", runs: str = HAN, longest: int = 4, least: int = 5, holds: float = 3.0, free: float = 0.5) -> DataFrame:
    """word, n: a dictionary found in texts alone.

    A string of up to ``longest`` signs is a word if it occurs ``least`` times,
    its halves meet e**holds times as often as by chance wherever it is cut, and
    what stands before it and after it varies (entropies of ``free`` or more,
    in nats; an end of a run is a neighbour of its own each time). Single signs are words as often as they occur.
    """
    r = texts.select(F.explode(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(runs), F.lit(0))).alias("r"))
    size = F.length("r")
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), size))
    at = r.select("r", F.explode(sizes).alias("m")).select("r", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    end = F.col("i") + F.col("m")
    grams = at.select(F.substring("r", F.col("i"), F.col("m")).alias("word"), F.when(F.col("i") > 1, F.substring("r", F.col("i") - 1, F.lit(1))).alias("before"), F.when(end <= size, F.substring("r", end, F.lit(1))).alias("after"))
    counts = grams.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
    total = grams.where(F.length("word") == 1).agg(F.count("*").alias("total"))
    many = counts.where(F.length("word") > 1)
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    cuts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.length("word")).alias("b"))
    cuts = cuts.join(counts.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    cuts = cuts.crossJoin(F.broadcast(total))  # one row
    firm = cuts.groupBy("word").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("holds")).where(F.col("holds") >= holds).select("word")

    def varied(side: str) -> DataFrame:
        each = grams.join(firm, "word", "left_semi").groupBy("word", side).agg(F.count("*").alias("c"))
        # c * ln(c) of a neighbour; at an end each occurrence is its own, which gives 0
        return each.groupBy("word").agg((F.log(F.sum("c")) - F.sum(F.when(F.col(side).isNotNull(), F.col("c") * F.log("c")).otherwise(0.0)) / F.sum("c")).alias("e")).where(F.col("e") >= free).select("word")

    words = firm.join(varied("before"), "word").join(varied("after"), "word")
    return counts.join(words, "word", "left_semi").unionByName(counts.where(F.length("word") == 1)).select("word", "n")
