"""Tokenizers: words (the default), words with CJK bigrams, or any function from str to a list of str."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

WORD = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str, fold_case: bool = True) -> Column:
    """Runs of letters and digits, in order, repeats kept; null text has none."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.regexp_extract_all(F.lower(t) if fold_case else t, F.lit(WORD), F.lit(0))


def cjk(text: Column | str, fold_case: bool = True) -> Column:
    """As words, but each run of Han characters gives its overlapping pairs (or itself, if it is one character)."""
    t = F.coalesce(_col(text), F.lit(""))
    runs = F.regexp_extract_all(F.lower(t) if fold_case else t, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2}"), pairs(r)).otherwise(F.array(r))))


def external(cut: Callable[[str], list[str]]) -> Callable[[Column | str], Column]:
    """A tokenizer from a Python function, run on Arrow batches."""

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(cut(t)) if t else [])

    return lambda text: tokens(_col(text))


def content(tokens: Column, stop_words: Sequence[str] = C.STOP_WORDS) -> Column:
    """Distinct tokens that say something, sorted."""
    kept = F.filter(F.array_distinct(F.transform(tokens, lambda t: F.trim(t))), lambda t: t != "")
    return F.array_sort(F.array_except(kept, F.array(*map(F.lit, stop_words)).cast("array<string>")))
