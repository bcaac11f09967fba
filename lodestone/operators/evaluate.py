"""Quality of retrieval: ranks, budgets, verdicts, comparison with a baseline, audits of numbers, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def judged(hits: DataFrame, case_id: str, relevant: Column, foreign: Column, forbidden: Column, cases: DataFrame) -> DataFrame:
    """A row for each case: rank of the first relevant hit (null: none), numbers of foreign and forbidden hits."""
    found = hits.groupBy(case_id).agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"), F.count_if(foreign).alias("n_foreign"), F.count_if(forbidden).alias("n_forbidden"))
    rows = cases.join(found, case_id, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_foreign", "n_forbidden")})


def foreign_chapter(source: Column | str, allowed: Column) -> Column:
    """Whether a source names a chapter that is not among those allowed; none allowed: every chapter is foreign."""
    chapter = T.chapter_of(source)
    return chapter.isNotNull() & ~F.coalesce(F.array_contains(allowed, chapter), F.lit(False))


def verdict(budget: Column) -> Column:
    """What is wrong with a case; empty: nothing."""
    problems = F.array(F.when(F.col("first_rank").isNull(), "no hit"), F.when(F.col("n_forbidden") > 0, "forbidden source"), F.when(F.col("n_foreign") > budget, "too much noise"))
    return F.filter(problems, lambda p: p.isNotNull())


def summary(rows: DataFrame) -> DataFrame:
    """One row: cases, hits, MRR over all cases, foreign hits, failed cases."""
    return rows.agg(F.count("*").alias("n_cases"), F.count("first_rank").alias("n_hits"), F.round(F.sum(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"), F.sum("n_foreign").alias("n_foreign"), F.count_if(F.size("problems") > 0).alias("n_failed"))


def compared(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Each case of either run: new, missing, worse, changed or same. Worse: a lower or lost rank, more noise, newly forbidden."""
    old = before.select(F.col(key).alias("old_key"), F.col("first_rank").alias("old_rank"), F.col("n_foreign").alias("old_foreign"), F.col("n_forbidden").alias("old_forbidden"))
    rows = now.join(old, F.col(key) == F.col("old_key"), "full_outer")
    rank, was = F.coalesce(F.col("first_rank"), F.lit(1 << 30)), F.coalesce(F.col("old_rank"), F.lit(1 << 30))
    worse = (rank > was) | (F.col("n_foreign") > F.col("old_foreign")) | ((F.col("n_forbidden") > 0) & (F.col("old_forbidden") == 0))
    change = F.when(F.col("old_key").isNull(), "new").when(F.col(key).isNull(), "missing").when(worse, "worse").when(rank != was, "changed").otherwise("same")
    return rows.select(F.coalesce(key, "old_key").alias(key), "old_rank", "first_rank", change.alias("change"))


def number_audit(rows: DataFrame, source: str, target: str, ignored: tuple[str, ...] = ("103",)) -> DataFrame:
    """Adds the meaningful numbers of ``source``, those that ``target`` lacks, and the tally: kept, missing or no mark."""
    missing = T.missing_numbers(source, target, ignored)
    state = F.when(F.col(target).isNull(), "no mark").when(F.size(missing) == 0, "kept").otherwise("missing")
    return rows.withColumns({"numbers": T.meaningful_numbers(source), "missing": missing, "state": state})


def fidelity(expected: Column | str, said: Column | str) -> Column:
    """struct<lost, added, state>: digits that went and that came."""
    a, b = T.digit_set(expected), T.digit_set(said)
    lost, added = F.array_except(a, b), F.array_except(b, a)
    state = F.when(F.size(lost) > 0, "LOST").when(F.size(added) > 0, "EXTRA").otherwise("MATCH")
    return F.struct(lost.alias("lost"), added.alias("added"), state.alias("state"))


def source_matches(source: Column | str, names: Column, patterns: Column) -> Column:
    """Whether a source is one of the names, or any of the patterns is found in it. Null lists hold nothing."""
    s = F.col(source) if isinstance(source, str) else source
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_contains(F.coalesce(names, none), s), F.lit(False)) | F.exists(F.coalesce(patterns, none), lambda p: F.coalesce(F.rlike(s, p), F.lit(False)))


def not_indexed(cases: DataFrame, case_id: str, names: str, indexed: DataFrame, source: str) -> DataFrame:
    """case_id, source: expected sources that the index does not hold, which no search can find."""
    wanted = cases.select(case_id, F.explode(names).alias("source"))
    return wanted.join(indexed.select(F.col(source).alias("source")).distinct(), "source", "left_anti").select(case_id, "source")


def not_in_baseline(cases: DataFrame, before: DataFrame, case_id: str) -> DataFrame:
    """Cases that the baseline has no result of."""
    return cases.join(before.select(case_id), case_id, "left_anti")


def exit_status(changes: DataFrame | None) -> int:
    """1 if any case is worse, or if there is no baseline to compare with: a gate that is away must not look open."""
    return 1 if changes is None or not changes.where("change = 'worse'").isEmpty() else 0


def in_audit(path: Column, skipped_folder: str, skipped_names: tuple[str, ...] = (), not_first: tuple[str, ...] = ("00_", "_")) -> Column:
    """Whether a Markdown file is audited: by its folders, its name and the beginning of its name."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    begins = F.exists(F.array(*map(F.lit, not_first)), lambda p: F.startswith(name, p))
    return name.endswith(".md") & ~begins & ~F.array_contains(parts, skipped_folder) & ~name.isin(*skipped_names)


def marked_audit(rows: DataFrame, text: str, explained: str, source: str, until: str, own: str | None = None, ignored: tuple[str, ...] = ("103",)) -> DataFrame:
    """Audit of texts that hold both versions: numbers of the part behind ``source`` (up to ``until``) against that behind ``explained`` (up to ``source``).

    Adds numbers, missing and state: kept, missing, or no mark where a mark is
    away. ``own``: a column with the problem's number, which need not be repeated.
    """
    said, meant = T.marked_section(text, explained, source), T.marked_section(text, source, until)
    both = said.isNotNull() & meant.isNotNull()
    rows = number_audit(rows.withColumns({"_said": F.when(both, said), "_meant": F.when(both, meant)}), "_meant", "_said", ignored)
    if own:
        rows = rows.withColumn("missing", F.array_remove("missing", F.col(own)))
        rows = rows.withColumn("state", F.when(F.col("_said").isNull(), "no mark").when(F.size("missing") == 0, "kept").otherwise("missing"))
    return rows.drop("_said", "_meant")


def tally(rows: DataFrame, state: str, *by: str) -> DataFrame:
    """by, state, n: how many rows are in each state; the rows themselves stay a table, however many differ."""
    return rows.groupBy(*by, state).agg(F.count("*").alias("n"))


def fidelity_tally(rows: DataFrame, found: str = "f") -> DataFrame:
    """One row: n, n_match, n_lost, n_extra of ``fidelity`` structs; a reply that loses and adds counts in both."""
    lost, extra = F.size(f"{found}.lost") > 0, F.size(f"{found}.added") > 0
    return rows.agg(F.count("*").alias("n"), F.count_if(~lost & ~extra).alias("n_match"), F.count_if(lost).alias("n_lost"), F.count_if(extra).alias("n_extra"))


def fidelity_differences(rows: DataFrame, row_id: str, found: str = "f") -> DataFrame:
    """row_id, difference, digits: a row for each kind in which a reply differs."""
    kinds = F.array(F.struct(F.lit("LOST").alias("difference"), F.col(f"{found}.lost").alias("digits")), F.struct(F.lit("EXTRA").alias("difference"), F.col(f"{found}.added").alias("digits")))
    return rows.select(row_id, F.inline(F.filter(kinds, lambda k: F.size(k["digits"]) > 0)))


def page_tally(pages: DataFrame, text: str = "text", error: str = "error") -> DataFrame:
    """One row of a recognition run: pages, pages read, those of them without text, failed pages, characters."""
    failed = F.col(error).isNotNull()
    size = F.when(~failed, F.length(F.coalesce(F.col(text), F.lit(""))))
    return pages.agg(F.count("*").alias("n_pages"), F.count_if(~failed).alias("n_read"), F.count_if(size == 0).alias("n_empty"), F.count_if(failed).alias("n_failed"), F.coalesce(F.sum(size), F.lit(0)).alias("n_chars"))


def share(value: str) -> Column:
    """Of the total; null if that is not positive."""
    from pyspark.sql import Window as W

    total = F.sum(value).over(W.partitionBy(F.lit(0)))
    return F.when(total > 0, F.col(value) / total)


def of_largest(value: str) -> Column:
    """Of the maximum; null if a value is negative or all are zero."""
    from pyspark.sql import Window as W

    all_ = W.partitionBy(F.lit(0))
    return F.when((F.min(value).over(all_) >= 0) & (F.max(value).over(all_) > 0), F.col(value) / F.max(value).over(all_))


def chosen(cases: DataFrame, part: str, name: str = "case") -> DataFrame:
    """The cases whose name holds ``part``; all of them for an empty one."""
    return cases.where(F.contains(F.col(name), F.lit(part))) if part else cases
