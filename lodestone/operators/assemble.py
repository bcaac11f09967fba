"""Corpus assembly: sections, precedence of sources, guarded writes, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C


#: Chapters up to this number are sent to all executors.
MOST_SENT = 100_000


def chapters_in_name(name: Column | str) -> Column:
    """The chapters a file's name declares: both ends of each range, sorted."""
    n = F.col(name) if isinstance(name, str) else name
    ends = F.concat(*(F.regexp_extract_all(n, F.lit(C.CHAPTER_IN_NAME), F.lit(g)) for g in (1, 2)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(ends, lambda e: e != ""), lambda e: e.cast("int"))))


def sections(docs: DataFrame, keys: list[str], text_col: str, heading: str = C.PROBLEM_LINE, chapters: Column | None = None, needs: str | None = r"\p{IsHan}", reach: int = 15) -> DataFrame:
    """keys, chapter, number, label, body: from each heading to the next; of equal labels the longest, then the first.

    ``heading``: a pattern for the beginning of a line with groups for chapter
    and number; it counts if the chapter is among ``chapters`` and ``needs`` is
    found in the next ``reach`` characters. Texts are cut at line starts, so no
    positions are carried: a run of lines up to the next heading is a section.
    """
    pattern = heading.replace("(?m)", "")
    rows = docs.select(*keys, (F.lit(None).cast("array<int>") if chapters is None else chapters).alias("allowed"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    rest = F.substring(F.regexp_replace("line", pattern, ""), 1, reach)
    chapter = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1).cast("int"))
    opens = chapter.isNotNull() & F.coalesce(F.array_contains("allowed", chapter), F.lit(True)) & (rest.rlike(needs) if needs else F.lit(True))
    inside = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("opens", opens).withColumn("section", F.sum(F.col("opens").cast("int")).over(inside)).where("section > 0")
    head = lambda g: F.max(F.when(F.col("opens"), F.regexp_extract("line", pattern, g)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    found = rows.groupBy(*keys, "section").agg(head(1).cast("int").alias("chapter"), head(2).cast("int").alias("number"), head(2).alias("written"), F.regexp_replace(lines, r"^\s+|\s+$", "").alias("body"))
    found = found.withColumn("label", F.concat_ws(".", "chapter", "written"))
    longest = W.partitionBy(*keys, "label").orderBy(F.length("body").desc(), "section")
    return found.withColumn("nth", F.row_number().over(longest)).where("nth = 1").select(*keys, "chapter", "number", "label", "body")


def answer_sections(docs: DataFrame, text_col: str, heading: str = C.ANSWER_HEADING, labels: tuple[tuple[str, str], ...] = (("第", "题"), ("书", ""))) -> DataFrame:
    """docs without the text, with part (from 1), label and body: what stands before the first heading, and from each heading to the next.

    A text without headings is one part. ``labels``: what goes around the
    heading's groups, of which the first that fits counts. A heading is found
    inside one line. Texts are cut inside their rows; a null text has no parts.
    """
    text, opens = F.col(text_col), rf"(?d){heading}"

    def label(line: Column) -> Column:
        told = [(F.regexp_extract(line, opens, g), before, after) for g, (before, after) in enumerate(labels, 1)]
        return F.coalesce(*(F.when(t != "", F.concat(F.lit(before), t, F.lit(after))) for t, before, after in told), F.lit(C.PREAMBLE))

    def of(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.get(lines, i).rlike(opens))
        parts = F.transform(F.array(heads), lambda h: F.transform(h, lambda i, k: F.struct(label(F.get(lines, i)).alias("label"), F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(h, k + 1), F.size(lines)) - i), "\n").alias("body"))))
        trimmed = F.transform(F.get(parts, F.lit(0)), lambda p: F.struct(p["label"].alias("label"), F.regexp_replace(p["body"], r"^\s+|\s+$", "").alias("body")))
        return F.filter(trimmed, lambda p: p["body"] != "")

    whole = F.array(F.struct(F.lit(C.WHOLE_TEXT).alias("label"), text.alias("body")))
    # Lambdas bind what is used more than once, as in bm25.counted.
    cut = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.when(F.exists(lines, lambda x: x.rlike(opens)), of(lines)).otherwise(whole)), F.lit(0))
    parts = F.when(text.isNotNull(), cut)
    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(parts).alias("part", "p")).select(*others, (F.col("part") + 1).alias("part"), "p.label", "p.body")


def section_titles(pages: DataFrame, keys: list[str], text_col: str, order: str, heading: str = C.SECTION_LINE) -> DataFrame:
    """keys, title, place: headings of sections, each once, numbered by first appearance. ``order``: place of a page.

    A heading's groups are chapter, number and title; dots that lead to a page number go.
    """
    lines = pages.select(*keys, F.col(order).alias("_page"), F.posexplode(F.split(text_col, "\n")).alias("_line", "line")).where(F.col("line").rlike(heading))
    part = lambda g: F.regexp_extract("line", heading, g)
    named = F.regexp_replace(F.regexp_replace(part(3), r"[\s.·…]+$", ""), r"^\s+", "")
    found = lines.select(*keys, "_page", "_line", part(1).cast("int").alias("chapter"), part(2).cast("int").alias("number"), named.alias("named")).where("named <> ''")
    title = F.concat(F.col("chapter").cast("string"), F.lit("."), F.col("number").cast("string"), F.lit(" "), "named")
    first = found.groupBy(*keys, title.alias("title")).agg(F.min(F.struct("_page", "_line")).alias("at"))
    return first.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("at"))).drop("at")


def by_rank_list(name: Column | str, ranked: list[str], last: int = 99) -> list[Column]:
    """Order of names by a list; those not in it come after, by name."""
    n = F.col(name) if isinstance(name, str) else name
    at = F.array_position(F.array(*map(F.lit, ranked)).cast("array<string>"), n)
    return [F.when(at > 0, at - 1).otherwise(last), n]


def label_order(label: Column | str) -> list[Column]:
    """Numeric order of a.b labels; what is none comes last."""
    parts = F.split(F.col(label) if isinstance(label, str) else label, r"\.")
    return [F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(999)) for k in (0, 1)]


def with_appendix(main: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Main bodies, each with the other source's body of the same key behind it."""
    extra = other.select(F.col(key).alias("k"), F.col("body").alias("appendix"))
    return main.join(extra, F.col(key) == F.col("k"), "left").drop("k")


def by_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """All sources, each without the keys of those before it; ``origin``: its place, from 1."""
    out = None
    for place, rows in enumerate(sources, 1):
        rows = rows.withColumn("origin", F.lit(place))
        out = rows if out is None else out.unionByName(rows.join(out.select(key), key, "left_anti"))
    return out


def first_origin(rows: DataFrame, key: str, origin: str) -> DataFrame:
    """As by_precedence, for sources that are in one table, however many: the rows of each key's first origin."""
    first = rows.groupBy(key).agg(F.min(origin).alias("first"))  # combined before it is shuffled
    return rows.join(first, key).where(F.col(origin) == F.col("first")).drop("first")


def not_done(jobs: DataFrame, done: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Jobs without a result, or with an empty one."""
    return jobs.join(done.where(F.coalesce(F.col(text), F.lit("")) != "").select(key), key, "left_anti")


def guarded(new: DataFrame, old: DataFrame, key: str, mark: str, force: bool = False) -> DataFrame:
    """key, text, outcome: a text that carries the mark is kept, unless forced; written, rewritten or kept."""
    have = old.select(F.col(key).alias("k"), F.col("text").alias("old_text"))
    marked = F.coalesce(F.contains("old_text", F.lit(mark)), F.lit(False))
    rows = new.join(have, F.col(key) == F.col("k"), "left")
    outcome = F.when(marked & F.lit(not force), "kept").when(marked, "rewritten").otherwise("written")
    return rows.select(key, F.when(outcome == "kept", F.col("old_text")).otherwise(F.col("text")).alias("text"), outcome.alias("outcome"))


def contents(rows: DataFrame, chapter: str, label: str) -> DataFrame:
    """A line for each chapter: its labels in numeric order."""
    entry = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(label_order(label))), F.col(label).alias("label"))
    return rows.groupBy(chapter).agg(F.array_join(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["label"]), " ").alias("labels"))


def pages_of(pages: DataFrame, starts: DataFrame, offset: int = 16) -> DataFrame:
    """Pages with the chapter that holds them: a chapter reaches to the page before the next. pages: pdf_page, text; starts: printed_start, no, title."""
    end = F.lead("printed_start").over(W.orderBy("printed_start")) - 1  # a row for each chapter
    ranges = starts.withColumn("printed_end", F.coalesce(end, F.lit(1 << 30)))
    page = F.col("pdf_page") - offset
    by_chapter = pages.withColumn("printed_page", page)
    if ranges.limit(MOST_SENT + 1).count() <= MOST_SENT:
        ranges = F.broadcast(ranges)
    return by_chapter.join(ranges, page.between(F.col("printed_start"), F.col("printed_end")))


def manifest(rows: DataFrame, reason: str) -> DataFrame:
    """How many were written, and skipped for which reason."""
    return rows.groupBy(F.coalesce(reason, F.lit("written")).alias("outcome")).agg(F.count("*").alias("n"))
