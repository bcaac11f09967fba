"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

#: Ends of a number or word; \b differs between engines beside CJK characters.
NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(words: Sequence[str], patterns: Sequence[str] = ()) -> str:
    """A pattern that finds any of the words (taken literally) or patterns; one that finds nothing if there are none."""
    parts = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words] + list(patterns)
    return "|".join(parts) or r"(?!)"


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    text = _col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def clean_spaces(text: Column | str) -> Column:
    """No-break spaces to spaces, runs of blanks to one, three or more line feeds to two, ends stripped."""
    t = F.translate(_col(text), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def _removed(t: Column, patterns: Sequence[str]) -> Column:
    for pattern in patterns:
        t = F.regexp_replace(t, pattern, "")
    return t


def strip_boilerplate(text: Column | str, complete: Sequence[str], start: str, reach: int = 400) -> Column:
    """Complete notices go, wherever they are; a cut-off one goes with the rest of the text if that is short.

    A removal may join the halves of another notice, so it is repeated until
    nothing changes: a fold over as many steps as the text has characters, of
    which those after the last change do nothing. ``start``: pattern of a
    notice's beginning; the last one counts.
    """
    t = _col(text)

    def step(a: Column, _: Column) -> Column:
        again = F.transform(F.array(_removed(a["t"], complete)), lambda n: F.struct(n.alias("t"), (n != a["t"]).alias("moved")))
        return F.when(a["moved"], F.get(again, F.lit(0))).otherwise(a)

    once = _removed(t, complete)
    steps = F.when(once != t, F.sequence(F.lit(1), F.length(once) + 1)).otherwise(F.array().cast("array<int>"))
    t = F.aggregate(steps, F.struct(once.alias("t"), F.lit(True).alias("moved")), step, lambda a: a["t"])
    # The last beginning with at most ``reach`` characters after it, to the end.
    t = F.regexp_replace(t, rf"(?s)(?={start})(?!.+?(?:{start})).{{0,{reach}}}\z", "")
    return clean_spaces(t)


def repair_ohm(text: Column | str) -> tuple[Column, Column]:
    """The text with the ohm sign where Q was read after a number, and how often; doing it again changes nothing."""
    t = _col(text)
    return F.regexp_replace(t, C.OHM_MISREAD, "$1Ω"), F.regexp_count(t, F.lit(C.OHM_MISREAD))


def strip_running_header(text: Column | str) -> Column:
    """Without the first line if it is short and names a chapter or part."""
    t = _col(text)
    line = F.split(t, "\n", 2)[0]
    rest = F.regexp_replace(F.coalesce(F.get(F.split(t, "\n", 2), F.lit(1)), F.lit("")), r"^\n+", "")
    return F.when((F.length(line) <= 30) & line.rlike(C.RUNNING_HEADER), rest).otherwise(t)


def anchor_of(text: Column | str) -> Column:
    """The first anchor line that begins in the first characters; empty without one."""
    return F.regexp_extract(F.substring(_col(text), 1, C.ANCHOR_REACH), C.ANCHOR_LINE, 0)


def strip_prefix(message: Column | str, prefixes: Sequence[str]) -> tuple[Column, Column]:
    """Whether the message, left-trimmed, begins with one of the prefixes; what follows the first that fits, or the message."""
    m = F.regexp_replace(F.coalesce(_col(message), F.lit("")), r"^\s+", "")
    body = F.coalesce(_col(message), F.lit(""))
    for p in reversed(prefixes):
        body = F.when(m.startswith(p), F.regexp_replace(F.substring(m, len(p) + 1, 1 << 30), r"^\s+|\s+$", "")).otherwise(body)
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: m.startswith(p)), body


def code_points(text: Column | str, most: int = 20) -> Column:
    """The first characters as hexadecimal code points."""
    return F.transform(F.filter(F.split(F.substring(_col(text), 1, most), ""), lambda c: c != ""), lambda c: F.lower(F.hex(F.ascii(c))))


def student_id(text: Column | str, digits: int = 8) -> Column:
    """The first number of exactly so many digits that no letter or digit touches; null without one."""
    return first_match(text, rf"{NOT_BEFORE}(\d{{{digits}}}){NOT_AFTER}")


def homework_number(text: Column | str, patterns: Sequence[str] = C.HOMEWORK_PATTERNS) -> Column:
    """By the first pattern that fits; single Chinese numerals become digits, anything else stays."""
    raw = F.coalesce(*(first_match(text, p) for p in patterns))
    numerals = F.create_map(*(F.lit(x) for pair in C.NUMERALS.items() for x in pair))
    return F.concat(F.lit("第 "), F.coalesce(F.try_element_at(numerals, raw), raw), F.lit(" 次"))


def person_name(text: Column | str, known: Column | None = None, stop: Sequence[str] = C.NOT_NAMES) -> Column:
    """A known name; else one that is announced; else the last Chinese run of three or more, then of two characters."""
    t = _col(text)
    never = F.array(*map(F.lit, stop))
    told = [F.when(~F.array_contains(never, first_match(t, p)), first_match(t, p)) for p in C.NAME_PATTERNS]
    runs = F.filter(F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fa5}]{2,4}"), F.lit(0)), lambda r: ~F.array_contains(never, r) & ~r.rlike(f"[{C.NOT_IN_NAMES}]"))
    last = F.reverse(runs)
    long, short = F.filter(last, lambda r: F.length(r) >= 3), F.filter(last, lambda r: F.length(r) == 2)
    return F.coalesce(*([known] if known is not None else []), *told, F.get(long, F.lit(0)), F.get(short, F.lit(0)))


def normal_question(text: Column | str) -> Column:
    """Without white space and punctuation, in lower case; digits stay."""
    return F.lower(F.regexp_replace(_col(text), C.PUNCTUATION, ""))


def redact(text: Column | str, names: Column | Sequence[str] = ()) -> Column:
    """Names, in their order, and numbers of eight or more digits give way to masks. ``names``: array column or list."""
    listed = names if isinstance(names, Column) else F.array(*map(F.lit, names)).cast("array<string>")
    t = F.aggregate(listed, _col(text), lambda a, n: F.when(F.length(n) > 0, F.replace(a, n, F.lit(C.STUDENT_MASK))).otherwise(a))
    return F.regexp_replace(t, C.LONG_NUMBER, C.NUMBER_MASK)


def tolerant_date(text: Column | str) -> Column:
    """Year, month and day apart by - / . or 年 月 日, padded or not; null if it is none or not in the calendar."""
    t = _col(text)
    year, month, day = (F.regexp_extract(t, C.FACT_DATE, k) for k in (1, 2, 3))
    return F.when(t.rlike(C.FACT_DATE), F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all; 0 if either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def meaningful_numbers(text: Column | str) -> Column:
    """Distinct numbers of three signs or more, or with a point; no years, no figure numbers."""
    found = F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    return F.filter(found, lambda n: ((F.length(n) >= 3) | n.contains(".")) & ~n.rlike(r"^(?:19|20)\d\d$") & ~n.rlike(r"^\d{1,2}\.\d{3}$"))


def missing_numbers(source: Column | str, target: Column | str, ignored: Sequence[str] = ("103",)) -> Column:
    """Meaningful numbers of the source that are no substring of the target."""
    known = F.array(*map(F.lit, ignored)).cast("array<string>")
    return F.filter(meaningful_numbers(source), lambda n: ~F.contains(_col(target), n) & ~F.array_contains(known, n))


def digit_set(text: Column | str) -> Column:
    """Numbers and Chinese numerals, as digits."""
    t = _col(text)
    numerals = F.create_map(*(F.lit(x) for pair in C.DIGIT_NUMERALS.items() for x in pair))
    signs = F.filter(F.split(t, ""), lambda c: F.map_contains_key(numerals, c))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), F.transform(signs, lambda c: F.try_element_at(numerals, c)))))


def around(text: Column | str, match: Column, before: int = 55, after: int = 25) -> Column:
    """The characters around the first occurrence of ``match``, white space squashed."""
    t = _col(text)
    at = F.instr(t, match)
    low = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.regexp_replace(F.substring(t, low, at - low + F.length(match) + after), r"\s+", " "))


def chapter_of(name: Column | str) -> Column:
    """The chapter number that a source's name begins with; null without one."""
    return first_match(name, r"^第\s*(\d{1,2})\s*章").cast("int")


def problem_reference(body: Column | str, file_name: Column | str) -> Column:
    """chapter, problem, origin: from the first lines, from anywhere, or from digits in the file's name."""
    b, f = _col(body), _col(file_name)
    pattern = r"Solution\s+(\d{1,2})\.(\d{1,3})"
    place = F.when(F.substring(b, 1, 120).rlike(pattern), F.substring(b, 1, 120)).when(b.rlike(pattern), b)
    digits = first_match(f, r"^Soln(\d{3,})\.pdf$")
    stem = F.regexp_replace(f, r"\.[^.]*$", "")
    chapter = F.regexp_extract(place, pattern, 1).cast("int").cast("string")
    by_name = F.coalesce(F.nullif(F.substring(digits, F.lit(1), F.length(digits) - 3), F.lit("")), F.lit("0")).cast("int").cast("string")
    return F.when(place.isNotNull(), F.struct(chapter.alias("chapter"), F.concat(chapter, F.lit("."), F.regexp_extract(place, pattern, 2)).alias("problem"), F.lit("text").alias("origin"))).when(digits.isNotNull(), F.struct(by_name.alias("chapter"), F.concat(by_name, F.lit("."), F.right(digits, F.lit(3)).cast("int").cast("string")).alias("problem"), F.lit("name").alias("origin"))).otherwise(F.struct(F.lit("").alias("chapter"), stem.alias("problem"), F.lit("none").alias("origin")))


def keyword_line(*parts: Column | str) -> Column:
    """An anchor line of the parts that are not empty, each once, in order."""
    kept = F.filter(F.array_distinct(F.array(*map(_col, parts))), lambda p: p.isNotNull() & (p != ""))
    return F.concat(F.lit("检索:"), F.array_join(kept, " "))


def content_key(*parts: Column | str, length: int = 16) -> Column:
    """The first signs of the SHA-1 of the parts, apart by a zero byte: what equal contents have in common."""
    return F.substring(F.sha1(F.concat_ws("\0", *map(_col, parts)).cast("binary")), 1, length)


def reply_text(json: Column | str) -> Column:
    """The text of a chat completion, wherever the service puts it; empty if nowhere."""
    j = _col(json)
    paths = ("$.choices[0].message.content", "$.choices[0].message.reasoning_content", "$.reply")
    return F.coalesce(*(F.nullif(F.get_json_object(j, p), F.lit("")) for p in paths), F.lit(""))


def cell_text(cell: Column | str) -> Column:
    """Null as empty, a whole number with a zero fraction as a whole number, the rest trimmed."""
    t = F.regexp_replace(_col(cell).cast("string"), r"^\s+|\s+$", "")
    return F.coalesce(F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def squeezed(text: Column | str, most: int, dots: str = "……") -> Column:
    """At most so many characters, with dots after a cut."""
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(dots))).otherwise(t)


def first_heading(markdown: Column | str) -> Column:
    return F.regexp_extract(_col(markdown), r"(?m)^#\s+(.+?)\s*$", 1)


def first_paragraph(markdown: Column | str, most: int = 120) -> Column:
    """The first line that is no heading, list, quote, table, fence or tag, as plain text."""
    lines = F.transform(F.split(_col(markdown), r"\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    plain = F.filter(lines, lambda x: (x != "") & ~x.rlike(C.NOT_A_PARAGRAPH))
    return F.substring(plain_text(F.coalesce(F.get(plain, F.lit(0)), F.lit(""))), 1, most)


def plain_text(markdown: Column | str) -> Column:
    """Links as their texts, without marks of emphasis and code."""
    t = F.regexp_replace(_col(markdown), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"[*_`]+", ""), r"\s+", " ")


def html_escaped(text: Column | str) -> Column:
    t = _col(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def clean_title(name: Column | str, endings: Sequence[str] = C.TITLE_ENDINGS, edition: str = C.TITLE_EDITION, otherwise: str = C.UNTITLED) -> Column:
    """A title from a file's name: without marks at its end (``endings``, such as initials of who made it) and of its edition; ``otherwise`` if nothing is left."""
    t = F.regexp_replace(_col(name), r"^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"(?i)[-_\s]*(?:{any_of(endings)})$", ""), edition, "")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^[ \-_—]+|[ \-_—]+$", ""), F.lit("")), F.lit(otherwise))


def chapter_label(chapter: Column | str) -> Column:
    """第N章; empty without a chapter."""
    c = _col(chapter).cast("string")
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit("第"), c, F.lit("章")))


def chapter_folder(chapter: Column | str) -> Column:
    """The folder of a chapter that has none yet: its number, and its number in words up to twenty."""
    c = _col(chapter).cast("int")
    signs = F.array(F.lit("零"), *(F.lit(sign) for sign in C.NUMERALS))
    unit = F.when(c % 10 == 0, "").otherwise(F.get(signs, c % 10))
    words = F.when(c.between(0, 10), F.get(signs, c)).when(c.between(11, 19), F.concat(F.lit("十"), unit)).when(c == 20, "二十").otherwise(c.cast("string"))
    return F.concat(c.cast("string"), F.lit("第"), words, F.lit("章"))


def submission_table(roster_path: Column | str, tails: Sequence[str] = C.ROSTER_TAILS, name: str = C.SUBMISSION_TABLE) -> Column:
    """Path of the submission table beside a roster, named after its course; a roster whose name says no course keeps it."""
    p = _col(roster_path)
    folder, file = F.regexp_extract(p, r"^(.*/)?[^/]*$", 1), F.regexp_extract(p, r"([^/]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), r"[_\-]\d{10,}$", "")
    return F.concat(folder, F.regexp_replace(stem, rf"(?<=.)[-_—\s]*(?:{any_of(tails)})$", ""), F.lit(f"_{name}"))


def text_width(text: Column | str, size: Column | float, bold: bool = False) -> Column:
    """Estimated width of a text without font metrics: each sign by its class, in parts of the size."""
    t = F.coalesce(_col(text), F.lit(""))
    kinds = ((rf"[{C.WIDE_SIGNS}]", 1.0), (" ", 0.30), (rf"[{C.NARROW_SIGNS}]", 0.34), (r"[\p{Lu}\p{Nd}]", 0.62))
    left, total = t, F.lit(0.0)
    for pattern, part in kinds:  # counted class by class, in a few passes
        total = total + F.regexp_count(left, F.lit(pattern)) * part
        left = F.regexp_replace(left, pattern, "")
    total = total + F.length(left) * 0.55
    return total * (F.lit(size) if isinstance(size, (int, float)) else size) * (1.03 if bold else 1.0)


def lead_paragraph(body: Column | str) -> Column:
    """struct<lead, body> of what follows a first heading: its opening paragraph as plain text, and the rest.

    Only a paragraph that provably stands alone is taken out: nothing but blank
    lines before it, no list, quote, table, fence or tag, and behind it a
    heading or the end. Otherwise the lead is empty and the body as it was.
    """
    b = _col(body)
    before = F.regexp_extract(b, r"\A(\s*\n)?", 1)
    t = F.substring(b, F.length(before) + 1, F.length(b))
    block = F.get(F.split(t, r"\n[^\S\n]*(?=\n|\z)", 2), F.lit(0))
    rest = F.substring(t, F.length(block) + 2, F.length(t))
    alone = t.rlike(r"\A\s*\S") & ~F.regexp_replace(block, r"\A\s+", "").rlike(C.NOT_A_PARAGRAPH) & rest.rlike(r"\A\s*(?:#|\z)")
    lead = F.regexp_replace(plain_text(block), r"^\s+|\s+$", "")
    left = F.when(rest == "", F.regexp_replace(before, r"\n\z", "")).otherwise(F.concat(before, rest))
    return F.when(alone, F.struct(lead.alias("lead"), left.alias("body"))).otherwise(F.struct(F.lit("").alias("lead"), b.alias("body")))


def marked_section(text: Column | str, after: str, until: str) -> Column:
    """What stands between the first of one mark and the next of another, or the end; null without the first."""
    parts = F.split(_col(text), rf"\Q{after}\E", 2)
    return F.when(F.size(parts) > 1, F.get(F.split(F.get(parts, F.lit(1)), rf"\Q{until}\E", 2), F.lit(0)))


def page_offset_fits(pdf_page: Column | str, text: Column | str, offset: int = 16, header: str = C.PAGE_HEADER, lines: int = 3) -> Column:
    """Whether the page number printed in the first lines is the file's page less ``offset``; no printed number passes."""
    told = F.transform(F.slice(F.split(_col(text), "\n"), 1, lines), lambda x: F.when(x.rlike(header), F.regexp_extract(x, header, 1).cast("int")))
    first = F.get(F.filter(told, lambda n: n.isNotNull()), F.lit(0))
    return F.coalesce(first == _col(pdf_page) - offset, F.lit(True))
