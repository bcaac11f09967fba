"""Heads of corpus texts: a title, where the text is from, and a line of words that searches find it by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import chapter_label, keyword_line


@dataclass(frozen=True)
class Course:
    """What heads name: the course, who teaches it, its book, the file of the book, and words that all anchors share; the edition, and what is said of answers without solutions."""

    name: str
    teacher: str = ""
    book: str = ""
    book_file: str = ""
    extra: str = ""
    language: str = C.ANCHOR_LANGUAGE
    edition: str = C.ANCHOR_EDITION
    answers_only: str = C.ANCHOR_ANSWERS_ONLY


def _text(*parts: Column | str) -> Column:
    """The parts in one; strings are literals, null columns are empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _head(title: Column, origin: Column, words: list[Column | str], *notes: Column) -> Column:
    line = keyword_line(*(F.lit(w) if isinstance(w, str) else w for w in words))
    return F.concat(F.array_join(F.array(title, origin, *notes, line), "\n"), F.lit("\n"))


def _named(before: str, value: Column) -> Column:
    """The value behind a word; empty without a value."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v == "", "").otherwise(F.concat(F.lit(before), v))


def problem(course: Course, chapter: Column, number: Column, source: Column, folder: Column | None = None, extra: Column | None = None) -> Column:
    """Head of a problem's answer; without a chapter its folder stands for it."""
    where = F.when(chapter_label(chapter) != "", chapter_label(chapter)).otherwise(F.coalesce(folder, F.lit("")) if folder is not None else F.lit(""))
    words = [*C.ANCHOR_PROBLEM, where, chapter_label(chapter), _named("CH", chapter), number, _named("题", number), extra if extra is not None else F.lit("")]
    return _head(_text(f"【{course.name} ", where, " 习题 ", number, f" 参考答案】任课老师:{course.teacher}"), _text("来源:", source, f"({course.book})"), words)


def translated_problem(course: Course, chapter: Column, number: Column, source: Column) -> Column:
    """Head of a problem's answer in the edition that counts."""
    words = [*C.ANCHOR_PROBLEM, course.language, chapter_label(chapter), _text("CH", chapter), number, _text("题", number), course.extra]
    return _head(_text(f"【{course.name} ", chapter_label(chapter), " 习题 ", number, f" 参考答案({course.language})】任课老师:{course.teacher}"), _text("来源:", source, f"({course.book},**参数与结论以本版为准**)"), words)


def slides(course: Course, chapter: Column, title: Column, source: Column, pages: Column) -> Column:
    words = [*C.ANCHOR_SLIDES, chapter_label(chapter), _text("CH", chapter), title]
    return _head(_text(f"【{course.name} ", chapter_label(chapter), f" 讲义({course.teacher}课件)】", title), _text("来源:", source, "(课堂 PPT 导出,共 ", pages, " 页)"), words)


def book_chapter(course: Course, chapter: Column, title: Column, first: Column, last: Column, sections: Column) -> Column:
    """Head of a book's chapter; words of titles count one by one. ``sections``: array of section titles."""
    listed = F.split(F.array_join(F.concat(F.array(title), sections, F.array(F.lit(course.extra))), " "), r"\s+")
    words = F.array_join(F.filter(F.array_distinct(F.concat(F.array(*map(F.lit, (course.name, *C.ANCHOR_BOOK)), chapter_label(chapter), _text("CH", chapter)), listed)), lambda w: w != ""), " ")
    title_line = _text(f"【{course.name} 教材({course.edition}) ", chapter_label(chapter), " ", title, f"】{course.book}")
    origin = _text(f"来源:{course.book_file} 印刷页 P", first, "-P", last, "(扫描件经 OCR,公式/上下标可能有乱码,以书为准)")
    return F.concat(F.array_join(F.array(title_line, origin, F.concat(F.lit("检索:"), words)), "\n"), F.lit("\n"))


def book_appendix(course: Course, first: Column, last: Column) -> Column:
    note = F.lit(course.answers_only)
    return _head(_text(f"【{course.name} 教材({course.edition}) 附录 奇数编号习题答案】{course.book}"), _text(f"来源:{course.book_file} 印刷页 P", first, "-P", last), [f"{course.name} {C.ANCHOR_APPENDIX}"], note)


def book_preface(course: Course) -> Column:
    return _head(F.lit(f"【{course.name} 教材({course.edition}) 译者序:符号与国标差异说明】{course.book}"), F.lit(f"来源:{course.book_file} 书前页(罗马数字页码,无阿拉伯页码)"), [f"{course.name} {C.ANCHOR_PREFACE}"])
