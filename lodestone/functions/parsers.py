"""Small state machines over the lines of one text, and table functions that run them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import config as C

_question, _answer = re.compile(C.FAQ_QUESTION), re.compile(C.FAQ_ANSWER)
_record_question, _record_answer = re.compile(C.RECORD_QUESTION), re.compile(C.RECORD_ANSWER)
_fact_key, _fact_date = re.compile(C.FACT_KEY), re.compile(C.FACT_DATE)


def faq_entries(text: str) -> list[tuple[str, str]]:
    """Questions and answers. A question ends at an answer line or a blank one, an answer at the next question."""
    entries: list[list] = []  # question lines, answer lines or None
    state = "out"
    lines = text.splitlines()
    for k, line in enumerate(lines):
        bare = line.strip()
        following = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if state == "question":
            if _answer.match(bare):
                entries[-1][1] = [_answer.sub("", bare)]
                state = "answer"
                continue
            if bare:
                entries[-1][0].append(bare)
                continue
            state = "out"
        elif state == "answer":
            if not _question.match(bare) and not (bare == "" and _question.match(following)):
                entries[-1][1].append(line)
                continue
            state = "out"
        if _question.match(bare):
            entries.append([[_question.sub("", bare)], None])
            state = "question"
    pairs = [("\n".join(q).strip(), "\n".join(a or []).strip()) for q, a in entries]
    return [(q, a) for q, a in pairs if q and a]


def fact_date(value: str) -> date | None:
    found = _fact_date.match(value)
    try:
        return date(*map(int, found.groups())) if found else None
    except ValueError:
        return None


def facts(text: str) -> list[tuple[str, str, date | None, date | None]]:
    """Text, source, first and last day of each block. Blocks with a bad date, without a text or ending before they begin go."""
    lines = [line.strip() for line in text.splitlines()]
    blocks = "\n".join(line for line in lines if not line.startswith("#"))
    out = []
    for block in re.split(r"\n{2,}", blocks):
        found = [m.groups() for line in block.split("\n") if (m := _fact_key.match(line))]
        said = {key: value.strip() for key, value in found}  # a later line of the same key counts
        days = {key: [fact_date(v.strip()) for k, v in found if k == key] for key in ("生效", "失效")}
        if any(None in d for d in days.values()) or not said.get("事实"):
            continue
        since, until = (d[-1] if d else None for d in days.values())
        if since and until and until < since:
            continue
        out.append((said["事实"], said.get("来源", ""), since, until))
    return out


def record(body: str) -> tuple[str, str, str]:
    """Question, answer, error (empty if all is well): one of each, and no further label at the beginning of a line."""
    lines = body.splitlines()
    labels = [(k, "q" if _record_question.match(line) else "a") for k, line in enumerate(lines) if _record_question.match(line) or _record_answer.match(line)]
    first = next((k for k, kind in labels if kind == "q"), None)
    if first is None:
        return "", "", "no question"
    second = next((k for k, kind in labels if kind == "a" and k > first), None)
    if second is None:
        return "", "", "no answer"
    more = next((kind for k, kind in labels if k > first and k != second), None)
    if more:
        return "", "", "second question" if more == "q" else "second answer"

    def joined(head: str, rest: list[str]) -> str:
        return "\n".join(x.strip() for x in [head, *rest] if x.strip())

    question = joined(_record_question.sub("", lines[first]), lines[first + 1 : second])
    answer = joined(_record_answer.sub("", lines[second]), lines[second + 1 :])
    return (question, answer, "") if question and answer else ("", "", "empty question" if not question else "empty answer")


def _exploded(docs: DataFrame, text_col: str, parse: Callable[[str], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """A row for each parsed entry, with pos (from 1) and the other columns of its text."""
    rest = [c for c in docs.columns if c != text_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            others = list(f[rest].itertuples(index=False)) if rest else [()] * len(f)
            rows = [(*keys, pos, *entry) for keys, text in zip(others, f[text_col], strict=True) for pos, entry in enumerate(parse(text or ""), 1)]
            yield pd.DataFrame(rows, columns=[*rest, "pos", *names])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.mapInPandas(run, f"{kept}pos int, {schema}")


def parse_faq(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return _exploded(docs, text_col, faq_entries, ["question", "answer"], "question string, answer string")


def parse_facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return _exploded(docs, text_col, facts, ["fact", "source", "effective_from", "effective_until"], "fact string, source string, effective_from date, effective_until date")


def parse_record(body: Column | str) -> Column:
    """struct<question, answer, error>."""
    kind = StructType([StructField(n, StringType()) for n in ("question", "answer", "error")])

    @F.pandas_udf(kind)
    def parsed(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([record(b or "") for b in bodies], columns=["question", "answer", "error"])

    return parsed(body)
