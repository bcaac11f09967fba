"""Marked blocks of Markdown texts, and the flowcharts among them as nodes, edges and groups.

Both are read line by line by a small automaton; a text that breaks the rules
gives a row with its error (line and what is wrong), and the others go on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_BLOCKS = "no int, kind string, args string, line int, body string, error string"
_CHART = "direction string, nodes array<struct<node:string,label:string,shape:string,place:int>>, edges array<struct<no:int,src:string,dst:string,label:string,dashed:boolean,both:boolean>>, groups array<struct<grp:string,label:string,members:array<string>>>, error string"

#: Signs of the texts that are read before their rows are passed on; lines of charts that a worker remembers, and the signs of a line that it does not.
SLICE, REMEMBERED, LONG_LINE = 1 << 20, 1 << 14, 256

# How a flowchart is written.
HEAD = re.compile(r"(?:flowchart|graph)\s+(TD|TB|LR)")
SHAPES = {"[[": ("]]", "subroutine"), "((": ("))", "circle"), "[": ("]", "rect"), "{": ("}", "rhombus"), "(": (")", "stadium")}
UNSUPPORTED = ("[(", "([", "{{", "[/", "[\\")
LINKS = ("<-->", "-.->", "-->", "---")
COMMENT, CAPTION = "%%", re.compile(r"\s*%%\s*caption:\s*(.*?)\s*")

_ID = r"[A-Za-z0-9_]+(?:-{1,2}(?![-.>])[A-Za-z0-9_]+)*"
_TOKEN = re.compile(rf"""\s*(?:(?P<link>{"|".join(map(re.escape, LINKS))})|\|(?P<label>[^|]*)\||(?P<id>{_ID})|(?P<shape>[\[({{](?:"[^"]*"|[^"\])}}]|[\])}}](?=[\])}}]))*[\])}}]+))""")


class Broken(ValueError):
    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")


# --- marked blocks


def blocks(text: str) -> list[dict]:
    """Fenced diagrams (kind mermaid, args its caption) and ``:::kind args`` blocks, in order; what stands in other fences is text.

    Blocks do not nest; a mark that is no block, or a block without an end, is an error.
    """
    found, inside, fence = [], None, False
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if inside is not None:
            bare, ends = line.strip(), ":::" if inside["mark"] else "```"
            if bare == ends or inside["kind"] == "mermaid" and bare.endswith("```"):
                if bare != ends:
                    inside["lines"].append(line[: line.rindex("```")])
                found.append(inside)
                inside = None
            elif inside["mark"] and line.startswith(":::") and re.match(r":::[ \t]*[a-z]", line):
                raise Broken(n, "a block inside a block")
            else:
                inside["lines"].append(line)
        elif line.lstrip().startswith("```"):
            if not fence and re.fullmatch(r"```mermaid[ \t]*", line):
                inside = {"kind": "mermaid", "args": "", "line": n, "mark": False, "lines": []}
            else:
                fence = not fence
        elif not fence and line.startswith(":::"):
            m = re.fullmatch(r":::[ \t]*([a-z]+)[ \t]*(.*)", line)
            if m is None:
                raise Broken(n, f"not a mark of a block: {line[:40]}")
            inside = {"kind": m[1], "args": m[2].strip(), "line": n, "mark": True, "lines": []}
    if inside is not None:
        raise Broken(inside["line"], f"{inside['kind']} has no end")
    for no, b in enumerate(found):
        if not b["mark"]:
            b["args"] = next((m[1] for x in b["lines"] if COMMENT in x and (m := CAPTION.fullmatch(x))), "")
        b |= {"no": no, "body": "\n".join(b.pop("lines")).strip("\n")}
        del b["mark"]
    return found


def marked_blocks(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, no, kind, args, line, body, error: the blocks of each text; a text with a fault has one row, with its error."""

    return _rows(texts, id_col, text, lambda x: [(b["no"], b["kind"], b["args"], b["line"], b["body"], None) for b in blocks(x)], _BLOCKS)


def _rows(texts: DataFrame, id_col: str, text: str, read: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """id, and what is read from each text: rows of ``schema``, whose last column is the error of a faulty text.

    A table function, not a column: filters on what it returns do not read the texts again.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    none = (None,) * (len(kinds) - 1)

    def made(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], names=["id", *kinds.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows, size = batch.column(0), [], [], 0
            for n, x in enumerate(batch.column(1)):
                x = x.as_py() or ""
                try:
                    own = read(x)
                except Broken as e:
                    own = [(*none, str(e))]
                at += [n] * len(own)
                rows += own
                size += len(x)
                if size >= SLICE and rows:
                    yield made(ids, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield made(ids, at, rows)

    body = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return body.mapInArrow(run, StructType([*body.select("id").schema.fields, *StructType.fromDDL(schema).fields]))


# --- flowcharts


def _label(raw: str | None) -> str | None:
    """Plain text: quotes around it and marks of bold and italics go, breaks are line ends."""
    if raw is None:
        return None
    raw = raw.strip()
    if len(raw) > 1 and raw[0] in "\"'" and raw[0] == raw[-1]:
        raw = raw[1:-1]
    if "<" in raw:
        raw = re.sub(r"(?i)</?[bi]\s*>", "", re.sub(r"(?i)<br\s*/?>", "\n", raw))
    return html.unescape(raw)


def _tokens(line: str) -> Iterator[tuple[str, str]]:
    at, line = 0, line.rstrip()
    while at < len(line):
        m = _TOKEN.match(line, at)
        if m is None:
            raise ValueError(f"cannot be read: {line[at:].strip()[:40]}")
        yield m.lastgroup, m[m.lastgroup]
        at = m.end()


def _shape(told: str | None) -> dict:
    if told is None:
        return {}
    if told.startswith(UNSUPPORTED):
        raise ValueError(f"no such shape: {told[:40]}")
    begin = next(b for b in SHAPES if told.startswith(b))
    end, kind = SHAPES[begin]
    if not told.endswith(end):
        raise ValueError(f"no such shape: {told[:40]}")
    return {"label": _label(told[len(begin) : -len(end)]), "shape": kind}


def _read(line: str) -> tuple[list[tuple[str, dict]], list[dict], str | None]:
    """Nodes with links between them, node (link label? node)*: the nodes with what is told of them, the links, and what is wrong."""
    nodes, links = [], []
    before = link = name = shape = label = None
    try:
        for kind, value in [*_tokens(line), ("end", "")]:
            if kind == "id" and name is None:
                name = value
            elif kind == "shape" and name is not None and shape is None:
                shape = value
            elif kind == "label" and link is not None and name is None and label is None:
                label = value
            elif kind in ("link", "end") and name is not None:
                nodes.append((name, _shape(shape)))
                if link is not None:
                    links.append({"src": before, "dst": name, "label": _label(label), "dashed": link == "-.->", "both": link == "<-->"})
                before, link, name, shape, label = name, value, None, None, None
            else:
                return nodes, links, f"out of place: {value or 'the end of the line'}"
    except ValueError as e:
        return nodes, links, str(e)
    return nodes, links, None


#: Lines of charts are much alike, and a line says the same wherever it stands.
_remembered = lru_cache(REMEMBERED)(_read)


class Chart:
    def __init__(self, direction: str):
        self.direction, self.nodes, self.edges, self.groups, self.open = direction, {}, [], [], None

    def line(self, line: str, n: int) -> None:
        nodes, links, wrong = _remembered(line) if len(line) <= LONG_LINE else _read(line)
        if wrong is not None:
            raise Broken(n, wrong)
        for name, told in nodes:
            own = self.nodes.get(name)
            if own is None:
                own = self.nodes[name] = {"node": name, "label": name, "shape": "rect", "place": len(self.nodes)}
            own.update(told)
            if self.open is not None and name not in self.open["members"]:
                self.open["members"].append(name)
        for link in links:
            self.edges.append({"no": len(self.edges), **link})

    def group(self, told: str, n: int) -> None:
        if self.open is not None:
            raise Broken(n, "a group inside a group")
        m = re.fullmatch(rf"({_ID})\s*(?:\[(.*)\])?", told)
        name = m[1] if m and m[2] is not None else f"group{len(self.groups)}"
        self.open = {"grp": name, "label": _label(m[2] if m and m[2] is not None else told), "members": []}
        self.groups.append(self.open)


def flowchart(text: str) -> Chart:
    lines = [(n, bare) for n, x in enumerate(text.split("\n"), 1) if (bare := x.strip()) and not bare.startswith(COMMENT)]
    head = HEAD.fullmatch(lines[0][1]) if lines else None
    if head is None:
        raise Broken(lines[0][0] if lines else 1, "the first line is no `flowchart TD` or `flowchart LR`")
    chart = Chart("LR" if head[1] == "LR" else "TD")
    for n, line in lines[1:]:
        if line.startswith("subgraph") and (m := re.fullmatch(r"subgraph\s+(.*)", line)):
            chart.group(m[1], n)
        elif line == "end":
            if chart.open is None:
                raise Broken(n, "an end without a group")
            chart.open = None
        else:
            chart.line(line, n)
    names = {g["grp"] for g in chart.groups}
    for e in chart.edges if names else ():
        if names & {e["src"], e["dst"]}:
            raise Broken(1, f"a link to a group: {e['src']} {e['dst']}")
    return chart


def flowcharts(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, direction, nodes, edges, groups, error of each flowchart; a faulty one has its error only.

    Edges of all charts, for operators.graph.diagram_layers: select id and inline(edges).
    """

    def read(x: str) -> list[tuple]:
        c = flowchart(x)
        return [(c.direction, list(c.nodes.values()), c.edges, c.groups, None)]

    return _rows(texts, id_col, text, read, _CHART)


# Blocks that show something.
SHOWN = ("chart", "compare", "stats", "steps", "timeline", "cards")


def markdown_statistics(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, title (the first heading of the first level), n_sections (of the second), n_rows (of tables), n_charts (diagrams and blocks that show something, alone on their line), size."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    title = F.when(t.rlike(r"(?m)^# +\S"), F.trim(F.regexp_extract(t, r"(?m)^# +(\S.*)$", 1)))
    charts = count(r"(?m)^```mermaid[ \t]*$") + count(rf"(?m)^:::(?:{'|'.join(SHOWN)})[ \t]*$")
    return texts.select(F.col(id_col).alias("id"), title.alias("title"), count(r"(?m)^## ").alias("n_sections"), count(r"(?m)^\|.*\|$").alias("n_rows"), charts.alias("n_charts"), F.length(t).alias("size"))
