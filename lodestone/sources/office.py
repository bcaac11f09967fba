"""Texts of office files, from their zipped XML; nothing but the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as X

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _part(data: bytes, name: str) -> X.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return X.fromstring(z.read(name))


def _paragraph(p: X.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{_W}t"))


def docx_text(data: bytes) -> str:
    """Paragraphs with text, then each table's rows, cells apart by a bar."""
    body = _part(data, "word/document.xml").find(f"{_W}body")
    lines = [t for p in body.findall(f"{_W}p") if (t := _paragraph(p)).strip()]
    for table in body.iter(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            cells = ["\n".join(_paragraph(p) for p in c.iter(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def docx_raw_text(data: bytes) -> str:
    """Every text node, those in text boxes too, and a line feed after each paragraph; no layout numbers."""
    out = []
    for event, node in X.iterparse(io.BytesIO(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")), events=("end",)):
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}p":
            out.append("\n")
    text = re.sub(r"[ \t]+", " ", "".join(out).replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _date_styles(styles: bytes | None) -> set[int]:
    """Numbers of the cell styles that show a number as a date or a time."""
    if styles is None:
        return set()
    root = X.fromstring(styles)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_S}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())}
    dates = {*range(14, 23), *range(45, 48)} | own
    formats = root.find(f"{_S}cellXfs")
    return set() if formats is None else {k for k, x in enumerate(formats) if int(x.get("numFmtId", 0)) in dates}


def _shown(value: str, kind: str | None, is_date: bool) -> str:
    """A cell's value as text: truth values as words, dates from their day numbers."""
    if kind == "b":
        return "True" if value == "1" else "False"
    if is_date and kind in (None, "n"):
        try:
            days = float(value)
        except ValueError:
            return value
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(days * 86_400))
        return str(moment.time() if 0 <= days < 1 else moment)
    return value


def xlsx_rows(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """Sheets with all their rows; cells are placed by their references, the declared size is not trusted."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in X.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        dates = _date_styles(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        out = []
        for sheet in X.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            root = X.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str | None]] = []
            for row in root.iter(f"{_S}row"):
                cells: dict[int, str | None] = {}
                for k, cell in enumerate(row.findall(f"{_S}c")):
                    letters = re.match(r"[A-Z]+", cell.get("r", ""))
                    at = k if not letters else int(sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0])))) - 1
                    value = cell.find(f"{_S}v")
                    kind = cell.get("t")
                    text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else _shown(value.text or "", kind, int(cell.get("s", 0)) in dates)
                    cells[at] = text
                number = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(number - len(rows) - 1)]
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), rows))
        return out


def cell_text(value: str | None) -> str:
    """Trimmed; a number with a zero fraction without it."""
    text = (value or "").strip()
    return re.sub(r"^(-?\d+)\.0+$", r"\1", text)


def xlsx_text(data: bytes) -> str:
    """Sheets with their names, an empty line between them."""
    sheets = [[f"[Sheet: {name}]", *(" | ".join(c for c in row if c is not None) for row in rows if any(c is not None for c in row))] for name, rows in xlsx_rows(data)]
    return "\n\n".join("\n".join(lines) for lines in sheets)


def _shape(node: X.Element) -> list[str]:
    """Texts of one shape: groups gone into in order; a table's rows with their cells apart by a bar, blank rows left out."""
    if node.tag == f"{_P}grpSp":
        return _shapes(node)
    if node.tag == f"{_P}sp":
        text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in node.iter(f"{_A}p")).strip()
        return [text] if text else []
    if node.tag == f"{_P}graphicFrame":
        rows = [["".join(t.text or "" for t in c.iter(f"{_A}t")).strip() for c in row.findall(f"{_A}tc")] for row in node.iter(f"{_A}tr")]
        return [" | ".join(row) for row in rows if any(row)]
    return []


def _shapes(tree: X.Element) -> list[str]:
    """Texts of all shapes; one that cannot be read costs itself only."""
    out: list[str] = []
    for node in tree:
        try:
            out += _shape(node)
        except (AttributeError, TypeError, ValueError):
            continue
    return out


def _notes(z: zipfile.ZipFile, links: str) -> list[str]:
    """Notes of a slide; none if they cannot be read."""
    try:
        targets = [r.get("Target") for r in X.fromstring(z.read(links)) if r.get("Type", "").endswith("/notesSlide")]
        trees = [X.fromstring(z.read("ppt/" + t.removeprefix("../").removeprefix("/ppt/"))) for t in targets]
    except (KeyError, AttributeError, X.ParseError):
        return []
    texts = ["".join(t.text or "" for t in tree.iter(f"{_A}t")).strip() for tree in trees]
    return [f"(备注){t}" for t in texts if t]


def pptx_text(data: bytes) -> str:
    """Slides in order, each with its notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for n in numbers:
            lines = _shapes(X.fromstring(z.read(f"ppt/slides/slide{n}.xml")).find(f"{_P}cSld/{_P}spTree"))
            lines += _notes(z, f"ppt/slides/_rels/slide{n}.xml.rels")
            if lines:
                out.append(f"[第{n}页]\n" + "\n".join(lines))
        return "\n\n".join(out)
