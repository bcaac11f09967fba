"""Structure of HTML pages: headings, anchors, links, images, errors of nesting."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, and elements whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
END_OPTIONAL = frozenset("html head body p li dt dd rt rp option optgroup colgroup caption thead tbody tfoot tr th td".split())
_HEADINGS = ("h1", "h2", "h3", "h4")
_POINTERS = {"a": ("href", "link"), "img": ("src", "image")}


class PageReader(HTMLParser):
    """Findings (kind, value) of one page, in order; ``finish`` adds what was left open."""

    def __init__(self):
        super().__init__()
        self.nested: list[str] = []
        self.findings: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        told = {name: value for name, value in attrs if value is not None}
        if "id" in told:
            self.findings.append(("id", told["id"]))
        attribute, kind = _POINTERS.get(tag, ("", ""))
        if attribute in told:
            self.findings.append((kind, told[attribute]))
        if tag in _HEADINGS:
            self.findings.append(("heading", tag))
        if tag not in VOID:
            self.nested.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.nested.pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in self.nested:
            self.findings.append(("error", f"</{tag}> closes nothing"))
            return
        while (inner := self.nested.pop()) != tag:
            if inner not in END_OPTIONAL:
                self.findings.append(("error", f"</{tag}> closes <{inner}>"))

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        return self.findings + [("error", f"<{t}> stays open") for t in self.nested if t not in END_OPTIONAL]


def page_structure(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, kind (id, link, image, heading, error), value: a row for each finding."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, html in zip(f[id_col], f[html_col], strict=True):
                reader = PageReader()
                reader.feed(html or "")
                rows += [(key, *found) for found in reader.finish()]
            yield pd.DataFrame(rows, columns=[id_col, "kind", "value"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, kind string, value string")


def broken_anchors(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """In-page links whose target the page does not have."""
    ids = found.where("kind = 'id'").select(id_col, "value").distinct()
    links = found.where("kind = 'link' AND value LIKE '#_%'").select(id_col, F.substring("value", 2, 1 << 30).alias("value"))
    return links.join(ids, [id_col, "value"], "left_anti")


def broken_links(found: DataFrame, files: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Relative links and images that are no file. files: name."""
    target = F.regexp_replace("value", r"[#?].*$", "")
    rows = found.where("kind IN ('link', 'image')").where(~F.col("value").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)"))
    return rows.select(id_col, "kind", target.alias("name")).where("name <> ''").join(files.select("name"), "name", "left_anti")


def statistics(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Counts by patterns, without leaving the JVM."""
    count = lambda p: F.regexp_count(F.coalesce(html_col, F.lit("")), F.lit(p))
    return pages.select(id_col, F.length(html_col).alias("size"), count(r"(?i)<h[1-4][\s>]").alias("n_headings"), count(r"(?i)<a\s[^>]*href=").alias("n_links"), count(r"(?i)<img[\s>]").alias("n_images"), count(r"(?i)<tr[\s>]").alias("n_rows"), count(r"(?i)<p[\s>]").alias("n_paragraphs"))
