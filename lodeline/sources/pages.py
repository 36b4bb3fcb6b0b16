"""HTML: element blocks through the standard library's parser, links by expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Children(HTMLParser):
    """The element children of body, or of the document where there is no body: (label, first line, last line)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.nodes: list[tuple[tuple[str, ...], str, int]] = []
        self.ends: list[int] = []
        self.body_end = 0

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        if tag not in VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def _open(self, tag, attrs) -> None:
        label = tag
        for name, value in attrs:
            parts = (value or "").split()
            if name in ("id", "class") and parts:
                label = f"{tag}{'#' if name == 'id' else '.'}{parts[0]}"
                break
        self.nodes.append((tuple(self.stack), label, self.getpos()[0]))

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "body":
            self.body_end = self.getpos()[0]


def element_blocks(source: str) -> list[tuple[str, int, int]]:
    """(name, start_line, end_line) of each child; a child reaches to the line before the next one."""
    parser = _Children()
    parser.feed(source or "")
    parser.close()
    inside = [n for n in parser.nodes if n[0] and n[0][-1] == "body"]
    chosen = inside or [n for n in parser.nodes if not n[0]]
    last = parser.body_end if inside and parser.body_end else len((source or "").splitlines())
    out = []
    for i, (_, label, line) in enumerate(chosen):
        end = chosen[i + 1][2] - 1 if i + 1 < len(chosen) else last
        out.append((label, line, max(line, end)))
    return out


def html_blocks(files: DataFrame) -> DataFrame:
    """Blocks of HTML files(file_id, source): (file_id, ordinal, name, start_line, end_line)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n + 1, *b) for i, s in zip(f["file_id"], f["source"]) for n, b in enumerate(element_blocks(s))]
            yield pd.DataFrame(rows, columns=["file_id", "ordinal", "name", "start_line", "end_line"])

    return files.select("file_id", "source").mapInPandas(run, "file_id long, ordinal int, name string, start_line int, end_line int")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href): the targets of all links of pages(page_id, html), repeats kept."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""href=["']([^"']*)["']"""), F.lit(1))).alias("href"))
