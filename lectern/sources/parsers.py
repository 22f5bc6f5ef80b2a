"""Documents to pages and paragraphs."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Blocks(HTMLParser):
    """The title and the texts of <p> and <div> elements; a block ends where another begins or closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.open, self.skip, self.in_title = "", [], None, 0, False

    def _close(self):
        if self.open is not None and (text := " ".join("".join(self.open).split())):
            self.blocks.append(text)
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("p", "div"):
            self._close()
            self.open = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("p", "div", "article", "body", "html"):
            self._close()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip and self.open is not None:
            self.open.append(data)


def html_blocks(html: str | None) -> tuple[str, list[str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._close()
    return " ".join(parser.title.split()), parser.blocks


def html_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, pos, content) of each paragraph; pages without one give no row."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, title, pos, b) for k, h in zip(batch[key], batch[html], strict=True) for title, blocks in [html_blocks(h)] for pos, b in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=[key, "title", "pos", "content"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, title string, pos int, content string")


def text_paragraphs(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, content): the lines of a plain text that are not blank."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "content")).filter(F.trim("content") != "")


def xml_skeleton(content: str | bytes) -> str:
    """An outline of an XML document: each kind of child once, with its attributes, and whether it has text."""
    out: list[str] = []

    def walk(node: ET.Element, depth: int) -> None:
        attrs = "".join(f" @{a}" for a in node.attrib)
        out.append("  " * depth + node.tag + attrs + (" [text]" if (node.text or "").strip() else ""))
        seen: set[str] = set()
        for child in node:
            if child.tag not in seen:
                seen.add(child.tag)
                walk(child, depth + 1)

    walk(ET.fromstring(content), 0)
    return "\n".join(out)


def zip_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, member, content) of every file in each archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch[path], batch[content], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame([(p, name, z.read(name))], columns=["path", "member", "content"])

    return files.select(path, content).mapInPandas(run, "path string, member string, content binary")
