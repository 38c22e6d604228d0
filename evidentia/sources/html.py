"""Rows from HTML pages: text blocks and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold a block of text, and those whose text is none.
BLOCKS = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "br", "tr", "table", "ul", "ol"}
SILENT = {"script", "style", "head", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.now, self.silent = [], [], 0

    def close_block(self):
        if text := " ".join("".join(self.now).split()):
            self.found.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.close_block()

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in BLOCKS:
            self.close_block()

    def handle_data(self, data):
        if not self.silent:
            self.now.append(data)


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, n, text) of every block of text, numbered from 1; null and empty pages have none, null ids stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = [], [], []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
                reader = _Reader()
                reader.feed(html.as_py() or "")
                reader.close()
                reader.close_block()
                ids += [page] * len(reader.found)
                numbers += range(1, len(reader.found) + 1)
                texts += reader.found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "n", "text"])

    return pages.select("page_id", "html").mapInArrow(rows, "page_id long, n int, text string")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every quoted link target, in order."""
    targets = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.where("html IS NOT NULL").select("page_id", F.posexplode(targets).alias("pos", "href"))
