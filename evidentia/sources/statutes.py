"""Statute pages as rows: paragraphs, subsections and sentences with their paths, by a table function."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLANKS = re.compile("[ \t\n\r\f\v]+")
_PARAGRAPH = re.compile(r"§[ \xa0]*([0-9]+[a-z]?)")
_SUBSECTION = re.compile(r"\(([0-9]+[a-z]?)\) ")
_SENTENCE = re.compile("(?<=[.!?]) (?=[A-ZÄÖÜ])")
_DATE = re.compile("([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})")


class _Open:
    """An element that has not ended: what it is, and what it has gathered."""

    def __init__(self, tag: str, role: str | None):
        self.tag, self.role, self.texts, self.table = tag, role, [], False
        self.label: str | None = None  # of a norm
        self.subsections: list[str] = []

    @property
    def text(self) -> str:
        return " ".join(self.texts)


class _Page(HTMLParser):
    """Keeps a stack of open elements. An end tag closes all that was opened after its own start tag, and is passed
    over where there is none, so broken nesting ends no page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.norms: list[_Open] = []
        self.heading = self.title = None
        self.dates: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.dates.setdefault(attrs.get("name", "").lower(), attrs.get("content", ""))
        if tag == "table":
            for element in self.open:
                element.table = True
        if tag in VOID:
            return
        classes = attrs.get("class", "").split()
        role = next((c for c in ("jnnorm", "jurAbsatz") if tag == "div" and c in classes), "jnenbez" if tag == "span" and "jnenbez" in classes else tag if tag in ("title", "h1", "script", "style") else None)
        self.open.append(_Open(tag, role))
        if role == "jnnorm":
            self.norms.append(self.open[-1])

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open):
            while True:
                element = self.open.pop()
                self._closed(element)
                if element.tag == tag:
                    break

    def handle_data(self, data):
        data = _BLANKS.sub(" ", data).strip(" ")
        if data and not any(e.role in ("script", "style") for e in self.open):
            for element in self.open:
                if element.role in ("jurAbsatz", "jnenbez", "title", "h1"):
                    element.texts.append(data)

    def _closed(self, element: _Open) -> None:
        norm = next((e for e in reversed(self.open) if e.role == "jnnorm"), None)
        if element.role == "title" and self.title is None:
            self.title = element.text or None
        elif element.role == "h1" and self.heading is None:
            self.heading = element.text or None
        elif norm and element.role == "jnenbez" and norm.label is None:
            norm.label = element.text
        elif norm and element.role == "jurAbsatz" and not element.table and element.text:
            norm.subsections.append(element.text)

    def close(self):
        super().close()
        while self.open:
            self._closed(self.open.pop())


def _in_force(dates: dict[str, str]) -> datetime.date | None:
    for m in (_DATE.match(dates.get("date", "")), _DATE.search(dates.get("fundstelle", ""))):
        if m:
            try:
                return datetime.date(*map(int, m.groups()))
            except ValueError:
                continue
    return None


def parsed(html: str | None, law: str | None = None) -> Iterator[tuple]:
    """(n, unit, paragraph, subsection, sentence, path, text, in_force) of a page, in its order from 1.

    A paragraph is an element of class jnnorm whose heading names one; each subsection in it that holds text and no
    table gives a row (unit ``absatz``) and one for every sentence (``satz``), the latter without its number. A path
    without a number of its own leaves that level out. The law is given, or the page's heading or title. Null, empty
    and other pages give no rows.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    law, in_force, n = law or page.heading or page.title or "?", _in_force(page.dates), 0
    for norm in page.norms:
        m = _PARAGRAPH.search(norm.label or "")
        if not m:
            continue
        for text in norm.subsections:
            number = _SUBSECTION.match(text)
            levels = [law, f"§ {m[1]}", *([f"Abs. {number[1]}"] if number else [])]
            n += 1
            yield n, "absatz", m[1], number and number[1], None, " > ".join(levels), text, in_force
            for k, sentence in enumerate(_SENTENCE.split(text[number.end() :] if number else text), 1):
                n += 1
                yield n, "satz", m[1], number and number[1], k, " > ".join((*levels, f"Satz {k}")), sentence, in_force


@udtf(returnType="n int, unit string, paragraph string, subsection string, sentence int, path string, text string, in_force date")
class StatuteRows:
    """Table function over (html, law)."""

    def eval(self, html: str, law: str):
        yield from parsed(html, law)


def statute_rows(pages: DataFrame) -> DataFrame:
    """Rows of every page (page_id, html, law; law may be null), called laterally. Ids may be null and repeat."""
    return pages.select("page_id", "html", "law").lateralJoin(StatuteRows(F.col("html").outer(), F.col("law").outer())).drop("html", "law")
