"""Fields of HTML pages: by patterns where a field has a fixed form, by a parser where the tree counts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HREF = r'<a [^>]*href="([^"]*)"'
#: Elements of a batch.
MOST = 1 << 13
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def cards(pages: DataFrame) -> DataFrame:
    """page_id, lang, paragraphs, links, first_link, host, safe."""
    from nightloom.functions.clock import safe_url

    return pages.select(
        "page_id", F.regexp_extract("html", r'<html[^>]* lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"),
        F.size(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", HREF, 1).alias("first_link"), F.parse_url("url", F.lit("HOST")).alias("host"), safe_url(F.col("url")).alias("safe"),
    )


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))


class Elements(HTMLParser):
    """(order, parent's order, depth, name, pieces of own text) of every element of one page, and the text outside all elements.

    Pages are fed whole and closed: what a page leaves unfinished at its end is text."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int, str, list[str]]] = []
        self.stack: list[int] = []
        self.outside: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append((len(self.rows), self.stack[-1] if self.stack else -1, len(self.stack), tag, []))
        if tag not in VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[i]][3] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if data.strip():
            (self.rows[self.stack[-1]][4] if self.stack else self.outside).append(data)

    def close(self):
        super().close()
        if self.rawdata:  # of a script or style without an end, which the parser keeps back
            self.handle_data(self.rawdata)
            self.rawdata = ""


ELEMENT = pa.struct([("n", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), ("name", pa.string()), ("text", pa.string())])


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(page_id, its elements, its text outside them) of pages with MOST elements together or a little more, whatever pages come at
    once; a page's text is a Python string only while it is parsed."""
    out, size = [], 0
    for batch in batches:
        for page_id, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
            p = Elements()
            p.feed(html.as_py() or "")
            p.close()
            out.append((page_id.as_py(), [(*r[:4], "".join(r[4])) for r in p.rows], "".join(p.outside)))
            size += len(p.rows) + 1
            if size >= MOST:
                yield out
                out, size = [], 0
    if out:
        yield out


def columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(ELEMENT), ELEMENT, strict=True)]


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element."""
    for pages in read(batches):
        ids = [i for i, rows, _ in pages for _ in rows]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns([r for _, rows, _ in pages for r in rows])], ["page_id", *(f.name for f in ELEMENT)])


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page."""
    for pages in read(batches):
        flat = pa.StructArray.from_arrays(columns([r for _, rows, _ in pages for r in rows]), fields=list(ELEMENT))
        ends = [0, *accumulate(len(rows) for _, rows, _ in pages)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pages], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([p[2] for p in pages], pa.string())], ["page_id", "tree", "outside"])


def trees(pages: DataFrame) -> DataFrame:
    """A row for each page, also for those without elements: page_id, tree (array of its elements: n, parent, depth, name, own text)
    and outside, its text outside all elements."""
    return pages.select("page_id", "html").mapInArrow(whole, "page_id long, tree array<struct<n:long,parent:long,depth:long,name:string,text:string>>, outside string")


def elements(pages: DataFrame) -> DataFrame:
    """A row for each element: page_id, n, parent, depth, name, text."""
    return pages.select("page_id", "html").mapInArrow(parsed, "page_id long, n long, parent long, depth long, name string, text string")
