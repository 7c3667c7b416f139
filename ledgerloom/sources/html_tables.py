"""Tables of HTML filings: cells, and for each heading the next table in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.headings import HEADING_TAGS, detect_unit, is_discussion, match_statement

LONGEST_HEADING = 150


class _Scan(HTMLParser):
    """One pass: the rows of tables, the texts of heading elements and the table that comes next after each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open_tables: list[int] = []
        self.cell: list[list[str]] = []
        self.open_headings: list[tuple[str, list[str]]] = []
        self.waiting: list[int] = []
        self.headings: list[tuple[str, int | None, str]] = []
        self.recent: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open_tables.append(len(self.tables))
            self.tables.append([])
            for k in self.waiting:
                text, _, context = self.headings[k]
                self.headings[k] = text, self.open_tables[-1], context
            self.waiting = []
        elif tag == "tr" and self.open_tables:
            self.tables[self.open_tables[-1]].append([])
        elif tag in ("td", "th") and self.open_tables and self.tables[self.open_tables[-1]]:
            self.cell.append([])
        elif tag in HEADING_TAGS:
            self.open_headings.append((tag, []))

    def handle_endtag(self, tag):
        if tag == "table" and self.open_tables:
            self.open_tables.pop()
        elif tag in ("td", "th") and self.cell:
            text = " ".join("".join(self.cell.pop()).split())
            if self.open_tables and self.tables[self.open_tables[-1]]:
                self.tables[self.open_tables[-1]][-1].append(text)
        elif tag in HEADING_TAGS:
            for k in range(len(self.open_headings) - 1, -1, -1):
                if self.open_headings[k][0] == tag:
                    text = " ".join("".join(self.open_headings.pop(k)[1]).split())
                    if text and len(text) <= LONGEST_HEADING:
                        self.waiting.append(len(self.headings))
                        self.headings.append((text, None, " ".join(self.recent[-6:])))
                    if text:
                        self.recent = [*self.recent[-6:], text]
                    break

    def handle_data(self, data):
        for _, parts in self.open_headings:
            parts.append(data)
        if self.cell:
            self.cell[-1].append(data)


#: A tag that reads the same by any rules: a plain name, attributes in double quotes, nothing else.
PLAIN_TAG = re.compile(r"""<(/?[A-Za-z][A-Za-z0-9]*)(?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9_-]*="[^"<>]*")*[ \t\n\r\f]*>""")
#: Elements whose contents aren't read as tags and text.
OPAQUE = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"))
_SEEN = frozenset(("table", "tr", "td", "th", *HEADING_TAGS))


def _scan(html: str | None) -> _Scan:
    """The parser's calls for ``html``. Where all that begins with ``<`` is a plain tag, cutting at tags finds the same ones as the parser, which takes many times as long."""
    scan = _Scan()
    parts = PLAIN_TAG.split(html or "")
    tags = [t.lower() for t in parts[1::2]]
    if (html or "").count("<") == len(tags) and OPAQUE.isdisjoint(tags):
        for text, tag in zip(parts[::2], [*tags, ""], strict=True):
            if text and (scan.cell or scan.open_headings):
                scan.handle_data(unescape(text) if "&" in text else text)
            if tag in _SEEN:
                scan.handle_starttag(tag, [])
            elif tag[1:] in _SEEN and tag[0] == "/":
                scan.handle_endtag(tag[1:])
        return scan
    scan.feed(html or "")
    scan.close()
    return scan


def _lists(lists: list[list]) -> tuple[pa.Array, list]:
    """The offsets of ``lists``, and all their elements."""
    return pa.array([0, *accumulate(map(len, lists))], pa.int32()), list(chain.from_iterable(lists))


def _rows(scans: list[_Scan]) -> pa.Array:
    offsets, rows = _lists([[(t, r, cells) for t, table in enumerate(s.tables) for r, cells in enumerate(x for x in table if x)] for s in scans])
    own, cells = _lists([c for _, _, c in rows])
    struct = pa.StructArray.from_arrays([pa.array([t for t, _, _ in rows], pa.int32()), pa.array([r for _, r, _ in rows], pa.int32()), pa.ListArray.from_arrays(own, pa.array(cells, pa.string()))], names=["table_idx", "row_idx", "cells"])
    return pa.ListArray.from_arrays(offsets, struct)


def _headings(scans: list[_Scan]) -> pa.Array:
    offsets, found = _lists([[(text, k, t, context) for k, (text, t, context) in enumerate(s.headings) if t is not None] for s in scans])
    kinds = {"heading": pa.string(), "ord": pa.int32(), "table_idx": pa.int32(), "context": pa.string()}
    struct = pa.StructArray.from_arrays([pa.array([x[n] for x in found], kind) for n, kind in enumerate(kinds.values())], names=list(kinds))
    return pa.ListArray.from_arrays(offsets, struct)


SCAN_SCHEMA = "sha256 string, rows array<struct<table_idx:int,row_idx:int,cells:array<string>>>, headings array<struct<heading:string,ord:int,table_idx:int,context:string>>"


def scanned(files: DataFrame, path: str | None = None) -> DataFrame:
    """``SCAN_SCHEMA`` of ``files`` (sha256, html): each file is parsed once. With a ``path`` the result is written and read again, for several uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scans = [_scan(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), _rows(scans), _headings(scans)], names=["sha256", "rows", "headings"])

    found = files.select("sha256", "html").mapInArrow(run, SCAN_SCHEMA)
    if path is None:
        return found
    found.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.schema(SCAN_SCHEMA).parquet(path)


def table_cells(files: DataFrame) -> DataFrame:
    """``sha256, table_idx, row_idx, cells`` of the tables in ``files`` (scanned, or sha256 and html); empty rows are left out."""
    found = files if "rows" in files.columns else scanned(files)
    return found.select("sha256", F.inline("rows"))


def statement_headings(files: DataFrame) -> DataFrame:
    """Headings of statements with the table that follows and the unit that heading and context tell; talk about statements is left out. ``files`` as for ``table_cells``."""
    found = (files if "headings" in files.columns else scanned(files)).select("sha256", F.inline("headings"))
    named = found.withColumn("kind", match_statement(F.col("heading"))).where(F.col("kind").isNotNull() & ~is_discussion(F.col("heading")))
    return named.withColumn("unit", detect_unit(F.concat_ws(" ", "heading", "context"))).drop("context")
