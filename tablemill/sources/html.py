"""Tolerant reading of HTML tables: the one place where a Python function is needed."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a span above this counts as 1.
MAX_SPAN = 60


class _TableEvents(HTMLParser):
    """Lists rows of cells; a cell is [pieces of text, rows, columns]. Cells and rows may go without end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = [[]]
        self.open: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th"):
            spans = dict(attrs)
            self.open = [[], _span(spans.get("rowspan")), _span(spans.get("colspan"))]
            self.rows[-1].append(self.open)
        elif tag == "tr":
            self._end_row()
        elif tag == "br" and self.open:
            self.open[0].append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = None
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if self.open:
            self.open[0].append(data)

    def _end_row(self):
        self.open = None
        if self.rows[-1]:
            self.rows.append([])


def _span(value: str | None) -> int:
    text = (value or "").strip()
    return int(text) if text.isdecimal() and 1 <= int(text) <= MAX_SPAN else 1


def html_to_grid(html: str | None) -> list[list[str]]:
    """A rectangle of texts: spans are filled with copies, a cell goes to the first free column, and spans may reach below the last row.

    What the parser can't read ends the table; the cells before it are kept.
    """
    return read_grid(html)[0]


def read_grid(html: str | None) -> tuple[list[list[str]], str | None]:
    """The grid, and why the parser gave up, if it did."""
    events, fault = _TableEvents(), None
    try:
        events.feed(html or "")
        events.close()
    except (AssertionError, ValueError, IndexError) as e:
        fault = f"{type(e).__name__}: {e}"
    lines: list[dict[int, str]] = []
    for at, row in enumerate(filter(None, events.rows)):
        column = 0
        for pieces, down, across in row:
            lines += [{} for _ in range(at + down - len(lines))]
            while column in lines[at]:
                column += 1
            text = " ".join("".join(pieces).split())
            for line in lines[at : at + down]:
                line.update(dict.fromkeys(range(column, column + across), text))
            column += across
    width = max((c for line in lines for c in line), default=-1) + 1
    return [[line.get(c, "") for c in range(width)] for line in lines], fault


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _grids(html: pd.Series) -> pd.Series:
    return html.map(html_to_grid)


def grid(html: Column) -> Column:
    """The grid of one table's HTML; empty for null or text without cells."""
    return _grids(html)


def tables_in(text: Column) -> Column:
    """The HTML of each table in a text, in order: from an opening tag to the first closing tag."""
    return F.regexp_extract_all(text, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
