"""One pass over a document as an Arrow table function: line starts, page and section so far, captions, table positions and grids. No shuffle."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.sources import html, packs

PAGE = re.compile(r"=====\s*PAGE\s+(\d+)\s*=====\s*$")
#: Lines above a table that its caption may come from, lines that it takes, the longest line that counts, and the caption's length.
CAPTION_WINDOW, CAPTION_LINES, LINE_CHARS, CAPTION_CHARS = 11, 3, 300, 500
#: Bytes of HTML after which rows are handed on, and characters of a fault's text that are kept.
BATCH_CHARS, FAULT_CHARS = 4 << 20, 500

_OPEN, _CLOSE, _FORM = re.compile(r"<table\b", re.I), re.compile(r"</table>", re.I), re.compile(packs.FORM_CODE)


def fold(line: str) -> str:
    """The text function of this name, on one string."""
    plain = "".join(c for c in unicodedata.normalize("NFD", line.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
    return " ".join(plain.split()).upper()


@lru_cache(maxsize=50_000)
def section_of(line: str) -> str | None:
    """The section that a line starts: by its form code, else by the first heading in it."""
    form = _FORM.search(line)
    section = packs.FORM_SECTIONS.get(f"{form[2].upper()}{int(form[1])}") if form else None
    if section is None:
        folded = fold(line)
        section = next((s for words, s in packs.HEADINGS if words in folded), None)
    return section


@dataclass(frozen=True)
class Found:
    """A table's place in its text: offsets from 0 in code points, lines and tables from 1."""

    table_idx: int
    char_start: int
    char_end: int
    line_no: int
    page_no: int | None
    section: str
    caption: str


def spans(text: str) -> Iterator[tuple[int, int]]:
    """From each opening tag to the first closing tag after it; a tag that nothing closes ends the search."""
    at = 0
    while (a := _OPEN.search(text, at)) and (b := _CLOSE.search(text, a.end())):
        yield a.start(), b.end()
        at = b.end()


def find_tables(text: str) -> Iterator[Found]:
    """The tables of a text, in order. Page and section are the last ones up to the table's line; a caption takes the nearest lines above it."""
    places = list(spans(text))
    if not places:
        return
    lines = text.split("\n")
    starts, at = [], 0
    pages: list[tuple[int, int | None]] = []
    sections: list[tuple[int, str]] = []
    said = []  # what a line says for a caption; empty for blank and long lines and page marks
    for line in lines:
        starts.append(at)
        at += len(line) + 1
        if len(line) > 4 * LINE_CHARS:  # a table in one line
            said.append("")
            continue
        s = line.strip()
        page = PAGE.match(s)
        said.append("" if page or len(s) > LINE_CHARS else s)
        if len(line) > LINE_CHARS or not s:
            continue
        if page:
            number = int(page[1][-18:])
            pages.append((starts[-1], number if len(page[1].lstrip("0")) < 10 or number < 1 << 31 and len(page[1].lstrip("0")) == 10 else None))
        elif section := section_of(s):
            sections.append((starts[-1], section))
    page_at, section_at = [p for p, _ in pages], [p for p, _ in sections]
    for i, (a, b) in enumerate(places, 1):
        line = bisect_right(starts, a) - 1
        above = [s for s in said[max(line - CAPTION_WINDOW, 0) : line] if s][-CAPTION_LINES:]
        p, q = bisect_right(page_at, a), bisect_right(section_at, a)
        yield Found(i, a, b, line + 1, pages[p - 1][1] if p else None, sections[q - 1][1] if q else "OTHER", " | ".join(above)[:CAPTION_CHARS])


SCANNED = (
    "doc_id string, ticker string, year int, stmt_type string, table_idx int, char_start int, char_end int, line_no int, page_no int, section string, caption string, raw_html string, "
    "grid array<array<string>>, stage string, fault string, digest string"
)
_KINDS = [
    ("doc_id", pa.string()), ("ticker", pa.string()), ("year", pa.int32()), ("stmt_type", pa.string()), ("table_idx", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("line_no", pa.int32()),
    ("page_no", pa.int32()), ("section", pa.string()), ("caption", pa.string()), ("raw_html", pa.string()), ("grid", pa.list_(pa.list_(pa.string()))), ("stage", pa.string()), ("fault", pa.string()), ("digest", pa.string()),
]


def scan(docs: DataFrame) -> DataFrame:
    """A row for each table of (doc_id, ticker, year, stmt_type, text), and one for each fault; a fault costs only what it names.

    Stage `text`: the document has no text. Stage `document`: its text could not be read, so it has no tables. Stage `html`: a table's parser gave up; the table's row has
    the cells before that, and `fault` says why. A column `digest`, if docs have it, stays. Every row of docs counts, whatever doc_id it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(_KINDS)], [name for name, _ in _KINDS])

        for b in batches:
            for at in range(b.num_rows):
                *own, text, digest = (b.column(i)[at].as_py() for i in range(6))
                if text is None:
                    out.append((*own, *[None] * 9, "text", "no text", digest))
                    continue
                try:
                    found = list(find_tables(text))
                except (ValueError, IndexError, RecursionError) as e:
                    out.append((*own, *[None] * 9, "document", f"{type(e).__name__}: {e}"[:FAULT_CHARS], digest))
                    continue
                for t in found:
                    raw = text[t.char_start : t.char_end]
                    grid, fault = html.read_grid(raw)
                    out.append((*own, t.table_idx, t.char_start, t.char_end, t.line_no, t.page_no, t.section, t.caption, raw, grid, fault and "html", fault and fault[:FAULT_CHARS], digest))
                    size += len(raw)
                    if size >= BATCH_CHARS:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    names = [F.col("doc_id").cast("string"), F.col("ticker").cast("string"), F.col("year").cast("int"), F.col("stmt_type").cast("string"), F.col("text").cast("string")]
    names.append(F.col("digest") if "digest" in docs.columns else F.lit(None).cast("string").alias("digest"))
    return docs.select(*names).mapInArrow(run, SCANNED)
