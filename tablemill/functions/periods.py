"""What headers and lines say of units, periods and sections, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.sources import packs

from .text import first_matching, fold, let

PERIOD = "struct<period_type:string,year:int,is_begin:boolean>"


def _unit(folded: Column) -> Column:
    return first_matching(folded, packs.TABLE_UNITS)


def detect_unit(caption: Column, header: Column) -> Column:
    """struct(scale, source): a header's unit above 1, else the caption's, else the header's, else 1."""

    def choose(h: Column) -> Column:
        def with_caption(c: Column) -> Column:
            header_counts = h.isNotNull() & ((h > 1) | c.isNull())
            scale = F.when(header_counts, h).otherwise(F.coalesce(c, F.lit(1.0)))
            source = F.when(header_counts, "header_cell").when(c.isNotNull(), "caption").otherwise("default")
            return F.struct(scale.alias("scale"), source.alias("source"))

        return let(_unit(fold(caption)), with_caption)

    return let(_unit(fold(header)), choose)


def classify_period(header: Column, doc_year: Column, section: Column) -> Column:
    """struct(period_type, year, is_begin) of a column header, or null if it names no period."""
    p = packs.PERIODS

    def period(kind: str | Column, year: Column, begin: Column | bool = False) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("period_type"), year.cast("int").alias("year"), (F.lit(begin) if isinstance(begin, bool) else begin).alias("is_begin"))

    def rules(f: Column) -> Column:
        group = lambda name, i: F.regexp_extract(f, p[name], i).try_cast("int")
        bare = F.when(section.isin("KQKD", "LCTT"), "flow").otherwise("stock")
        return (
            F.when(f.rlike(p["date"]), period("stock", group("date", 3), (group("date", 1) == 1) & (group("date", 2) == 1)))
            .when(f.rlike(p["named_year"]), period("flow", group("named_year", 1)))
            .when(f.rlike(p["closing"]), period("stock", doc_year))
            .when(f.rlike(p["opening"]), period("stock", doc_year, True))
            .when(f.rlike(p["this_year"]), period("flow", doc_year))
            .when(f.rlike(p["last_year"]), period("flow", doc_year - 1))
            .when(f.rlike(p["bare_year"]), period(bare, group("bare_year", 1)))
        )

    return let(fold(header), rules)


def section_of_form(line: Column) -> Column:
    """The section that a form code in the line stands for."""
    table = F.create_map(*[F.lit(x) for kv in packs.FORM_SECTIONS.items() for x in kv])
    code = F.concat(F.upper(F.regexp_extract(line, packs.FORM_CODE, 2)), F.regexp_extract(line, packs.FORM_CODE, 1).try_cast("int").cast("string"))
    return F.try_element_at(table, code)


def section_of_heading(folded_line: Column) -> Column:
    """The section that the first heading contained in the line starts."""
    out = None
    for words, section in packs.HEADINGS:
        hit = F.contains(folded_line, F.lit(words))
        out = F.when(hit, section) if out is None else out.when(hit, section)
    return out


def section_of_line(line: Column) -> Column:
    return F.coalesce(section_of_form(line), section_of_heading(fold(line)))


def period_bonus(is_begin: Column, period_type: Column, statement: Column, want: Column) -> Column:
    """How well a fact's period fits the point in time that is asked for (begin, end, period or none)."""
    closing = ~is_begin & (period_type == "stock")
    flow = period_type == "flow"
    return (
        F.when(want == "begin", is_begin.cast("double"))
        .when(want == "end", F.when(closing, 1.0).otherwise(0.25))
        .when(want == "period", F.when(flow, 1.0).otherwise(0.25))
        .when(statement == "CDKT", F.when(closing, 1.0).otherwise(0.15))
        .when(statement.isin("KQKD", "LCTT"), F.when(flow, 1.0).otherwise(0.5))
        .otherwise(F.when(~is_begin, 0.8).otherwise(0.2))
    )


def column_period_score(period: Column, years: Column, want: Column, section: Column, relax: bool = False) -> Column:
    """The same for a table's column: the year counts 0.6 and a wrong one rules it out, unless relaxed."""
    closing = ~period["is_begin"] & (period["period_type"] == "stock")
    flow = period["period_type"] == "flow"
    asked = F.size(years) > 0
    right = asked & F.coalesce(F.array_contains(years, period["year"]), F.lit(False))
    base = F.when(right, 0.6).when(asked, 0.05).otherwise(0.2)
    point = (
        F.when(want == "begin", F.when(period["is_begin"], 0.4).otherwise(0.0))
        .when(want == "end", F.when(closing, 0.4).otherwise(0.1))
        .when(want == "period", F.when(flow, 0.4).otherwise(0.1))
        .when(section == "CDKT", F.when(closing, 0.4).otherwise(0.05))
        .when(section.isin("KQKD", "LCTT"), F.when(flow, 0.4).otherwise(0.2))
        .otherwise(F.when(~period["is_begin"], 0.25).otherwise(0.05))
    )
    none = F.lit(0.10 if relax else 0.0)
    wrong = F.lit(False) if relax else asked & ~right
    return F.when(period.isNull(), none).when(wrong, 0.0).otherwise(base + point)
