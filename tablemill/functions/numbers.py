"""Numbers as Column expressions: reading them from cells, comparing and rounding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.sources import packs

from .text import let, strip


def parse_number(s: Column) -> Column:
    """The number in a cell, or null.

    Dots and commas are thousands or decimals by their places: with both, the later is decimal; with one kind, groups of
    three after a first of one to three are thousands, else what follows the first is the fraction. Parentheses or
    a leading minus negate; dates, null marks and anything else give null.
    """

    def read(t: Column) -> Column:
        body = F.regexp_replace(t, r"^[-−+]", "")
        both = F.contains(body, F.lit(".")) & F.contains(body, F.lit(","))
        whole = (
            F.when(both, F.regexp_replace(F.regexp_extract(body, r"^(.*)[.,][^.,]*$", 1), "[.,]", ""))
            .when(body.rlike(r"^[0-9]{1,3}([.,][0-9]{3})*$"), F.regexp_replace(body, "[.,]", ""))
            .otherwise(F.regexp_extract(body, r"^([^.,]*)", 1))
        )
        fraction = (
            F.when(both, F.regexp_extract(body, r"([^.,]*)$", 1))
            .when(body.rlike(r"^[0-9]{1,3}([.,][0-9]{3})*$"), F.lit(""))
            .otherwise(F.regexp_replace(F.regexp_extract(body, r"^[^.,]*(.*)$", 1), "[.,]", ""))
        )
        value = F.concat(whole, F.lit("."), fraction, F.lit("0")).try_cast("double")
        return F.when(body.rlike(r"^[0-9.,]+$") & (whole != ""), F.struct(value.alias("value"), t.rlike("^[-−]").alias("minus")))

    def clean(raw: Column) -> Column:
        inner = raw.rlike(r"(?s)^\(.*\)$") & (F.length(raw) > 1)
        t = F.when(inner, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        t = F.regexp_replace(F.regexp_replace(strip(t), "%+$", ""), r"(?U)\s", "")
        got = let(t, read)
        null = raw.isin("", *packs.NULL_CELLS) | raw.rlike(r"^\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4}$")
        return F.when(~null, let(got, lambda g: F.when(inner | g["minus"], -g["value"]).otherwise(g["value"])))

    return let(strip(s), clean)


def is_close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-9) -> Column:
    """Symmetric relative and absolute tolerance; nulls and NaN are close to nothing."""
    near = F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.coalesce((a == b) | near, F.lit(False)) & ~F.coalesce(F.isnan(a) | F.isnan(b), F.lit(False))


def within(lhs: Column, rhs: Column, relative: float) -> Column:
    """Relative tolerance against the right side, whose size counts as 1 at least."""
    return F.abs(lhs - rhs) <= relative * F.greatest(F.abs(rhs), F.lit(1.0))


def finite(x: Column) -> Column:
    """The value, or null for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def n_targets(tickers: Column, years: Column, n_docs: Column | None = None) -> Column:
    """Pairs of company and year that a question touches, at most the documents that there are."""
    n = F.greatest(F.size(tickers), F.lit(1)) * F.greatest(F.size(years), F.lit(1))
    return n if n_docs is None else F.when(n_docs > 0, F.least(n, n_docs)).otherwise(n)


def gold_tables(tickers: Column, years: Column, ops: Column, n_docs: Column | None = None) -> Column:
    """Expected number of tables that answer a question: more a pair of company and year where operations compare."""
    each = F.when(F.arrays_overlap(ops, F.array(F.lit("RATIO"), F.lit("DIFF"), F.lit("GROWTH"))), 1.8).otherwise(1.2)
    return each * n_targets(tickers, years, n_docs)


def adaptive_k(tickers: Column, years: Column, ops: Column, k_max: int = 12, n_docs: Column | None = None, mult: float = 2.5) -> Column:
    """Tables to return: `mult` times the expected number, rounded half to even, from 2 to k_max."""
    return F.greatest(F.lit(2), F.least(F.lit(k_max), F.bround(mult * gold_tables(tickers, years, ops, n_docs), 0).cast("int"))).cast("int")


def adaptive_docs(tickers: Column, years: Column, cap: int = 8, n_docs: Column | None = None) -> Column:
    """Documents to return: one more than the pairs, at most the documents that there are and the cap."""
    n = n_targets(tickers, years, n_docs) + 1
    if n_docs is not None:
        n = F.when(n_docs > 0, F.least(n, n_docs)).otherwise(n)
    return F.greatest(F.lit(1), F.least(F.lit(cap), n)).cast("int")


def worth_adding(p: Column, hits: Column, gold: Column, returned: Column) -> Column:
    """Whether one more table that is right with probability p raises F2: p above hits / (4 * gold + returned)."""
    return p * (4.0 * gold + returned) > hits


def f2(hits: Column, gold: Column, returned: Column) -> Column:
    """F-beta with beta 2 from counts."""
    return F.coalesce(F.try_divide(5.0 * hits, 4.0 * gold + returned), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
