"""Quality control of facts: accounting identities, agreement between years, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numbers import within
from tablemill.sources import packs

from .facts import MAIN_STATEMENTS


def concept_pivot(facts: DataFrame, concepts: list[str], keys: list[str] | None = None) -> DataFrame:
    """The median value of each concept by document, year and side of the period: one column a concept, in one aggregation."""
    keys = keys or ["doc_id", "period_year", "is_begin"]
    main = facts.where(F.col("statement").isin(MAIN_STATEMENTS) & F.col("concept").isin(concepts))
    return main.groupBy(*keys).pivot("concept", concepts).agg(F.median("value"))


def identities(facts: DataFrame, rules: list[tuple] = packs.IDENTITIES, tolerance: float = 0.005) -> DataFrame:
    """(rule, n, passed, rate) of each identity over the groups that have all its parts; rate is null without any."""
    concepts = list(dict.fromkeys(c for _, target, parts, _ in rules for c in (target, *parts)))
    pivot = concept_pivot(facts, concepts)
    made: dict[str, Column] = {}
    for name, target, parts, how in rules:
        p = [F.col(x) for x in parts]
        lhs = p[0] if how == "same" else p[0] - F.abs(p[1]) if how == "less" else sum(p[1:], p[0])
        made[name] = within(lhs, F.col(target), tolerance)  # null where a part is missing
    checks = pivot.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("ok")) for k, v in made.items()))).alias("c")).select("c.*")
    return checks.groupBy("rule").agg(F.count("ok").alias("n"), F.count_if("ok").alias("passed"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("rate"))


def cross_year(facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Opening values of a year beside the closing values of the year before: (keys…, beg, end, ok, dev)."""
    keys = ["ticker", "stmt_type", "period_year", "concept"]
    sheet = facts.where(F.col("concept").isNotNull() & (F.col("statement") == "CDKT"))
    sides = sheet.groupBy(*keys).agg(F.median(F.when(F.col("is_begin"), F.col("value"))).alias("beg"), F.median(F.when(~F.col("is_begin"), F.col("value"))).alias("end"))
    beg = sides.where("beg is not null").select("ticker", "stmt_type", (F.col("period_year") - 1).alias("period_year"), "concept", "beg")
    both = beg.join(sides.where("end is not null").drop("beg"), keys)
    return both.withColumns({"ok": within(F.col("beg"), F.col("end"), tolerance), "dev": F.abs(F.col("beg") - F.col("end"))})


def cross_year_summary(facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return cross_year(facts, tolerance).agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("rate"))


def worst(facts: DataFrame, tolerance: float = 0.01, n: int = 20) -> DataFrame:
    """The n largest deviations between years; ties by key."""
    return cross_year(facts, tolerance).where("not ok").orderBy(F.desc("dev"), "ticker", "stmt_type", "period_year", "concept").limit(n)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def coverage(facts: DataFrame) -> DataFrame:
    """Distinct concepts of each company and year, and over them the groups and the median."""
    each = facts.where("concept is not null").groupBy("ticker", "period_year").agg(F.countDistinct("concept").alias("concepts"))
    return each.agg(F.count("*").alias("groups"), F.countDistinct("ticker").alias("tickers"), F.median("concepts").alias("median_concepts"))


def corpus_checks(tables: DataFrame, least_valid: float = 0.99, least_periods: float = 0.8) -> DataFrame:
    """(check, value, ok): tables with a grid, main statements with period columns, failures."""
    main = F.col("section").isin(MAIN_STATEMENTS) & (F.col("n_numeric_cells") >= 6)
    dated = F.exists("col_periods", lambda p: p["year"].isNotNull())
    t = tables.agg(F.count("*").alias("tables"), F.countDistinct("doc_id").alias("documents"), F.avg((F.size("grid") > 0).cast("int")).alias("valid_grids"), F.avg(F.when(main, dated.cast("int"))).alias("dated_statements"))
    rows = F.array(
        F.struct(F.lit("tables").alias("check"), F.col("tables").cast("double").alias("value"), (F.col("tables") > 0).alias("ok")),
        F.struct(F.lit("documents").alias("check"), F.col("documents").cast("double").alias("value"), (F.col("documents") > 0).alias("ok")),
        F.struct(F.lit("valid_grids").alias("check"), F.col("valid_grids").alias("value"), (F.col("valid_grids") >= least_valid).alias("ok")),
        F.struct(F.lit("dated_statements").alias("check"), F.col("dated_statements").alias("value"), (F.col("dated_statements") >= least_periods).alias("ok")),
    )
    return t.select(F.explode(rows).alias("r")).select("r.*")


def suspicious(tables: DataFrame, n: int = 50) -> DataFrame:
    """Tables of four rows or more without a number, the longest first."""
    return tables.where("n_numeric_cells = 0 and n_rows >= 4").orderBy(F.desc("n_rows"), "doc_id", "table_idx").limit(n)


def report(sections: dict[str, DataFrame]) -> str:
    """Small results as Markdown tables under headings."""
    out = []
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.collect()] + [""]
    return "\n".join(out)


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0, ascending) of a column of numbers, exactly; nulls and NaN don't count.

    Selection by histogram: each pass counts every still open interval's values in BINS bins and keeps, for each rank, the bin that it falls into with
    that bin's own least and greatest value. Where these are equal the value is found. No value is sorted or gathered; the driver reads BINS rows
    an open interval. Give it a table: it is read a few times.
    """
    x = F.col(f"`{column}`").cast("double")
    held = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    n, low, high = held.agg(F.count("*"), F.min("x"), F.max("x")).first()
    bad = [r for r in ranks if not 0 <= r < n]
    if bad:
        raise ValueError(f"ranks {bad} of {n} values")
    spans = {r: (0, low, high) for r in ranks}  # values below the interval, its least and greatest value
    while True:
        wide = sorted({s for s in spans.values() if s[1] < s[2]}, key=lambda s: s[1])
        if not wide:
            return {r: s[1] for r, s in spans.items()}
        where = None
        for i, (_, a, b) in enumerate(wide):
            width = b / BINS - a / BINS
            # the last bin takes what rounding puts beyond it; an interval too narrow to divide is halved at its least value
            bin_ = F.least(F.floor((F.col("x") / width) - a / width), F.lit(BINS - 1)) if width > 0 and abs(a / width) < 1e15 else F.when(F.col("x") > a, 1).otherwise(0)
            bin_ = F.greatest(bin_.cast("int"), F.lit(0)) + i * BINS
            inside = F.col("x").between(a, b)
            where = F.when(inside, bin_) if where is None else where.when(inside, bin_)
        rows = held.withColumn("bin", where).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for r, (below, a, b) in list(spans.items()):
            if a < b:
                i = wide.index((below, a, b))
                for row in sorted((x for x in rows if x["bin"] // BINS == i), key=lambda x: x["a"]):
                    if below + row["n"] > r:
                        spans[r] = (below, row["a"], row["b"])
                        break
                    below += row["n"]


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; None for no values."""
    x = F.col(f"`{column}`").cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    found = order_statistics(df, column, sorted({int(f(p)) for p in at for f in (math.floor, math.ceil)}))
    return [found[math.floor(p)] + (p - math.floor(p)) * (found[math.ceil(p)] - found[math.floor(p)]) if p % 1 else found[int(p)] for p in at]


#: Bins of an interval in one pass.
BINS = 1024
