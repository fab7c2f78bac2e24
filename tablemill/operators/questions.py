"""Questions to a typed description (IR): companies, years, scope, unit, point in time, operations, tier and retrieval query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import collapse, fold, found_at, let, matches
from tablemill.sources import packs

from . import companies as names

IR = (
    "qid int, question string, tickers array<string>, years array<int>, year_span struct<first:int,last:int>, stmt_type string, stmt_explicit boolean, unit_kind string, "
    "unit_scale double, time_point string, ops array<string>, tier int, retrieval_query string"
)


def _ints(s: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), lambda x: x.cast("int"))


def year_ranges(folded: Column) -> Column:
    """struct(first, last) of every range of years that is not reversed or too long."""
    pairs = [F.zip_with(_ints(folded, p, 1), _ints(folded, p, 2), lambda a, b: F.struct(a.alias("first"), b.alias("last"))) for p in packs.YEAR_RANGES]
    return F.filter(F.concat(*pairs), lambda r: (r["first"] <= r["last"]) & (r["last"] <= r["first"] + packs.RANGE_YEARS))


def years(folded: Column, bounds: tuple[int, int] = packs.YEAR_BOUNDS) -> Column:
    """Distinct years in order: of ranges, dates and alone, within the bounds."""
    spread = F.flatten(F.transform(year_ranges(folded), lambda r: F.sequence(r["first"], r["last"])))
    found = F.concat(spread, *(_ints(folded, p, 3) for p in packs.YEAR_DATES), _ints(folded, packs.YEAR_ALONE, 1))
    return F.sort_array(F.array_distinct(F.filter(found, lambda y: y.between(*bounds))))


def year_span(folded: Column) -> Column:
    return let(year_ranges(folded), lambda r: F.when(F.size(r) > 0, F.struct(F.array_min(F.transform(r, lambda x: x["first"])).alias("first"), F.array_max(F.transform(r, lambda x: x["last"])).alias("last"))))


def _starts(s: Column, pattern: str) -> Column:
    """Start (from 0) of every match: after all pieces and matches before it."""
    hits = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(s, f"(?:{pattern})")
    ends = F.transform(hits, lambda h, i: F.aggregate(F.zip_with(F.slice(pieces, 1, i + 1), F.concat(F.array(F.lit(0)), F.transform(F.slice(hits, F.lit(1), i), F.length)), lambda p, n: F.length(p) + n), F.lit(0), lambda a, x: a + x))
    return ends


def answer_unit(folded: Column) -> Column:
    """struct(kind, scale): a year or a count if asked for; else the first unit after the last ask phrase that has one after it, else the last unit; else VND."""
    unit = lambda kind, scale: F.struct(F.lit(kind).alias("kind"), F.lit(scale).alias("scale"))

    def hit(order: int, kind: str, scale: float):
        return lambda at: F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), F.lit(scale).alias("scale"))

    found = F.concat(*(F.transform(_starts(folded, p), hit(i, k, x)) for i, (p, k, x) in enumerate(packs.ANSWER_UNITS)))

    def choose(hits: Column) -> Column:
        def after_ask(asks: Column) -> Column:
            last = F.array_max(F.transform(hits, lambda h: h["at"]))
            ask = F.array_max(F.filter(asks, lambda a: a <= last))  # the last phrase that a unit follows
            first = F.array_min(F.filter(hits, lambda h: h["at"] >= ask))
            # of units at the same last place the one that comes last in the table
            return F.coalesce(F.when(ask.isNotNull(), first), F.array_max(hits))

        best = let(_starts(folded, packs.ASK_PHRASE), after_ask)
        return F.when(F.size(hits) > 0, F.struct(best["kind"].alias("kind"), best["scale"].alias("scale"))).otherwise(unit("vnd", 1.0))

    return F.when(folded.rlike(packs.YEAR_ANSWER), unit("year", 1.0)).when(folded.rlike(packs.COUNT_ANSWER), unit("count", 1.0)).otherwise(let(found, choose))


def time_point(folded: Column) -> Column:
    """begin if named at all, else whichever of end and period comes first."""
    end, period = found_at(folded, packs.TIME_POINTS["end"]), found_at(folded, packs.TIME_POINTS["period"])
    return F.when(folded.rlike(packs.TIME_POINTS["begin"]), "begin").when(end.isNotNull() & (period.isNull() | (end <= period)), "end").when(period.isNotNull(), "period")


def scope(folded: Column) -> Column:
    return F.when(folded.rlike(packs.SCOPES["separate"]), "separate").when(folded.rlike(packs.SCOPES["consolidated"]), "consolidated")


def operations(folded: Column) -> Column:
    return F.array_compact(F.array(*(F.when(folded.rlike(p), F.lit(name)) for name, p in packs.OPERATIONS.items())))


def tier(ops: Column, tickers: Column, yrs: Column) -> Column:
    has = lambda *x: F.arrays_overlap(ops, F.array(*map(F.lit, x)))
    n = F.size(F.array_remove(ops, "AGGREGATE"))
    return (
        F.when(has("CONDITIONAL", "MEDIAN") | (n >= 3), 4)
        .when((n >= 2) | (F.size(tickers) >= 3) | has("SUPERLATIVE"), 3)
        .when((n == 1) | (F.size(tickers) >= 2) | (F.size(yrs) >= 2), 2)
        .otherwise(1)
    )


def _any_word(words: Column) -> Column:
    """A pattern for any of the words, taken literally; one that nothing matches without words."""
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"\b("), F.array_join(quoted, "|"), F.lit(r")\b"))).otherwise(F.lit(r"(?!)"))


def retrieval_query(folded: Column, tickers: Column, own_words: Column) -> Column:
    """The metric's words: the question without tickers, names, templates, units and years."""
    s = F.regexp_replace(folded, _any_word(tickers), F.lit(" "))
    s = F.regexp_replace(s, _any_word(own_words), F.lit(" "))
    return collapse(F.regexp_replace(s, packs.QUERY_NOISE, " "))


def parse(questions: DataFrame, companies: DataFrame, alias: DataFrame | None = None, bounds: tuple[int, int] = packs.YEAR_BOUNDS) -> DataFrame:
    """The IR of each question of (id, question)."""
    q = questions.select(F.col("id").alias("qid"), "question")
    alias = names.aliases(q.sparkSession) if alias is None else alias
    found = names.resolve(q, companies, alias)
    words = found.select("qid", F.explode("tickers").alias("ticker")).join(F.broadcast(names.name_words(companies, alias)), "ticker").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("own_words"))
    none = F.array().cast("array<string>")
    q = q.join(found, "qid", "left").join(words, "qid", "left").withColumns({"tickers": F.coalesce("tickers", none), "own_words": F.coalesce("own_words", none), "fq": fold(F.col("question"))})
    fq = F.col("fq")
    q = q.withColumns({"years": years(fq, bounds), "year_span": year_span(fq), "stmt_type": scope(fq), "unit": answer_unit(fq), "time_point": time_point(fq), "ops": operations(fq), "retrieval_query": retrieval_query(fq, F.col("tickers"), F.col("own_words"))})
    return q.select("qid", "question", "tickers", "years", "year_span", "stmt_type", F.col("stmt_type").isNotNull().alias("stmt_explicit"), F.col("unit.kind").alias("unit_kind"), F.col("unit.scale").alias("unit_scale"), "time_point", "ops", tier(F.col("ops"), F.col("tickers"), F.col("years")).alias("tier"), "retrieval_query")


def too_complex(ir_question: Column, ops: Column, max_metrics: int = 1) -> Column:
    """Whether closed formulas leave a question alone: nested clauses, conditions, medians, counts, or more metrics than allowed."""

    def rules(fq: Column) -> Column:
        n = sum((matches(fq, p).cast("int") for p in packs.METRIC_HEADS), F.lit(0))
        return fq.rlike(packs.NESTED) | F.arrays_overlap(ops, F.array(F.lit("CONDITIONAL"), F.lit("MEDIAN"), F.lit("COUNT"))) | (n > max_metrics)

    return let(fold(ir_question), rules)


def named_ratio(retrieval: Column, question: Column) -> Column:
    """struct(numerator, denominator, percent) of the one named ratio that matches; null for none or several."""

    def only(s: Column) -> Column:
        found = F.array_compact(F.array(*(F.when(s.rlike(p), F.struct(F.lit(a).alias("numerator"), F.lit(b).alias("denominator"), F.lit(pct).alias("percent"))) for p, a, b, pct in packs.RATIOS)))
        return let(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))))

    return let(fold(F.concat(retrieval, F.lit(" "), question)), only)


def ratio_sides(retrieval: Column) -> Column:
    """struct(numerator, denominator) of "A over B" or "A times B", each of two words or more; null otherwise."""

    def clean(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), packs.RATIO_LEAD, ""), packs.RATIO_TAIL, ""))

    def sides(pattern: str) -> Column:
        return F.struct(clean(F.regexp_extract(retrieval, pattern, 1)).alias("numerator"), clean(F.regexp_extract(retrieval, pattern, 2)).alias("denominator"))

    two = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 2
    either = F.when(retrieval.rlike(packs.RATIO_OVER), sides(packs.RATIO_OVER)).when(retrieval.rlike(packs.RATIO_TIMES), sides(packs.RATIO_TIMES))
    return let(either, lambda s: F.when(two(s["numerator"]) & two(s["denominator"]), s))
