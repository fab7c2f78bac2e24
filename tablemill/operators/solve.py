"""Closed formulas: ratios, growth, differences, sums, averages, extremes and the year of an extreme.

Every question is tried by every formula as a set operation over aligned facts; a priority chooses among those that apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.numbers import finite
from tablemill.functions.text import fold, is_expense, matches
from tablemill.sources import packs

from .lookup import PLACE, lookup, lookup_aligned, lookup_concept
from .questions import named_ratio, ratio_sides, too_complex
from .retrieve import top_k

_RATIO_UNITS = ["percent", "pp", "times"]
_NON_MONEY = ["percent", "pp", "times", "year", "count", "shares", "usd"]
EVIDENCE = "array<struct<doc_id:string,table_idx:int,row_idx:int,col_idx:int,label:string,label_col:string,col_name:string,value_raw:double,unit_scale:double>>"


def evidence(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("doc_id", "table_idx", "row_idx", "col_idx", "label", "label_col", "col_name", "value_raw", "unit_scale")))


def in_unit(value: Column, unit_kind: Column, unit_scale: Column) -> Column:
    """Money in the unit that is asked for; other kinds stay."""
    return F.when(unit_kind.isin(_NON_MONEY), value).otherwise(value / unit_scale)


def hundredfold(unit_kind: Column, percent: Column | bool = True) -> Column:
    return F.when((F.lit(percent) if isinstance(percent, bool) else percent) & unit_kind.isin("percent", "pp"), 100.0).otherwise(1.0)


def _ratio(df: DataFrame, percent: Column | bool) -> DataFrame:
    """num_* and den_* columns to a ratio: expenses count by size in the numerator, everything does in the denominator."""
    n, d = F.col("num_value_raw") * F.col("num_unit_scale"), F.abs(F.col("den_value_raw") * F.col("den_unit_scale"))
    n = F.when(is_expense(F.col("num_label")), F.abs(n)).otherwise(n)
    df = df.withColumns({"_n": n, "_d": d}).where("_d <> 0")
    return df.withColumn("value", F.col("_n") / F.col("_d") * hundredfold(F.col("unit_kind"), percent))


def _side(facts: DataFrame, prefix: str, *keys: str) -> DataFrame:
    cols = ("doc_id", "table_idx", "row_idx", "col_idx", "label", "label_col", "col_name", "value_raw", "unit_scale")
    return facts.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in cols))


def solve_named_ratio(ir: DataFrame, facts: DataFrame) -> DataFrame:
    """Ratios with a name, from concepts: the first company, the last year."""
    q = ir.withColumn("f", named_ratio(F.col("retrieval_query"), F.col("question"))).where("f is not null and size(tickers) > 0 and size(years) > 0")
    q = q.select("qid", "stmt_type", "time_point", "unit_kind", F.get("tickers", F.lit(0)).alias("ticker"), F.element_at("years", -1).alias("year"), "f.*")
    side = lambda c, p: _side(lookup_concept(ir, facts, q.select("qid", "ticker", "year", F.col(c).alias("concept"))), p, "qid")
    both = q.select("qid", "unit_kind", "percent").join(side("numerator", "num_"), "qid").join(side("denominator", "den_"), "qid")
    return _ratio(both, F.col("percent")).select("qid", F.lit("RATIO").alias("kind"), "value", F.array(evidence("num_"), evidence("den_")).alias("facts"))


def solve_ratio_of_labels(ir: DataFrame, facts: DataFrame) -> DataFrame:
    """"A over B": each side looked up by its words; not if both are one cell or one value."""
    q = ir.withColumn("s", ratio_sides(F.col("retrieval_query"))).where("s is not null and size(tickers) > 0 and size(years) > 0")
    want = q.select("qid", F.get("tickers", F.lit(0)).alias("ticker"), F.element_at("years", -1).alias("year"))
    side = lambda c, p: _side(lookup(q.withColumn("_q", F.col(f"s.{c}")), facts, 1, 0.5, "_q", want), p, "qid")
    both = q.select("qid", "unit_kind").join(side("numerator", "num_"), "qid").join(side("denominator", "den_"), "qid")
    same = (F.col("num_doc_id") == F.col("den_doc_id")) & (F.col("num_table_idx") == F.col("den_table_idx")) & (F.col("num_row_idx") == F.col("den_row_idx")) & (F.col("num_col_idx") == F.col("den_col_idx"))
    return _ratio(both.where(~same), True).where("_n <> _d").select("qid", F.lit("RATIO_AB").alias("kind"), "value", F.array(evidence("num_"), evidence("den_")).alias("facts"))


def aligned_values(ir: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, items): of each question its targets' aligned facts as (ticker, year, at, v, f), by ticker and year. A question's targets are few."""
    q = ir.select("qid", "tickers")
    a = lookup_aligned(ir, facts).join(q, "qid").withColumns({"v": F.col("value_raw") * F.col("unit_scale"), "at": F.array_position("tickers", F.col("ticker")).cast("int")})
    item = F.struct("ticker", F.col("period_year").alias("year"), F.col("at"), F.col("v"), evidence().alias("f"))
    return a.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _values(items: Column) -> Column:
    return F.transform(items, lambda x: x["v"])


def _facts(items: Column) -> Column:
    return F.transform(items, lambda x: x["f"])


def growth(items: Column, unit_kind: Column) -> Column:
    """(last - first) / |first| of one company's first and last year."""
    first, last = F.get(items, F.lit(0))["v"], F.element_at(items, -1)["v"]
    return F.when(first != 0, (last - first) / F.abs(first) * hundredfold(unit_kind))


def solve_targets(ir: DataFrame, facts: DataFrame) -> DataFrame:
    """Formulas over two targets or more: (qid, kind, value, facts)."""
    rows = ir.join(aligned_values(ir, facts), "qid").where(F.size("items") >= 2).withColumn("fq", fold(F.col("question")))
    it, ops, kind = F.col("items"), F.col("ops"), F.col("unit_kind")
    has = lambda op: F.array_contains(ops, op)
    money = ~kind.isin(_NON_MONEY)
    ends = F.filter(it, lambda x: (x["year"] == F.array_min("years")) | (x["year"] == F.array_max("years")))
    one = (F.size("tickers") == 1) & (F.size("years") >= 2) & (F.size(ends) == 2)
    by_place = F.array_sort(it, lambda x, y: F.when(x["at"] != y["at"], x["at"] - y["at"]).otherwise(y["year"] - x["year"]))
    by_year = F.array_sort(it, lambda x, y: F.when(x["year"] != y["year"], y["year"] - x["year"]).otherwise(x["at"] - y["at"]))
    pair = F.when(F.size("tickers") == 2, by_place).otherwise(by_year)
    gap = F.get(pair, F.lit(0))["v"] - F.get(pair, F.lit(1))["v"]
    undirected = matches(F.col("fq"), packs.UNDIRECTED_DIFF) & ~matches(F.col("fq"), packs.DIRECTED_DIFF)
    least = matches(F.col("fq"), packs.LEAST_WORDS)
    values = _values(it)
    years = F.transform(it, lambda x: F.struct(x["v"].alias("v"), x["year"].alias("y")))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    out = lambda name, value, f: F.struct(F.lit(name).alias("kind"), value.alias("value"), f.alias("facts"))
    unit = lambda v: in_unit(v, kind, F.col("unit_scale"))
    year_of = F.when(least, F.array_min(years)).otherwise(F.array_max(years))["y"].cast("double")
    # growth in money is a difference: dividing a quotient by a unit of money would mean nothing
    rules = (
        F.when(kind == "year", F.when(F.size(F.array_distinct(F.transform(it, lambda x: x["year"]))) >= 2, out("ARGMAX_YEAR", year_of, _facts(it))))
        .when(has("GROWTH") & one & ~money & growth(ends, kind).isNotNull(), out("GROWTH", growth(ends, kind), _facts(ends)))
        .when((has("DIFF") | (has("GROWTH") & money)) & (F.size(it) == 2), out("DIFF", unit(F.when(undirected, F.abs(gap)).otherwise(gap)), _facts(pair)))
        .when(has("SUPERLATIVE") & least, out("MIN", unit(F.array_min(values)), _facts(it)))
        .when(has("SUPERLATIVE"), out("MAX", unit(F.array_max(values)), _facts(it)))
        .when(has("AVERAGE"), out("AVG", unit(total / F.size(it)), _facts(it)))
        .when(has("AGGREGATE"), out("SUM", unit(total), _facts(it)))
    )
    return rows.select("qid", rules.alias("r")).where("r is not null").select("qid", "r.*")


def solve(ir: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, kind, value, facts) of the questions that a closed formula answers: named ratios, then ratios of labels, then targets."""
    ir = ir.withColumns({"_hard1": too_complex(F.col("question"), F.col("ops"), 1), "_hard4": too_complex(F.col("question"), F.col("ops"), 4)})
    ratio = ir.where(F.col("unit_kind").isin(_RATIO_UNITS) & ~F.col("_hard4"))
    found = solve_named_ratio(ratio, facts).withColumn("p", F.lit(0))
    found = found.unionByName(solve_ratio_of_labels(ratio, facts).withColumn("p", F.lit(1)))
    found = found.unionByName(solve_targets(ir.where(~F.col("_hard1")), facts).withColumn("p", F.lit(2)))
    return top_k(found.withColumn("value", finite(F.col("value"))).where("value is not null"), 1, [F.col("p")], "qid").drop("p")


def expense_magnitude(value: Column, retrieval_query: Column, ops: Column) -> Column:
    """Negative expenses by size, unless a difference or growth is asked for."""
    keep = F.arrays_overlap(ops, F.array(F.lit("DIFF"), F.lit("GROWTH")))
    return F.when((value < 0) & ~keep & is_expense(retrieval_query), F.abs(value)).otherwise(value)


def route(ir: DataFrame, solved: DataFrame, facts_best: DataFrame, located: DataFrame, least: float = 0.55) -> DataFrame:
    """(qid, route, answer, facts): the formula's answer, else the best fact with a good label, else the best cell, else 0."""
    unit = lambda v: in_unit(v, F.col("unit_kind"), F.col("unit_scale"))
    top = Window.partitionBy("qid").orderBy(F.desc("score"), *(F.col(c) for c in PLACE if c in facts_best.columns))  # ties by place
    fact = facts_best.withColumn("_n", F.row_number().over(top)).where("_n = 1").where(F.col("label_score") >= least)
    fact = fact.select("qid", (F.col("value_raw") * F.col("unit_scale")).alias("fact_value"), F.array(evidence()).alias("fact_facts"))
    cell = located.select("qid", (F.col("value") * F.coalesce(F.col("unit_scale"), F.lit(1.0))).alias("cell_value")) if "unit_scale" in located.columns else located.select("qid", F.col("value").alias("cell_value"))
    all_ = ir.join(solved.select("qid", F.col("value").alias("solved_value"), "kind", F.col("facts").alias("solved_facts")), "qid", "left").join(fact, "qid", "left").join(cell, "qid", "left")
    simple = lambda v: unit(expense_magnitude(v, F.col("retrieval_query"), F.col("ops")))
    return all_.select(
        "qid",
        F.when(F.col("solved_value").isNotNull(), F.concat(F.lit("solver:"), "kind")).when(F.col("fact_value").isNotNull(), "fact").when(F.col("cell_value").isNotNull(), "cell").otherwise("none").alias("route"),
        F.coalesce("solved_value", simple(F.col("fact_value")), simple(F.col("cell_value")), F.lit(0.0)).alias("answer"),
        F.coalesce("solved_facts", "fact_facts").alias("facts"),
    )
