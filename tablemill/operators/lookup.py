"""Label and concept lookups over facts, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.periods import period_bonus
from tablemill.functions.text import column_unit_penalty, label_score, tokens

from .facts import MAIN_STATEMENTS
from .retrieve import top_k

#: Ties are broken by place, so that results do not depend on the order of rows.
PLACE = ["doc_id", "table_idx", "row_idx", "col_idx"]


def targets(ir: DataFrame) -> DataFrame:
    """(qid, ticker, year) of every company and year that a question names."""
    return ir.select("qid", F.explode("tickers").alias("ticker"), "years").select("qid", "ticker", F.explode("years").alias("year"))


def _statement_bonus(stmt_type: Column, scope: Column, other: float, without_scope: float | None) -> Column:
    miss = F.lit(other) if without_scope is None else F.when(scope.isNotNull(), other).otherwise(without_scope)
    return F.when(stmt_type == F.coalesce(scope, F.lit("consolidated")), 1.0).when(stmt_type == "other", 0.7).otherwise(miss)


def scored(ir: DataFrame, facts: DataFrame, wanted: DataFrame | None = None, least: float = 0.42, query: str = "retrieval_query") -> DataFrame:
    """Facts of each question's targets with label_score and score; labels below `least` are out.

    Each distinct label of a question is scored once and joined back.
    """
    wanted = targets(ir) if wanted is None else wanted
    q = ir.select("qid", F.col("stmt_type").alias("scope"), "time_point", "unit_kind", tokens(F.col(query)).alias("qt"))
    mine = wanted.withColumnRenamed("year", "period_year").join(facts, ["ticker", "period_year"])
    labels = mine.select("qid", "label_norm").distinct().join(q.select("qid", "qt"), "qid").where(F.size("qt") > 0)
    labels = labels.withColumn("label_score", label_score(F.col("qt"), F.col("label_norm"))).where(F.col("label_score") >= least).select("qid", "label_norm", "label_score")
    rows = mine.join(labels, ["qid", "label_norm"]).join(q.drop("qt"), "qid")
    kind = F.when(F.col("statement").isin(MAIN_STATEMENTS), 1.0).otherwise(0.55)
    period = period_bonus(F.col("is_begin"), F.col("period_type"), F.col("statement"), F.col("time_point"))
    total = F.col("label_score") + 0.35 * period + 0.30 * _statement_bonus(F.col("stmt_type"), F.col("scope"), 0.0, 0.35) + 0.12 * kind + column_unit_penalty(F.col("col_name"), F.col("unit_kind"))
    return rows.withColumn("score", F.round(total, 6)).drop("scope", "time_point", "unit_kind")


def _order() -> list[Column]:
    return [F.desc("score"), *map(F.col, PLACE)]


def lookup(ir: DataFrame, facts: DataFrame, top: int = 5, least: float = 0.42, query: str = "retrieval_query", wanted: DataFrame | None = None) -> DataFrame:
    """The best facts of each question over all its targets."""
    return top_k(scored(ir, facts, wanted, least, query), top, _order(), "qid")


def lookup_per_target(ir: DataFrame, facts: DataFrame, top: int = 3, least: float = 0.42) -> DataFrame:
    """The best facts of each company and year of a question."""
    return top_k(scored(ir, facts, None, least), top, _order(), "qid", "ticker", "period_year")


def vote(hits: DataFrame) -> DataFrame:
    """(qid, label, n, total): the label that most targets have among their hits, by total score among equals; none if targets differ and no label has two."""
    per = hits.groupBy("qid", "ticker", "period_year", "label").agg(F.max("score").alias("best"))
    agg = per.groupBy("qid", "label").agg(F.count("*").alias("n"), F.round(F.sum("best"), 6).alias("total"))
    n = hits.groupBy("qid").agg(F.countDistinct("ticker", "period_year").alias("targets"))
    first = top_k(agg, 1, [F.desc("n"), F.desc("total"), F.col("label")], "qid")
    return first.join(n, "qid").where("targets = 1 or n >= 2").drop("targets")


def lookup_aligned(ir: DataFrame, facts: DataFrame, top: int = 6) -> DataFrame:
    """One fact a target, all with the same label, so that values can be compared."""
    hits = lookup_per_target(ir, facts, top)
    same = hits.join(vote(hits).select("qid", "label"), ["qid", "label"])
    return top_k(same, 1, _order(), "qid", "ticker", "period_year")


def lookup_concept(ir: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The best fact of each wanted (qid, ticker, year, concept): by period, scope and statement."""
    q = ir.select("qid", F.col("stmt_type").alias("scope"), "time_point")
    mine = wanted.withColumnRenamed("year", "period_year").join(facts, ["ticker", "period_year", "concept"]).join(q, "qid")
    kind = F.when(F.col("statement").isin(MAIN_STATEMENTS), 1.0).otherwise(0.3)
    total = period_bonus(F.col("is_begin"), F.col("period_type"), F.col("statement"), F.col("time_point")) + 0.5 * _statement_bonus(F.col("stmt_type"), F.col("scope"), 0.2, None) + 0.6 * kind
    rows = mine.withColumns({"score": F.round(total, 6), "label_score": F.lit(1.0)}).drop("scope", "time_point")
    return top_k(rows, 1, _order(), "qid", "ticker", "period_year", "concept")
