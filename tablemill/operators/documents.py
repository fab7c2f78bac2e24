"""Metadata pruning: from a question's companies, years and scope to its candidate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.sources import packs


def needed_years(years: Column, ops: Column) -> Column:
    """The years, and the year before each for growth and averages."""
    more = F.when(F.arrays_overlap(ops, F.array(F.lit("GROWTH"), F.lit("AVERAGE"))), F.transform(years, lambda y: y - 1)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_union(years, more))


def type_priority(stmt_type: Column, scope: Column) -> Column:
    """A statement type's place in the order of a scope, from 0; null for types that no order names."""
    place = lambda order: F.array_position(F.array(*map(F.lit, order)), stmt_type)
    at = F.when(scope == "separate", place(packs.TYPE_PRIORITY["separate"])).otherwise(place(packs.TYPE_PRIORITY["consolidated"]))
    return F.when(at > 0, at - 1)


def nearest_years(wanted: DataFrame, available: DataFrame, n: int = 2) -> DataFrame:
    """For (ticker, year) rows the n nearest available years of the ticker; of equally near ones the later first. Adds near_year."""
    both = wanted.join(available.select("ticker", F.col("year").alias("near_year")).distinct(), "ticker")
    order = Window.partitionBy(*wanted.columns).orderBy(F.abs(F.col("near_year") - F.col("year")), F.desc("near_year"))
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def filter_documents(ir: DataFrame, docs: DataFrame, most: int | None = 40) -> DataFrame:
    """(qid, doc_id, place): candidate documents in order of ticker, year and name, `most` at most (all if None).

    A company and year take the best type that exists there, and documents of no type; companies without any type take all
    of the year. Without documents of the year the two nearest years stand in. Without years in the question all years count.
    """
    docs = docs.select("doc_id", "ticker", "year", "stmt_type")
    typeless = docs.groupBy("ticker").agg(F.bool_and(F.col("stmt_type") == "other").alias("typeless"), F.sort_array(F.collect_set("year")).alias("all_years"))
    ask = ir.select("qid", "stmt_type", needed_years(F.col("years"), F.col("ops")).alias("needed"), F.posexplode("tickers").alias("t", "ticker"))
    ask = ask.join(typeless, "ticker").withColumn("needed", F.when(F.size("needed") > 0, F.col("needed")).otherwise(F.col("all_years")))
    ask = ask.select("qid", F.col("stmt_type").alias("scope"), "t", "ticker", "typeless", F.posexplode("needed").alias("y", "year"))
    have = docs.where("year is not null").select("ticker", "year").distinct()
    there = ask.join(have, ["ticker", "year"], "left_semi").withColumns({"use": F.col("year"), "k": F.lit(0)})
    gone = ask.join(have, ["ticker", "year"], "left_anti")
    near = nearest_years(gone, have).withColumn("use", F.col("near_year"))
    nth = Window.partitionBy("qid", "t", "y").orderBy(F.abs(F.col("use") - F.col("year")), F.desc("use"))
    near = near.withColumn("k", F.row_number().over(nth)).drop("near_year")
    want = there.unionByName(near)
    both = want.join(docs.select("ticker", F.col("year").alias("use"), "doc_id", F.col("stmt_type").alias("kind")), ["ticker", "use"])
    both = both.withColumn("rank", type_priority(F.col("kind"), F.col("scope")))
    best = F.min("rank").over(Window.partitionBy("qid", "t", "y", "use"))
    both = both.withColumn("best", best).where("typeless or best is null or rank = best or kind = 'other'")
    first = both.groupBy("qid", "doc_id").agg(F.min(F.struct("t", "y", "k", "doc_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    placed = first.withColumn("place", place)
    return (placed if most is None else placed.where(F.col("place") <= most)).select("qid", "doc_id", "place")
