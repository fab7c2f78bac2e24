"""Which companies a question is about: tickers, aliases, and names as phrases with gaps.

Each question finds its companies by joins on words and by one pass of an automaton, never by a loop over questions or companies. Joins with the
company list have no hint: Spark broadcasts it where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import fold, tokens
from tablemill.session import store
from tablemill.sources import packs

from . import phrases


def name_index(companies: DataFrame) -> DataFrame:
    """(ticker, words, idf) of each company: its name's distinct words less those of any company, and their weights."""
    form = F.array(*map(F.lit, packs.FORM_WORDS))
    every = F.array_distinct(tokens(F.col("name")))
    own = F.array_except(every, form)
    per = companies.select("ticker", F.when(F.size(own) > 0, own).otherwise(every).alias("words"))
    total = per.agg(F.count("*").alias("n"))
    df = per.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("w", F.ln(1 + F.col("n") / F.col("df")).alias("idf"))  # one row
    weights = per.select("ticker", F.posexplode("words").alias("i", "w")).join(idf, "w").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("i", "idf"))).alias("x"))
    return per.join(weights, "ticker", "left").select("ticker", "words", F.coalesce(F.transform("x", lambda e: e["idf"]), F.array().cast("array<double>")).alias("idf"))


def aliases(spark, table: dict[str, str] = packs.ALIASES) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "phrase string, ticker string")


def explicit(question: Column, valid: Column) -> Column:
    """Tickers in capitals; words in lower case count only if two different ones are tickers."""
    upper = F.array_intersect(F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Z0-9]{2,3}\b"), F.lit(0)), valid)
    lower = F.transform(F.regexp_extract_all(question, F.lit(r"\b[a-z][a-z0-9]{2,3}\b"), F.lit(0)), F.upper)
    lower = F.array_intersect(lower, valid)
    return F.when(F.size(upper) > 0, upper).when(F.size(lower) >= 2, lower).otherwise(F.array().cast("array<string>"))


def by_name(questions: DataFrame, index: DataFrame, least: float = phrases.MIN_COVERAGE) -> DataFrame:
    """(qid, ticker, coverage) of names that are covered well and whose rarest word is met."""
    return phrases.names_met(questions, index, least)


def by_alias(questions: DataFrame, alias: DataFrame) -> DataFrame:
    """(qid, ticker): aliases (phrase, ticker) that the folded question contains."""
    found = phrases.contained(questions.select("qid", F.col("question").alias("text")), alias)
    return found.join(alias, "phrase").select("qid", "ticker").distinct()


def resolve(questions: DataFrame, companies: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(qid, tickers): all companies of each question in order of their first place in it.

    A company all of whose name's words are, with others, in the name of another that is met almost whole is part of that name, and left out.
    """
    spark = questions.sparkSession
    alias = aliases(spark) if alias is None else alias
    index = store(name_index(companies), "names")
    valid = companies.agg(F.sort_array(F.collect_set("ticker")).alias("valid"))  # one row, as long as the list of companies
    ex = questions.crossJoin(F.broadcast(valid)).select("qid", F.explode(explicit(F.col("question"), F.col("valid"))).alias("ticker"))
    nm = by_name(questions, index)
    found = ex.select("qid", "ticker").union(nm.select("qid", "ticker")).union(by_alias(questions, alias)).distinct()
    own = found.join(index.select("ticker", "words"), "ticker", "left")
    strong = nm.where("coverage >= 0.9").join(index.select("ticker", F.col("words").alias("larger")), "ticker").select("qid", F.col("ticker").alias("other"), "larger")
    part = (F.size(F.array_except("words", "larger")) == 0) & (F.size("larger") > F.size("words"))
    swallowed = own.join(strong, "qid").where((F.col("ticker") != F.col("other")) & part).select("qid", "ticker")
    stay = own.join(swallowed, ["qid", "ticker"], "left_anti")
    own_phrases = alias.groupBy("ticker").agg(F.collect_list("phrase").alias("phrases"))
    placed = stay.join(questions.select("qid", fold(F.col("question")).alias("fq")), "qid").join(own_phrases, "ticker", "left")
    own_at = F.call_function("instr", F.col("fq"), F.col("ticker"))
    parts = F.filter(F.transform(F.concat(F.coalesce("words", F.array().cast("array<string>")), F.coalesce("phrases", F.array().cast("array<string>"))), lambda w: F.call_function("instr", F.col("fq"), w)), lambda p: p > 0)
    first = F.when(own_at > 0, own_at).otherwise(F.coalesce(F.array_min(parts), F.length("fq") + 1))
    ranked = placed.select("qid", F.struct(first.alias("at"), "ticker").alias("x")).groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return ranked.select("qid", F.transform("xs", lambda x: x["ticker"]).alias("tickers"))


def name_words(companies: DataFrame, alias: DataFrame) -> DataFrame:
    """(ticker, words): words of a company's name and aliases that a metric's query leaves out; terms of accounting stay in it."""
    words = companies.select("ticker", F.explode(tokens(F.col("name"))).alias("w")).union(alias.select("ticker", F.explode(F.split("phrase", r"\s+")).alias("w")))
    keep = words.where((F.length("w") >= 2) & ~F.col("w").isin(packs.TERM_WORDS))
    return keep.groupBy("ticker").agg(F.sort_array(F.collect_set("w")).alias("words"))
