"""Ranking tables for questions: BM25 and structural signals, rank fusion, coverage of documents, cached rerankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.numbers import adaptive_k
from tablemill.functions.text import fold, phrase_score, section_hints, tokens_of_folded
from tablemill.session import store

from . import blockmax, bm25

#: Weights of the signals beside BM25, and the constant of rank fusion.
WEIGHTS = {"period": 2.5, "phrase": 3.0, "cover": 2.0, "section": 1.0, "data": 0.5}
RRF_K = 60
#: Candidates above which the cheap score alone chooses, and how many it leaves.
PREFILTER_ABOVE, PREFILTER_TO = 3000, 2000


def rank_from(order: list[Column], *keys: str) -> Column:
    """Rank from 0 within the keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def top_k(df: DataFrame, k: int | Column, order: list[Column], *keys: str) -> DataFrame:
    """The first k rows of each key; k may differ by row. A constant k lets Spark cut groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def prefilter(scored: DataFrame, above: int = PREFILTER_ABOVE, to: int = PREFILTER_TO) -> DataFrame:
    """Of questions with many candidates only the best by BM25 (to nine digits, then by id) go on to the costly signals."""
    many = scored.groupBy("qid").agg(F.count("*").alias("_all")).where(F.col("_all") > above).select("qid")
    best = top_k(scored.join(many, "qid", "left_semi"), to, [F.desc(F.round("bm25", 9)), F.col("id")], "qid")
    return scored.join(many, "qid", "left_anti").unionByName(best)


def base_scores(ir: DataFrame, meta: DataFrame, index: bm25.Index, docs: DataFrame, blocks: blockmax.BlockIndex | None = None, above: int = PREFILTER_ABOVE, to: int = PREFILTER_TO) -> DataFrame:
    """(qid, id, bm25) of each question's candidates: the tables of its documents (qid, doc_id), all tables for questions without one; pre-filtered.

    No question is joined with all of its tables: one pass over the index keeps the best of each question, or, for questions without documents and with `blocks`
    at hand, bounds of blocks find them (blockmax.search). Where fewer have a term, the tables of least id fill up. With `above` tables or fewer, all are listed.
    """
    queries = ir.select("qid", F.col("retrieval_query").alias("query"))
    some = store(docs.select("qid", "doc_id").distinct(), "named")
    order, both = [F.desc(F.round("bm25", 9)), F.col("id")], F.coalesce("bm25", F.lit(0.0))
    # of a question's documents: one table more than it may keep shows whether there are too many
    most = max(above + 1, to)
    ours = meta.select("doc_id", "id").join(some.select("doc_id").distinct(), "doc_id", "left_semi")
    listed = some.join(top_k(ours, most, [F.col("id")], "doc_id"), "doc_id").select("qid", "id")
    found = bm25.best(index, queries.join(some, "qid", "left_semi"), most, keys=(ours.select("id", F.col("doc_id").alias("key")), some.select("qid", F.col("doc_id").alias("key"))))
    named = store(top_k(listed.join(found, ["qid", "id"], "full").withColumn("bm25", both), most, order, "qid"), "named")
    free = queries.join(some, "qid", "left_anti")
    ids = [r[0] for r in meta.select("id").orderBy("id").limit(above + 1).collect()]
    all_of_them = len(ids) <= above
    filler = F.array(*map(F.lit, ids if all_of_them else ids[:to])) if ids else F.array().cast("array<long>")
    found = bm25.score(index, free) if all_of_them else blockmax.search(blocks, free, to)[0] if blocks else bm25.best(index, free, to)
    rest = free.select("qid", F.explode(filler).alias("id")).join(found, ["qid", "id"], "full").withColumn("bm25", both)
    rest = rest if all_of_them else top_k(rest, to, order, "qid")
    return prefilter(named, above, to).unionByName(rest)


def normalised(scored: DataFrame) -> DataFrame:
    """BM25 divided by the question's best, if that is above 0."""
    best = F.max("bm25").over(Window.partitionBy("qid"))
    return scored.withColumn("bm25", F.when(best > 0, F.col("bm25") / best).otherwise(F.col("bm25")))


def cover(query_weights: Column, folded_passage: Column) -> Column:
    """Share of the weight of query terms (array of struct(term, idf)) that stand anywhere in the passage, inside words too."""
    total = F.aggregate(query_weights, F.lit(0.0), lambda a, x: a + x["idf"])
    hit = F.aggregate(query_weights, F.lit(0.0), lambda a, x: a + F.when(F.contains(folded_passage, x["term"]), x["idf"]).otherwise(0.0))
    return hit / F.when(total == 0, 1.0).otherwise(total)


def signals(ir: DataFrame, meta: DataFrame, index: bm25.Index, pairs: DataFrame) -> DataFrame:
    """Rows (qid, id, bm25, cover, phrase, period, sec_hit, data, score) of the pairs (qid, id).

    meta: (id, doc_id, passage, section, n_numeric_cells, period_years array<int>). Pairs without a term score 0 in BM25.
    """
    queries = ir.select("qid", F.col("retrieval_query").alias("query"))
    base = pairs.join(bm25.score(index, queries, pairs), ["qid", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return signals_of(ir, meta, index, prefilter(base))


def signals_of(ir: DataFrame, meta: DataFrame, index: bm25.Index, base: DataFrame) -> DataFrame:
    """The same for candidates whose BM25 is known: base (qid, id, bm25)."""
    weights = bm25.query_weights(index, ir.select("qid", F.col("retrieval_query").alias("query")))
    base = normalised(store(base, "base"))
    q = ir.select("qid", "years", fold(F.col("retrieval_query")).alias("fq")).join(weights, "qid", "left")
    q = store(q.withColumns({"weights": F.coalesce("weights", F.array().cast("array<struct<term:string,idf:double>>")), "hints": section_hints(F.col("fq")), "qt": tokens_of_folded(F.col("fq"))}), "questions")
    m = meta.select("id", "doc_id", "passage", "section", "n_numeric_cells", "period_years")
    rows = base.join(m, "id").withColumn("fp", fold(F.col("passage"))).drop("passage").join(q, "qid")  # only candidates' passages are folded
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rows = rows.withColumns({
        "cover": cover(F.col("weights"), F.col("fp")), "phrase": phrase_score(F.col("qt"), F.col("fp")),
        "period": one(F.arrays_overlap("period_years", "years")), "sec_hit": one(F.array_contains("hints", F.col("section"))), "data": one(F.col("n_numeric_cells") >= 4),
    })
    w = WEIGHTS
    score = F.col("bm25") + w["period"] * F.col("period") + w["phrase"] * F.col("phrase") + w["cover"] * F.col("cover") + w["section"] * F.col("sec_hit") + w["data"] * F.col("data")
    return rows.select("qid", "id", "doc_id", "bm25", "cover", "phrase", "period", "sec_hit", "data", score.alias("score"))


def fuse(ranks: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rows (qid, id, rank from 0, weight): one aggregation over the union of the lists."""
    return ranks.groupBy("qid", "id").agg(F.sum(F.col("weight") / (k + F.col("rank") + 1)).alias("rrf"))


def hybrid(lexical: DataFrame, reranked: DataFrame, weight: float) -> DataFrame:
    """Lexical rows with score replaced by fused ranks where a question has reranked rows (qid, id, rank) and the weight is above 0."""
    if weight <= 0:
        return lexical.withColumns({"rrf": F.lit(None).cast("double"), "fusion": F.lit("lex_only")})
    lex = lexical.withColumn("lex_rank", rank_from([F.desc("score"), F.col("id")], "qid"))
    both = reranked.join(lex.select("qid", "id"), ["qid", "id"], "left_semi")
    fused = fuse(lex.select("qid", "id", F.col("lex_rank").alias("rank"), F.lit(1.0).alias("weight")).unionByName(both.select("qid", "id", "rank", F.lit(float(weight)).alias("weight"))))
    asked = both.select("qid").distinct().withColumn("_ce", F.lit(True))
    out = lex.join(fused, ["qid", "id"]).join(asked, "qid", "left")
    return out.withColumns({"rrf": F.when(F.col("_ce"), F.col("rrf")), "fusion": F.when(F.col("_ce"), "rrf(lex,ce)").otherwise("lex_only"), "score": F.when(F.col("_ce"), F.col("rrf")).otherwise(F.col("score"))}).drop("_ce", "lex_rank")


def rerank_scores(pairs: DataFrame, model) -> DataFrame:
    """Scores of (qid, id, query, passage) by a model hook: a function of two pandas series, loaded once a worker."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        score = model()
        for query, passage in batches:
            yield pd.Series(score(query, passage), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pairs.withColumn("rerank_score", F.pandas_udf(run, "double")("query", "passage"))


def cover_documents(hits: DataFrame, k: int | Column) -> DataFrame:
    """k rows of each question from (qid, id, doc_id, score): the best of each document first, by score, then the rest by score."""
    order = [F.desc("score"), F.col("id")]
    first = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(*order)) == 1
    return top_k(hits.withColumn("_first", first), k, [F.desc("_first"), *order], "qid").drop("_first")


def extra_hits(reranked: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The n best reranked rows (qid, id, rank) of each question that are not chosen yet."""
    return top_k(reranked.join(chosen, ["qid", "id"], "left_anti"), n, [F.col("rank"), F.col("id")], "qid")


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Mean Jaccard similarity of two rankings' (qid, id, rank) first k."""
    sets = lambda df, name: df.where(F.col("rank") < k).groupBy("qid").agg(F.collect_set("id").alias(name))
    from tablemill.functions.numbers import jaccard

    return sets(a, "x").join(sets(b, "y"), "qid").agg(F.round(F.avg(jaccard(F.col("x"), F.col("y"))), 6).alias("jaccard"), F.count("*").alias("questions"))


def top_scores(reranked: DataFrame) -> DataFrame:
    """One row (questions, p10, median): exact quantiles, interpolated, of the first-ranked rows' rerank_score of (qid, id, rank, rerank_score)."""
    from .quality import quantiles

    first = store(reranked.where("rank = 0").select("qid", F.col("rerank_score").cast("double").alias("rerank_score")), "first")
    p10, median = quantiles(first, "rerank_score", [0.1, 0.5])
    return first.agg(F.countDistinct("qid").alias("questions")).select("questions", F.lit(p10).cast("double").alias("p10"), F.lit(median).cast("double").alias("median"))


def retrieve(
    ir: DataFrame, meta: DataFrame, index: bm25.Index, docs: DataFrame, k_max: int = 12, reranked: DataFrame | None = None, ce_weight: float = 0.0,
    blocks: blockmax.BlockIndex | None = None, above: int = PREFILTER_ABOVE, to: int = PREFILTER_TO, digits: int = 9,
) -> DataFrame:
    """Ranked tables of each question, as many as its companies, years and operations call for, documents covered first.

    ir: (qid, retrieval_query, tickers, years, ops); meta as for signals(); docs: (qid, doc_id). A question whose documents have no table gets none.
    Scores are compared to `digits` digits, ties by id.
    """
    rows = signals_of(ir, meta, index, base_scores(ir, meta, index, docs, blocks, above, to))
    rows = hybrid(rows, reranked, ce_weight) if reranked is not None else rows
    n = docs.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_docs"))
    k = ir.join(n, "qid", "left").select("qid", adaptive_k(F.col("tickers"), F.col("years"), F.col("ops"), k_max, F.coalesce("n_docs", F.lit(0))).alias("k"))
    return cover_documents(rows.withColumn("score", F.round("score", digits)).join(k, "qid"), F.col("k"))
