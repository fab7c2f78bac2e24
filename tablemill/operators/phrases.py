"""Phrases in texts: an Aho-Corasick automaton for whole phrases, and positional lists for names as phrases with gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import fold, tokens

#: Characters of the phrases of one automaton; more phrases are spread over several, each a pass of its own.
AUTOMATON_CHARS = 20_000_000
#: Words between two accepted words of a name at most, and the share of a name's weight that must be met.
MAX_GAP, MIN_COVERAGE = 3, 0.75


def contained(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, phrase) of the distinct phrases (phrase) that each folded text (qid, text) contains, inside words too. An empty phrase is in none.

    One pass over each text, whatever the number of phrases: their automaton is built once and broadcast. Phrases over AUTOMATON_CHARS are dealt into
    parts by their hash, so no broadcast is larger. A text is one row: those with one qid are searched each.
    """
    spark = texts.sparkSession
    distinct = phrases.select("phrase").where("phrase <> ''").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]
    parts = max(1, -(-size // AUTOMATON_CHARS))
    folded = texts.select(F.col("qid").cast("long").alias("qid"), fold(F.col("text")).alias("text"))
    out = None
    for part in range(parts):
        own = distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part) if parts > 1 else distinct
        words = [r[0] for r in own.collect()]  # AUTOMATON_CHARS characters or so
        found = folded.mapInArrow(_matcher(spark, words), "qid long, phrase string")
        out = found if out is None else out.unionAll(found)
    return out.distinct()


def _matcher(spark, words: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    if words:
        automaton.make_automaton()
    shared = spark.sparkContext.broadcast(automaton if words else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for b in batches:
            qid, phrase = [], []
            for q, text in zip(b.column(0).to_pylist(), b.column(1)):
                hits = {w for _, w in search.iter(text.as_py())} if search is not None else ()
                qid += [q] * len(hits)
                phrase += hits
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(phrase, pa.string())], ["qid", "phrase"])

    return run


def best_walk(places: list[tuple[int, int]], weights: list[float]) -> tuple[float, list[int]]:
    """The most weight that words in order reach from any start, and their numbers; places: (position, number of the word in the name), sorted.

    From a start the next place within MAX_GAP whose word comes later in the name is taken, again and again; of equal walks the first counts.
    """
    best, got = 0.0, []
    for i, (p, k) in enumerate(places):
        own, weight = [k], weights[k - 1]
        for q, m in places[i + 1 :] if len(places) < 64 else _from(places, i + 1):
            if q - p > MAX_GAP:
                break
            if q > p and m > k:
                p, k = q, m
                own.append(m)
                weight += weights[m - 1]
        if weight > best or not got:
            best, got = weight, own
    return best, got


def _from(places: list, start: int) -> Iterator:
    """The places from `start` on, without a copy."""
    for j in range(start, len(places)):
        yield places[j]


def names_met(texts: DataFrame, index: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """(qid, ticker, coverage) of names (ticker, words, idf) that texts (qid, question) cover well, their rarest word among the words met.

    Positional lists, rarest word first: a name can only be met where its rarest word is, so only those lists give candidates; then the name's other
    words are looked up in the candidate texts, pairs whose words together weigh too little go, and positions are merged for the rest. All are joins on
    words and texts: no list of names or texts is broadcast, whatever its length. Rows with one qid are one text each only if their qid differs.
    """
    rarest = F.array_position(F.col("idf"), F.array_max("idf")).cast("int")
    names = index.where(F.size("words") > 0).select("ticker", "idf", F.aggregate("idf", F.lit(0.0), lambda a, x: a + x).alias("total"), rarest.alias("rarest"), F.get(F.col("words"), rarest - 1).alias("key"), "words")
    each = names.select("ticker", F.posexplode("words").alias("i", "w")).select("ticker", (F.col("i") + 1).alias("k"), "w")
    positions = texts.select("qid", F.posexplode(tokens(F.col("question"))).alias("p", "w")).join(each.select("w").distinct(), "w", "left_semi")
    lists = positions.groupBy("w", "qid").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    met = lists.join(names.select("ticker", F.col("key").alias("w")), "w").select("qid", "ticker")
    wanted = met.join(each, "ticker").join(lists, ["qid", "w"])
    places = wanted.groupBy("qid", "ticker").agg(F.collect_list(F.struct("k", "ps")).alias("ls")).join(names.select("ticker", "idf", "total", "rarest"), "ticker")
    held = F.aggregate("ls", F.lit(0.0), lambda a, x: a + F.get(F.col("idf"), x["k"] - 1))
    heavy = places.where(held >= least * F.col("total") * (1 - 1e-9)).select("qid", "ticker", "ls", "idf", "total", "rarest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for qid, ticker, ls, idf, total, rare in zip(*(c.to_pylist() for c in b.columns)):
                weight, got = best_walk(sorted((p, x["k"]) for x in ls for p in x["ps"]), idf)
                coverage = weight / total if total > 0 else weight
                if coverage >= least and rare in got:
                    out.append((qid, ticker, coverage))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64()))], ["qid", "ticker", "coverage"])

    return heavy.select(F.col("qid").cast("long").alias("qid"), "ticker", "ls", "idf", "total", "rarest").mapInArrow(run, "qid long, ticker string, coverage double").withColumn("coverage", F.round("coverage", 3))
