"""Aliases by automaton and names by positional lists, against plain loops."""

from __future__ import annotations

import random

import pytest

from tablemill.operators import companies, phrases


@pytest.mark.parametrize("limit", [20_000_000, 12])
def test_contained(spark, monkeypatch, limit):
    """Any number of automata; overlapping, nested, repeated and empty phrases; null, empty and long texts."""
    monkeypatch.setattr(phrases, "AUTOMATON_CHARS", limit)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("AB ") for _ in range(rnd.randint(1, 5))).strip() for _ in range(40)] + ["ABC", "BC", "BC", "C D", "", "KHONG CO"]
    texts = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 50_000 + "c  d"), (103, "không có"), (104, "abc"), (104, "ab")]
    got = phrases.contained(spark.createDataFrame(texts, "qid long, text string").repartition(3), spark.createDataFrame([(w,) for w in words], "phrase string"))
    folded = lambda t: " ".join((t or "").upper().split()).replace("KHÔNG CÓ", "KHONG CO")
    assert sorted(map(tuple, got.collect())) == sorted({(q, w) for q, t in texts for w in words if w and w in folded(t)})


def test_contained_empty(spark):
    texts = spark.createDataFrame([(1, "a")], "qid long, text string")
    none = spark.createDataFrame([], "phrase string")
    assert phrases.contained(texts, none).count() == 0
    assert phrases.contained(texts.limit(0), spark.createDataFrame([("A",)], "phrase string")).count() == 0


def plain_coverage(text, words, idf):
    """Every start, every place after it: the walk as it is defined."""
    places = [(p, k) for p, w in enumerate(text) for k, x in enumerate(words, 1) if x == w]
    best, got = 0.0, []
    for i, (p, k) in enumerate(places):
        own, last, number, over = [k], p, k, False
        for q, m in places[i + 1 :]:
            over = over or q - last > phrases.MAX_GAP
            if not over and q > last and m > number:
                own.append(m)
                last, number = q, m
        weight = sum(idf[m - 1] for m in own)
        if weight > best or not got:
            best, got = weight, own
    return best / sum(idf), got


def test_names_met(spark):
    rnd = random.Random(8)
    pool = [f"W{i}" for i in range(9)]
    names = [(f"T{i}", " ".join(rnd.sample(pool, rnd.randint(1, 4)))) for i in range(25)] + [("T90", "W1 W1 W2"), ("T91", ""), ("T92", None), ("T93", "CTCP")]
    texts = [(i, " ".join(rnd.choice([*pool, "x", "y", "z"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "W1 " * 300 + "W2")]
    index = companies.name_index(spark.createDataFrame(names, "ticker string, name string"))
    got = {(r["qid"], r["ticker"]): r["coverage"] for r in companies.by_name(spark.createDataFrame(texts, "qid long, question string").repartition(3), index).collect()}
    want = {}
    for ticker, words, idf in index.collect():
        for q, t in texts:
            if not words:
                continue
            cover, met = plain_coverage((t or "").upper().split(), words, idf)
            if cover >= phrases.MIN_COVERAGE and idf.index(max(idf)) + 1 in met:
                want[q, ticker] = round(cover, 3)
    assert got.keys() == want.keys() and got == pytest.approx(want)


def test_names_of_many_places():
    """A walk stops at the first gap, so many places take time in proportion."""
    places = [(5 * i, 1) for i in range(200_000)]
    assert phrases.best_walk(places, [1.0, 1.0]) == (1.0, [1])
    assert phrases.best_walk([], [1.0]) == (0.0, [])
    assert phrases.best_walk([(0, 1), (1, 1), (3, 2), (9, 3)], [1.0, 2.0, 4.0]) == (4.0, [3])
