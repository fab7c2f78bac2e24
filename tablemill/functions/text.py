"""Text functions as Column expressions: folding, tokens, labels, phrases."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.sources import packs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def _plain_letters() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one letter and marks, and those letters."""
    out = {"đ": "d", "Đ": "D"}
    for cp in range(0x80, 0x10000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(plain) == 1 and plain != c:
                out.setdefault(c, plain)
    return "".join(out), "".join(out.values())


def strip_diacritics(s: Column) -> Column:
    """Letters without marks; characters that decompose to several letters (Hangul) stay."""
    a, b = _plain_letters()
    return F.regexp_replace(F.translate(s, a, b), r"\p{Mn}", "")


def collapse(s: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fold(s: Column) -> Column:
    """Without marks, white space collapsed, in capitals; null becomes empty."""
    return F.coalesce(F.upper(collapse(strip_diacritics(s))), F.lit(""))


def tokens_of_folded(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[A-Z0-9]+"), F.lit(0))


def tokens(s: Column) -> Column:
    return tokens_of_folded(fold(s))


def norm_label(label: Column) -> Column:
    """Folded, without numbering (up to three levels), note reference and edge punctuation."""
    s = fold(label)
    for _ in range(3):
        s = F.regexp_replace(s, packs.LABEL_NUMBERING, "")
    return F.btrim(F.regexp_replace(s, packs.LABEL_NOTE, ""), F.lit(" .:-"))


def slug(s: Column, width: int = 48) -> Column:
    """Lower case, other characters as one underscore, none at the ends, cut to the width."""
    return F.left(F.btrim(F.regexp_replace(F.lower(fold(s)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(width))


def matches(s: Column, pattern: str) -> Column:
    """Whether the pattern is found; false for null."""
    return F.coalesce(s.rlike(pattern), F.lit(False))


def found_at(s: Column, pattern: str) -> Column:
    """Position of the first match from 1, null if there is none."""
    return F.when(s.rlike(pattern), F.length(F.regexp_extract(s, f"(?s)^(.*?)(?:{pattern})", 1)) + 1)


def first_matching(s: Column, rules: list[tuple[str, object]], default: Column | None = None) -> Column:
    """The value of the first rule (pattern, value) that is found."""
    out = None
    for pattern, value in rules:
        out = F.when(s.rlike(pattern), F.lit(value)) if out is None else out.when(s.rlike(pattern), F.lit(value))
    return out.otherwise(default) if default is not None else out


def longest_phrase(words: Column, text: Column, least: int, most: int) -> Column:
    """Words of the longest run of consecutive words, between the bounds, that the text contains; 0 if none does."""

    def from_word(i: Column) -> Column:
        lengths = F.sequence(F.lit(least), F.least(F.lit(most), F.size(words) - i))
        return F.array_max(F.transform(lengths, lambda n: F.when(F.contains(text, F.array_join(F.slice(words, i + 1, n), " ")), n).otherwise(0)))

    starts = F.sequence(F.lit(0), F.size(words) - least)  # counts down below zero, hence the guard
    return F.when(F.size(words) >= least, F.array_max(F.transform(starts, from_word))).otherwise(0)


def phrase_score(words: Column, folded_passage: Column) -> Column:
    return F.least(longest_phrase(words, folded_passage, 3, 9) / 6.0, F.lit(1.0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def token_weight(t: Column) -> Column:
    stop = F.array_contains(F.array(*map(F.lit, packs.LABEL_STOP)), t)
    return F.when(stop, 0.15).otherwise(F.least(F.lit(1.0), 0.35 + 0.12 * F.length(t)))


def contradicts(a: Column, b: Column) -> Column:
    """Whether one text names one side of an antonym and the other only the other side."""
    out = F.lit(False)
    for x, y in packs.ANTONYMS:
        out = out | (F.contains(a, F.lit(x)) & F.contains(b, F.lit(y)) & ~F.contains(b, F.lit(x))) | (F.contains(a, F.lit(y)) & F.contains(b, F.lit(x)) & ~F.contains(b, F.lit(y)))
    return out


def label_score(query_tokens: Column, label: Column) -> Column:
    """How well a row's label fits the tokens of a metric: coverage, brevity and the longest phrase; 0 on a contradiction."""

    def score(folded: Column) -> Column:
        distinct = F.array_distinct(query_tokens)
        own = F.array_distinct(tokens_of_folded(folded))
        total = _sum(F.transform(distinct, token_weight))
        hit = _sum(F.transform(F.filter(distinct, lambda t: F.array_contains(own, t)), token_weight))
        cover = hit / F.when(total == 0, 1.0).otherwise(total)
        brevity = F.size(F.array_intersect(own, distinct)) / F.greatest(F.size(own), F.lit(1))
        stop = F.array(*map(F.lit, packs.LABEL_STOP))
        phrase = longest_phrase(F.filter(query_tokens, lambda t: ~F.array_contains(stop, t)), folded, 2, 8) / 6.0
        value = 0.55 * cover + 0.15 * brevity + 0.30 * F.least(phrase, F.lit(1.0))
        return F.when((folded == "") | contradicts(F.array_join(query_tokens, " "), folded), 0.0).otherwise(value)

    return let(fold(label), score)


def is_expense(s: Column) -> Column:
    return matches(fold(s), packs.EXPENSE)


def section_hints(folded_query: Column) -> Column:
    """Sections that a query's words point to."""
    hit = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(folded_query, w)), F.lit(section)) for section, words in packs.SECTION_HINTS.items()]
    return F.array_compact(F.array(*hit))


def column_unit_penalty(column: Column, unit_kind: Column) -> Column:
    """What a column's name adds for the unit that is asked for."""

    def penalty(f: Column) -> Column:
        shares, percent = f.rlike(packs.COLUMN_SHARES), f.rlike(packs.COLUMN_PERCENT)
        money = F.when(shares, -0.45).when(percent, -0.35).otherwise(0.0)
        return (
            F.when(f.rlike(packs.COLUMN_NOTE), -0.5)
            .when(unit_kind.isin("vnd", "usd"), money)
            .when(unit_kind == "shares", F.when(shares, 0.25).otherwise(-0.25))
            .when(unit_kind.isin("percent", "pp"), F.when(percent, 0.2).otherwise(0.0))
            .otherwise(0.0)
        )

    return let(fold(F.translate(column, "_", " ")), penalty)
