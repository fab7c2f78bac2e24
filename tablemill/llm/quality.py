"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost comes first.

Cost and selectivity of each rule are measured on a bounded sample of rows; they set the order only, never a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, fresh_name, text_chunks

SYMBOLS = "#*$%&|<>"
#: Rows that the sample has at most.
SAMPLE_ROWS = 300


class Features:
    """What the rules look at, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def text(self) -> str:
        return self.raw.decode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.raw.count(c) for c in SPACES.encode())

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(c) for c in SYMBOLS.encode())

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - 2
        if n < 2:
            return 0
        own: dict[bytes, int] = {}
        ids = np.fromiter((own.setdefault(w, len(own)) for w in self.words), np.int64, n + 2)
        size = len(own)
        if size < 2_000_000:  # three ids fit 63 bits
            grams = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:
            pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
            grams = pairs[:-1] * np.int64(size) + ids[2:]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n + 2, bool)
        for k in range(3):
            covered[k : k + n] |= twice
        return int(covered.sum())

    @cached_property
    def n_letter_words(self) -> int:
        return sum(not w.isalpha() and any(c.isalpha() for c in w.decode()) or w.isalpha() for w in self.words)


@dataclass(frozen=True)
class Rule:
    """`rejects` says whether a document with these features goes."""

    name: str
    rejects: Callable[[Features], bool]


#: The contract's two rules.
BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Published web-text heuristics, at bounds that running prose stays far from.
MORE_RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: len(f.lines) > 5 and 2 * f.n_dup_lines > len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 25 * f.n_words),
    Rule("letters", lambda f: 10 * f.n_letter_words < 6 * f.n_words),
)
RULES = BASE_RULES + MORE_RULES


def plan(df: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second, measured on at most `rows` rows; ties and an empty table keep the given order."""
    texts = [(r[0] or "").encode() for r in df.select("text").limit(rows).collect()]
    rate = {}
    for rule in rules:
        fresh = [Features(t) for t in texts]
        began = time.perf_counter()
        hits = sum(rule.rejects(f) for f in fresh)
        rate[rule.name] = hits / max(time.perf_counter() - began, 1e-9)
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def first_rejection(f: Features, rules: tuple[Rule, ...]) -> str | None:
    """The first rule in order that rejects; no later rule is computed."""
    return next((r.name for r in rules if r.rejects(f)), None)


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, all columns unchanged, whatever their names. Null text counts as empty and is rejected as too short.

    Repeated rows are judged each, so all or none of them stay; an empty table gives none.
    """
    order = plan(df, rules)
    out = fresh_name(df, "kept")

    from collections.abc import Iterator as It

    import pandas as pd

    def run(texts):
        for batch in texts:
            yield batch.map(lambda t: first_rejection(Features((t or "").encode()), order) is None).astype(bool)

    run.__annotations__ = {"texts": It[pd.Series], "return": It[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "boolean")(F.col("text"))).where(F.col(out)).drop(out)


def measure(df: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Per row of (doc_id, text) the counts, whether a base rule rejects, and the cascade's verdict.

    Null text counts as empty: no words, so base_failed. Repeated rows are kept; other columns are ignored; an empty table gives none.
    """
    order = plan(df, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for batch in batches:
            for part, texts in text_chunks(batch):
                rows, failed, kept = [], [], []
                for t in texts:
                    f = Features(t)
                    rows.append([getattr(f, n) for n in names])
                    failed.append(any(r.rejects(f) for r in BASE_RULES))
                    kept.append(not failed[-1] and first_rejection(f, order) is None)
                counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *names, "base_failed", "kept"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
