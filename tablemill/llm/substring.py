"""Substring dedup by seed and extend: repeated passages of at least a number of words, over all documents.

Seeds. Winnowing picks in each window of `window` words its least k-gram; equal windows pick the same k-gram at the same place. Windows with the
same pick are consecutive: a run. A window can repeat only if its run's anchor does.

Extension. A run covers all words that its windows do, to both sides of the anchor. Runs with the same anchor are joined and compared as a whole
first: an equal run elsewhere makes all its windows repeats. Only runs that differ from others at their anchor, which is where a repeat
begins or ends, are compared window by window, one row for each different run. Overlapping repeated windows then add up to the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, column, fresh_name, hash_words, materialise, mix, row_key, signed, starts_of, text_chunks

#: Multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are cut into runs at once: a dozen arrays of its words' number are held besides.
TEXT_BYTES = 1 << 20
#: Words of a k-gram for a window of 35, in proportion for others.
SEED_SHARE = 16 / 35


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of words: those of equal stretches are equal."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(words * _powers(_BASE, n), out=self.sums[1:])
            self.back = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(U64))


def runs_of(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, run hash) of all runs, and the rolling hash."""
    k = max(1, int(window * SEED_SHARE))
    span = window - k + 1  # k-grams of a window, and the most windows that a run has
    roll, starts = Rolling(words), starts_of(counts)
    n = len(words) - window + 1
    if n <= 0:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, U64), np.empty(0, U64), roll)
    grams = roll(np.arange(len(words) - k + 1), k)
    best, pick, width = grams, np.arange(len(grams)), 1
    while width < span:  # the least, the later of equals, of the next `width` k-grams, by doubling
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        later = b <= a
        best, pick = np.where(later, b, a), np.where(later, pick[step:], pick[: len(pick) - step])
        width += step
    doc = np.repeat(np.arange(len(counts)), counts)[:n]
    inside = np.arange(n) + window <= starts[doc + 1]
    change = np.ones(n, bool)
    change[1:] = (pick[1:n] != pick[: n - 1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change & inside)
    held = np.cumsum(np.r_[0, inside])
    ends = np.r_[np.flatnonzero(change), n]
    past = ends[np.searchsorted(ends, first, side="right")]
    size = held[past] - held[first]
    anchor = best[first]
    with np.errstate(over="ignore"):
        whole = mix(roll(first, size + window - 1) ^ mix((pick[first] - first).astype(U64) + U64(17)))
    return doc[first], first - starts[doc[first]], size, anchor, whole, roll


def _flagged(texts: list[bytes], runs: list, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each text and its runs (first window, bits of repeated windows): its word count and the words that stay."""
    for t, own in zip(texts, runs):
        words = t.split()
        if not own:
            yield len(words), words
            continue
        edge = np.zeros(len(words) + window + 1, np.int32)
        for r in own:
            a, bits = r["start"], r["bits"]
            while bits:
                low = bits & -bits
                i = a + low.bit_length() - 1
                edge[i] += 1
                edge[i + window] -= 1
                bits ^= low
        gone = np.cumsum(edge[: len(words)]) > 0
        yield len(words), [w for w, g in zip(words, gone) if not g]


def repeats(df: DataFrame, window: int) -> DataFrame:
    """(_row, runs): of each row the runs with repeated windows, as (start, bits), bit i for the window that starts i words later."""
    if not 2 <= window <= 100:
        raise ValueError("windows have 2 to 100 words")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part, texts in text_chunks(batch, limit=TEXT_BYTES):
                doc, start, size, anchor, whole, _ = runs_of(*hash_words(texts, memo), window)
                row = column(part, "_row").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([row, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(signed(anchor)), pa.array(signed(whole))], ["_row", "start", "size", "anchor", "run"])

    def runs_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal runs of a chunk as one row with their number and the first of them."""
        memo = WordHashes()
        for batch in batches:
            for part, texts in text_chunks(batch, limit=TEXT_BYTES):
                doc, start, size, anchor, whole, _ = runs_of(*hash_words(texts, memo), window)
                _, at, n = np.unique(whole, return_index=True, return_counts=True)
                row = column(part, "_row").take(pa.array(doc[at]))
                yield pa.RecordBatch.from_arrays([row, pa.array(start[at].astype(np.int32)), pa.array(size[at].astype(np.int32)), pa.array(signed(anchor[at])), pa.array(signed(whole[at])), pa.array(n)], ["_row", "start", "size", "anchor", "run", "n"])

    kinds = "_row long, start int, size int, anchor long, run long"
    counted = df.select("_row", "text").mapInArrow(runs_counted, f"{kinds}, n long")
    # one exchange by anchor serves both groupings: with the same columns read, Spark reuses it for the second
    by_run = counted.repartition("anchor").groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.min(F.struct("_row", "start", "size")).alias("one"))
    stats = by_run.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.max("one").alias("any"))
    seeds = by_run.join(stats.where("all > 1 and any is not null").drop("any"), "anchor")
    seeds = materialise(seeds.select("run", "n", "kinds", "one._row", "one.start", "one.size"), "seeds")
    full = seeds.where("n > 1").select("run", F.expr("shiftleft(1L, size) - 1").alias("bits"))
    # runs that others differ from at the same anchor: their windows one by one
    mixed = seeds.where("kinds > 1").groupBy("_row").agg(F.collect_list(F.struct("run", "start", "size", "n")).alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part, texts in text_chunks(batch, limit=TEXT_BYTES):
                words, counts = hash_words(texts, memo)
                roll, starts = Rolling(words), starts_of(counts)
                own = column(part, "runs").to_pylist()
                flat = [(starts[i] + r["start"], r["size"], r["run"], r["n"]) for i, rs in enumerate(own) for r in rs]
                size = np.array([f[1] for f in flat], np.int64)
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                first = np.repeat(np.array([f[0] for f in flat], np.int64), size)
                yield pa.RecordBatch.from_arrays([pa.array(signed(roll(first + at, window))), pa.array(np.repeat(np.array([f[2] for f in flat], np.int64), size)), pa.array(at.astype(np.int32)), pa.array(np.repeat(np.array([f[3] for f in flat], np.int64), size))], ["window", "run", "at", "n"])

    one_by_one = df.select("_row", "text").dropDuplicates(["_row"]).join(mixed, "_row").select("text", "runs").mapInArrow(windows, "window long, run long, at int, n long")
    one_by_one = materialise(one_by_one, "windows")
    twice = one_by_one.groupBy("window").agg(F.sum("n").alias("c")).where("c > 1").select("window")
    partly = one_by_one.join(twice, "window", "left_semi").groupBy("run").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    # written, so that the join below has an exchange of its own on either side and a run that stands in very many documents can be split
    bits = materialise(full.unionAll(partly).groupBy("run").agg(F.bit_or("bits").alias("bits")), "bits")
    found = df.select("_row", "text").mapInArrow(runs, kinds).select("_row", "start", "run").join(bits, "run")
    return found.groupBy("_row").agg(F.collect_set(F.struct("start", "bits")).alias("runs"))


def _with_runs(df: DataFrame, window: int, key: str, own: str) -> DataFrame:
    """df with its row key under `key` and its repeated runs under `own`."""
    docs = row_key(df, key)
    found = repeats(docs.select(F.col(key).alias("_row"), "text"), window)
    return docs.join(found.select(F.col("_row").alias(key), F.col("runs").alias(own)), key, "left")


def measure(df: DataFrame, window: int = 35) -> DataFrame:
    """Per row of (doc_id, text): n_words, n_removed, and a digest of the words that stay.

    A word goes if a window of `window` words that covers it also starts anywhere else, in this row or another (equal rows count as two).
    Null text has no words; texts shorter than a window lose none; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, limit=TEXT_BYTES):
                out = [(n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for n, kept in _flagged(texts, column(part, "runs").to_pylist(), window)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = _with_runs(df.select("doc_id", "text"), window, "_row", "_rowruns")
    return docs.select("doc_id", "text", F.col("_rowruns").alias("runs")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(df: DataFrame, window: int = 35) -> DataFrame:
    """The documents less every repeated passage; texts without one stay as they are, others are their kept words joined by spaces.

    n_chars, where present, follows; documents of which nothing stays keep an empty text. Null texts stay null.
    Equal rows repeat each other, so from a window on both lose their words; other columns stay, whatever their names; an empty table gives none.
    """
    import pandas as pd

    key, found = fresh_name(df, "row"), fresh_name(df, "found")

    def clean(text: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, runs):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            ((_, kept),) = _flagged([t.encode()], [[dict(r) for r in own]], window)
            out.append(b" ".join(kept).decode())
        return pd.Series(out, dtype=object)

    clean.__annotations__ = {"text": pd.Series, "runs": pd.Series, "return": pd.Series}
    out = _with_runs(df, window, key, found)
    packed = F.transform(F.col(found), lambda r: F.struct(r["start"].alias("start"), r["bits"].alias("bits")))
    out = out.withColumn("text", F.pandas_udf(clean, "string")(F.col("text"), packed))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.drop(key, found)
