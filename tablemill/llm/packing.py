"""Best-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so best-fit decreasing needs only how many pieces have each length: bins
with equal contents are one group, and a segment tree over remaining capacities finds the tightest open bins in
logarithmic time. The driver plans over at most `capacity` counts, whatever the input's size; the plan maps ranks
within a length to bins, and tasks look their pieces up in it.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh_name, materialise, quoted, text_chunks
from .pretokens import MemoEncoder

#: Bytes of text that are encoded at once.
CHUNK = 8 << 20
#: Pieces that a group has about, of those that each length is dealt into, so that a common length is numbered by many tasks; and the fewest groups.
GROUP_PIECES, LEAST_GROUPS = 100_000, 32


class SegmentTree:
    """The open remaining capacities 0..capacity; finds the least one that is at least a wanted size."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, wanted: int) -> int | None:
        i = wanted + self.size
        if self.open[i]:
            return wanted
        while i > 1:  # up to the first right sibling with an open leaf, then down its left edge
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of counts[length] pieces of each length.

    Returns rows (length, first rank, last rank + 1, first bin, pieces a bin, place in the bin of the first of these), and the number of bins.
    A row deals its ranks to consecutive bins, `pieces a bin` to each; the last bin of a row may get fewer.
    """
    tree = SegmentTree(capacity)
    groups: dict[int, list[list[int]]] = defaultdict(list)  # remaining capacity -> [first bin, bins], equal in contents
    rows, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            groups[remaining].append([first, n])
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:  # all that is left opens new bins
                remaining, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = groups[remaining].pop()
                if not groups[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            rows.append((length, rank, rank + placed, first, each, capacity - remaining))
            full = placed // each
            put(remaining - each * length, first, full)
            put(remaining - (placed - full * each) * length, first + full, used - full)
            put(remaining, first + used, n - used)
            rank, left = rank + placed, left - placed
    return rows, bins


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place) of each piece, for a list in memory."""
    counts: dict[int, int] = defaultdict(int)
    ranks = []
    for n in lengths:
        ranks.append(counts[n])
        counts[n] += 1
    rows, _ = best_fit_plan(counts, capacity)
    look = Lookup(rows)
    at = look(np.array(lengths, np.int64), np.array(ranks, np.int64))
    return list(zip(at[0].tolist(), at[1].tolist()))


class Lookup:
    """From (length, rank) to (bin, place) by binary search in the plan."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        rows = sorted(rows)
        self.cols = [np.array([r[i] for r in rows], np.int64) for i in range(6)]
        self.first = {}
        for i, r in enumerate(rows):
            self.first.setdefault(r[0], [i, i])[1] = i + 1

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            lo, hi = self.first[int(n)]
            at = lo + np.searchsorted(self.cols[1][lo:hi], ranks[own], side="right") - 1
            k = ranks[own] - self.cols[1][at]
            bins[own] = self.cols[3][at] + k // self.cols[4][at]
            places[own] = self.cols[5][at] + k % self.cols[4][at] * n
        return bins, places


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, pattern: str) -> MemoEncoder:
    """A worker's encoder by the tokenizer library; its memos serve all tasks of the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode_many(pretokens: list[str]) -> Iterator[bytes]:
        for e in tokenizer.encode_batch_fast(pretokens, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    # ids whose token starts with the byte-mapped space; of parts in a row each starts with one
    starts = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(tokenizer.get_vocab_size())])

    def encode_parts(parts: list[str]) -> Iterator[bytes]:
        """Parts that start with a space and hold no other, many in one call of the library, which cuts before each space."""
        groups = [parts[k : k + 500] for k in range(0, len(parts), 500)]
        for own, e in zip(groups, tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [*(4 * np.flatnonzero(starts[ids])).tolist(), 4 * len(ids)]
            if len(cuts) - 1 != len(own):
                raise ValueError("parts and spaces differ")
            raw = ids.tobytes()
            for a, b in zip(cuts, cuts[1:]):
                yield raw[a:b]

    return MemoEncoder(pattern, "tokenizers", encode_many, encode_parts)


def token_pieces(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut into pieces of at most `capacity`.

    Only longer documents are cut; the first piece takes the remainder, the others are full. Null text is empty: the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(tokenizer_path, pattern)
        for batch in batches:
            for part, _ in text_chunks(batch, limit=CHUNK):
                rows: list[tuple[int, int, int, int, int]] = []
                ids, each = memo.encode_array(column(part, "text"))
                ids = np.insert(ids, np.cumsum(each), end_id)
                raw, at = memoryview(ids).cast("B"), 0
                for i, n in enumerate((each + 1).tolist()):
                    head = n % capacity or capacity
                    for k, a in enumerate([0, *range(head, n, capacity)]):
                        b = head if not k else a + capacity
                        rows.append((i, k, a, b - a, zlib.crc32(raw[4 * (at + a) : 4 * (at + b)])))
                    at += n
                who = column(part, "doc_id").cast(pa.int64()).take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.int64()) for j in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([who, *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `capacity`, in as few sequences as best-fit decreasing gives.

    Any rows will do, repeated ones, null values and any other columns' names included; an empty table gives an empty table. Columns named
    sequence_id or offset are replaced.
    """
    pieces = materialise(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in counts if n is not None) or None in counts:
        raise ValueError(f"a length is not in 1..{capacity}")
    rows, _ = best_fit_plan(counts, capacity)
    names = [quoted(c) for c in pieces.columns if c != "length"]
    group, rank, before_ = (fresh_name(pieces, x) for x in ("group", "rank", "before"))
    key = F.pmod(F.xxhash64(*names), F.lit(max(LEAST_GROUPS, sum(counts.values()) // GROUP_PIECES))) if names else F.lit(0)
    dealt = pieces.withColumn(group, key)
    # ranks: one within (length, group), after what the length's earlier groups hold; both are dealt by (length, group)
    held = dealt.groupBy("length", group).agg(F.count("*").alias("n"))
    before = held.withColumn(before_, F.sum("n").over(Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", group, F.coalesce(before_, F.lit(0)).alias(before_))
    order = names or [F.lit(0)]
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("length", group).orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", group])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before_)).drop(group, before_)
    plan = pieces.sparkSession.sparkContext.broadcast(rows)  # bounded by the capacity, not by the input
    from pyspark.sql.types import LongType, StructType

    kept = list(pieces.schema)
    length = pieces.columns.index("length")
    schema = StructType(list(kept)).add("sequence_id", LongType()).add("offset", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(plan.value)
        for b in batches:
            *own, ranks = b.columns
            at = look(own[length].cast(pa.int64()).to_numpy(), ranks.cast(pa.int64()).to_numpy())
            yield pa.RecordBatch.from_arrays([*own, pa.array(at[0]), pa.array(at[1])], schema.names)

    # by place: a column's name may hold a dot, which a map's arguments can't
    placed = ranked.select(*(quoted(f.name) for f in kept), rank).toDF(*(f"c{i}" for i in range(len(kept) + 1)))
    return placed.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row a piece of each document of (doc_id, text): where the piece starts, its ids' digest, and its sequence and place.

    Null and empty texts are the end id alone; long ones are cut into pieces; a null doc_id stays null; repeated rows are packed each; ties
    between equal lengths change no number of sequences; other columns are ignored; an empty table gives none.
    """
    return pack(token_pieces(df, tokenizer_path, pattern, end_id, capacity), capacity)
