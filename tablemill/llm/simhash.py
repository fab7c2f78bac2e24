"""SimHash near-duplicates: fingerprints, joined on blocks of their bits, verified by Hamming distance.

1. A text's fingerprint is the majority of its shingles' hash bits; equal fingerprints are one node from then on, so copies of any number cost one.
2. Fingerprints within d bits agree on at least two of d + 2 blocks of bits. Each is keyed by every pair of blocks; fingerprints with
   a key in common meet and are compared.
3. A key that more than MEMBERS fingerprints have is not gathered: its fingerprints are keyed again by blocks of the bits that the key
   leaves open. That ends, as the bits do: no key that leaves OPEN_BITS or fewer open, three rounds on with d = 2, has more than 2 ** OPEN_BITS.
4. Of a key's links only a spanning forest is emitted, a row a fingerprint at most; components of all forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, column, components, materialise, text_chunks

BITS = 64
#: Fingerprints that meet under one key, and bits that are left open: more are keyed again by further bits, as long as a key leaves more open.
MEMBERS, OPEN_BITS = 256, 8
#: Hot keys up to which they are broadcast (16 MB).
BROADCAST_ROWS = 1_000_000
#: Shingles whose bits are counted at once (64 bytes each).
SHINGLES = 1 << 16


def fingerprint(text: bytes, n: int, seed: int) -> int:
    """The majority of the bits of XXH64 of the text's n-word shingles, repeats included; a tie is 0, as are texts without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(len(words) - n + 1, 1)
    spans = zip(starts[:last].tolist(), ends[min(n, len(words)) - 1 :].tolist())
    get = xxhash.xxh64_intdigest
    hashes = np.fromiter((get(joined[a:b], seed) for a, b in spans), U64, last)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, SHINGLES):
        some = hashes[at : at + SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes())


def fingerprints(df: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of (doc_id, text); fp is the fingerprint as a signed long. Whole texts, CHUNK_BYTES of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, limit=CHUNK_BYTES):
                fps = np.array([fingerprint(t, n, seed) for t in texts], U64)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(free: int, blocks: int) -> list[int]:
    """The set bits of `free`, cut into neighbouring blocks of about equal size."""
    bits = [i for i in range(BITS) if free >> i & 1]
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def keyed(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, mask, held): each row once for every two blocks of the bits outside its mask; the new mask has those too, held are its bits of fp."""
    blocks = distance + 2

    def wider(mask: int) -> list[int]:
        masks = block_masks(~mask & (1 << BITS) - 1, blocks)
        return [_signed(mask | x | y) for x, y in combinations(masks, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, list[int]] = {}
        for b in batches:
            fp, mask = column(b, "fp").to_numpy(), column(b, "mask").to_numpy()
            for m in np.unique(mask).tolist():
                own = fp[mask == m]
                for w in memo.setdefault(m, wider(m & (1 << BITS) - 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), w)), pa.array(own & np.int64(w))], ["fp", "mask", "held"])

    return nodes.select("fp", "mask").mapInArrow(run, "fp long, mask long, held long")


def forest(fp: np.ndarray, key: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the fingerprints (sorted by key) that have equal keys and differ in `distance` bits at most."""
    root = np.arange(len(fp))
    a, b = [], []
    size = np.bincount(key)[key] if len(key) else key
    at = np.flatnonzero(size > 1)
    for lag in range(1, int(size.max(initial=0))):
        at = at[at + lag < len(fp)]
        at = at[key[at + lag] == key[at]]
        near = at[np.bitwise_count((fp[at] ^ fp[at + lag]).view(U64)) <= distance]
        a.append(near)
        b.append(near + lag)
    x, y = (np.concatenate([*z, np.empty(0, np.int64)]).astype(np.int64) for z in (a, b))
    while True:  # each end takes the lesser root, roots take their own root
        low = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, root[x], low)
        np.minimum.at(now, root[y], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return fp[tied], fp[root[tied]]


def met(rows: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) of a forest under each key of rows (fp, mask, held); keys have max(MEMBERS, 2 ** OPEN_BITS) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def edges(t: pa.Table) -> pa.RecordBatch:
            fp, mask, held = (t[c].to_numpy() for c in ("fp", "mask", "held"))
            key = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (held[1:] != held[:-1])])
            x, y = forest(fp, key, distance)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            mask, held = t["mask"].to_numpy(), t["held"].to_numpy()
            if not len(t):
                continue
            own = (mask == mask[-1]) & (held == held[-1])
            past = len(t) - int(own.sum())  # the last key may go on in the next batch
            if past:
                yield edges(t.slice(0, past))
            rest = t.slice(past).combine_chunks()
        if rest is not None and len(rest):
            yield edges(rest)

    return rows.repartition("mask", "held").sortWithinPartitions("mask", "held", "fp").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints (fp): their components are those of all pairs that differ in `distance` bits at most.

    Each round's keys with more than MEMBERS fingerprints and more than OPEN_BITS open bits go on to the next, with further bits.
    """
    todo, found = nodes.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        rows = keyed(todo, distance)
        rows = materialise(rows if found is None else rows.distinct(), "blocks")  # two keys can be refined to the same one
        hot = materialise(rows.groupBy("mask", "held").agg(F.count("*").alias("n")).where((F.col("n") > MEMBERS) & (F.bit_count("mask") < BITS - OPEN_BITS)).select("mask", "held"), "hot")
        many = hot.count()
        keys = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
        edges = materialise(met(rows.join(keys, ["mask", "held"], "left_anti") if many else rows, distance), "edges")
        found = edges if found is None else found.unionAll(edges)
        if not many:
            return found.distinct()
        todo = rows.join(keys, ["mask", "held"], "left_semi")


def link_components(df: DataFrame, n: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """Per row of (doc_id, text): fp and component_id, the least doc_id that links reach, its own included.

    Rows with equal fingerprints are linked: so are equal rows, and all rows without a word (null, empty or blank text: fingerprint 0). Texts are read whole,
    however long. A null doc_id never becomes a component's id unless no row of the component has another. Other columns are ignored,
    an empty table gives no rows.
    """
    each = materialise(fingerprints(df, n, seed), "fingerprints")
    nodes = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("own")), "nodes")
    comp = components(df.sparkSession, links(nodes, distance))
    rooted = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    ids = materialise(rooted.join(least, "root").select("fp", "component_id"), "ids")
    return each.join(ids, "fp").select("doc_id", "fp", "component_id")


def shown(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_copies(df: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, seed 42, links at 2 bits."""
    return link_components(df).select("doc_id", shown(F.col("fp")).alias("fingerprint"), "component_id")
