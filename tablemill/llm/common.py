"""Helpers that the training-data operators share: scratch tables, Arrow chunks, word hashes, graph components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a worker's memory however long the Arrow batch is.
CHUNK_BYTES = 4 << 20
#: Entries after which a worker's memo of words starts anew.
MEMO_ENTRIES = 400_000
#: The six separators between words.
SPACES = "\t\n\x0b\x0c\r "

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master without it (tests), one under the warehouse."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not own:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor repeats no earlier stage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and the path in it; a plain path is local."""
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def row_key(df: DataFrame, out: str = "_row") -> DataFrame:
    """A key that any later scan computes anew: equal rows (same id and text) have equal keys and equal results."""
    return df.withColumn(out, F.xxhash64(F.col("doc_id"), F.col("text")))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    name = f"__{base}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the texts as UTF-8 (null: empty); a slice holds one row or up to `limit` bytes."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        held = int(ends[start - 1]) if start else 0
        past = max(start + 1, int(np.searchsorted(ends, held + limit, side="right")))
        yield batch.slice(start, past - start), [x or b"" for x in texts.slice(start, past - start).to_pylist()]
        start = past


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class WordHashes(dict):
    """Memo from a word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(texts: list[bytes], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the words of each text.

    bytes.split() splits at exactly the six ASCII separators.
    """
    get = memo.__getitem__
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    out = np.empty(int(counts.sum()), U64)
    at = 0
    for w in words:
        out[at : at + len(w)] = np.fromiter(map(get, w), U64, len(w))
        at += len(w)
    return out, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M2
    x ^= x >> U64(27)
    x *= _M3
    x ^= x >> U64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + _M1 * U64(seed + 1))


def starts_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns agree, nulls with nulls too."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


#: Factor of chained hashes and its inverse modulo 2 ** 64.
CHAIN = 0x9E3779B97F4A7C15
CHAIN_INVERSE = pow(CHAIN, -1, 1 << 64)


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2 ** 64 for each exponent."""
    out, n, square = np.ones(len(n), U64), n.copy(), base
    while n.any():
        with np.errstate(over="ignore"):
            out = np.where(n & 1, out * U64(square), out)
        square, n = square * square % (1 << 64), n >> 1
    return out


def numbered(df: DataFrame, group: str, order: list[str], place: str, chains: dict[str, str] | None = None) -> DataFrame:
    """df with each row's place (a long from 0) in its group by `order`, and chained hashes of long columns (chains: source to result) over the group's rows so far.

    A chain is its value before, times CHAIN, plus the row's own (modulo 2 ** 64).

    A prefix scan: rows are sorted over all tasks, so a group of any size is spread, and so are equal rows. Each task counts on its own; the driver reads
    one row of each task, its first and last group's totals, and gives each task what earlier ones hold of its first group. df is read twice; give it a table.
    """
    chains = chains or {}
    keys, n_own = [group, *order], len(df.columns)
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{place} long", *(f"{x} long" for x in chains.values())])
    names = [*df.columns, place, *chains.values()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, first = TaskContext.get().partitionId(), 0, True
        own, at, held = None, -1, [U64(0)] * len(chains)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g, row = column(b, group), np.arange(n)
            new = np.r_[own is None or not _same(g.slice(0, 1), own)[0], ~_same(g.slice(1), g.slice(0, n - 1))]
            begin = np.maximum.accumulate(np.where(new, row, -1))  # -1: the last batch's group goes on
            places = np.where(begin < 0, at + 1 + row, row - begin)
            up, down = powers(CHAIN, row), powers(CHAIN_INVERSE, row)
            running = []
            for j, source in enumerate(chains):
                with np.errstate(over="ignore"):
                    total = np.r_[U64(0), np.cumsum(column(b, source).to_numpy(zero_copy_only=False).view(U64) * down, dtype=U64)]
                    running.append(up * (total[1:] - np.where(begin < 0, U64(0) - held[j] * U64(CHAIN), total[np.maximum(begin, 0)])))
            firsts = first & ((begin < 0) | ((begin == 0) & (own is None)))
            first = bool(firsts[-1])
            own, at, held = g.slice(n - 1), int(places[-1]), [r[-1] for r in running]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places), *(pa.array(r.view(np.int64)) for r in running), pa.array(np.full(n, part, np.int32)), pa.array(seen + row), pa.array(firsts)], [*names, "_part", "_row", "_first"])
            seen += n

    counted = materialise(rows.mapInArrow(count, f"{schema}, _part int, _row long, _first boolean"), "numbered")
    end = F.max_by(F.struct(F.col(group).alias("g"), place, *chains.values()), "_row")
    parts = counted.groupBy("_part").agg(F.min_by(F.struct(F.col(group).alias("g")), "_row").alias("begin"), end.alias("end"), F.bool_and("_first").alias("one")).orderBy("_part").collect()
    earlier = np.zeros((1 + len(chains), 1 + max((p["_part"] for p in parts), default=0)), U64)
    carry: tuple | None = None
    for p in parts:
        n, hashes = p["end"][place] + 1, [p["end"][x] for x in chains.values()]
        if carry is not None and carry[0] == p["begin"]["g"]:
            earlier[:, p["_part"]] = carry[1]
            if p["one"]:
                n, hashes = n + carry[1][0], [(h + c * pow(CHAIN, n, 1 << 64)) for h, c in zip(hashes, carry[1][1:])]
        carry = (p["end"]["g"], [n, *(h % (1 << 64) for h in hashes)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = np.where(column(b, "_first").to_numpy(zero_copy_only=False), earlier[:, column(b, "_part").to_numpy()], U64(0))
            at = column(b, place).to_numpy()
            out = [*b.columns[:n_own], pa.array(at + before[0].view(np.int64))]
            up = powers(CHAIN, np.where(before[0] > 0, at + 1, 0))
            for j, name in enumerate(chains.values(), 1):
                with np.errstate(over="ignore"):
                    out.append(pa.array((column(b, name).to_numpy().view(U64) + before[j] * up).view(np.int64)))
            yield pa.RecordBatch.from_arrays(out, names)

    return counted.mapInArrow(add, schema)


def components(spark: SparkSession, edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node; nodes without an edge have no row.

    Alternating large-star and small-star rounds; each is written to the shared folder. Only one number a round reaches the driver.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    cur, before = materialise(both, name), None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the least node in u's neighbourhood
        sym = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of u, and u, are tied to the least of them
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("e"), F.col("m")).select(F.col("e.x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        cur = materialise(small, name)
        now = cur.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(a, b) as decimal(20, 0))), 0)")).first()
        if now == before or not now[0]:  # a round that changes nothing leaves stars
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
