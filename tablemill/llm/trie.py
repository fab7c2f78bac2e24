"""Prefix trie of conversations: which conversations share which first turns, and what sharing them saves.

1. Turns become labels (two 64-bit hashes of role and text, and the words), numbered in their conversation, rebuilt, and chained: a prefix of d turns is
   named by d and two chained hashes, so no text moves and a conversation of any length is spread over the tasks (common.numbered).
2. Prefixes are counted where they are made; equal ones become a node: its members, its least one, its parent's name.
3. A node of one member heads a chain of that member's further turns, whose sums are known. Nodes of more than `members` members are heavy: the upper levels.
   All others are dealt by the first light node on their path, a shard, with the heads of chains as childless nodes.
4. A shard's task builds a level-order (LOUDS) trie: nodes in breadth-first order, a bit vector with a 1 for every child and a 0 after each node's, labels
   beside it. Parents come from the bits; sums go up in reverse order.
5. The shards' tops are added up by their heavy parents, and the heavy nodes, TOP_NODES at most, become such a trie of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHAIN_INVERSE, U64, column, materialise, numbered

#: Members above which a node is heavy (more, where TOP_NODES would not do), heavy nodes at most, nodes of shards that are built together, and bytes of a row of ids.
MEMBERS, TOP_NODES, BUILD_NODES, ID_BYTES = 512, 1 << 18, 50_000, 1 << 20
NAME = ["d", "p1", "p2"]


def labelled(df: DataFrame) -> DataFrame:
    """(conv_id, turn, l1, l2, words) of the rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("l1"), F.xxhash64(F.lit(2), role, text).alias("l2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def lent_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from another: its decimal id's CRC-32 modulo 4; a null id takes none."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % 4, F.lit(0))


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv_id, at, l1, l2, words) of the rebuilt conversations' turns, in order of `at`; placed: (conv_id, place, l1, l2, words)."""
    labels = ["l1", "l2", "words"]
    convs = placed.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), lent_turns(F.col("conv_id")).alias("h"))
    heads = placed.where("place < 3").select(F.col("conv_id").alias("base"), "place", *labels)
    lent = convs.join(heads, "base").where("place < h").select("conv_id", (F.col("place") - 3).alias("at"), *labels)
    own = placed.where(F.col("place") >= lent_turns(F.col("conv_id"))).select("conv_id", F.col("place").alias("at"), *labels)
    return lent.unionAll(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, p1, p2, q1, q2, words): a row for each conversation and prefix, with its parent's name; turns: (conv_id, at, l1, l2, words)."""
    chained = numbered(turns, "conv_id", ["at"], "place", {"l1": "p1", "l2": "p2"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l1, l2, p1, p2 = (column(b, c).to_numpy().view(U64) for c in ("l1", "l2", "p1", "p2"))
            with np.errstate(over="ignore"):
                q1, q2 = (((p - x) * U64(CHAIN_INVERSE)).view(np.int64) for p, x in ((p1, l1), (p2, l2)))
            yield pa.RecordBatch.from_arrays([column(b, "conv_id"), pa.array(column(b, "place").to_numpy() + 1), column(b, "p1"), column(b, "p2"), pa.array(q1), pa.array(q2), column(b, "words")], ["conv_id", *NAME, "q1", "q2", "words"])

    return chained.mapInArrow(run, "conv_id long, d long, p1 long, p2 long, q1 long, q2 long, words long")


def names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two hashes as one value that sorts."""
    return np.ascontiguousarray(np.stack([a, b], axis=1)).view("S16").ravel()


class Louds:
    """A forest in level order: `order` (input row of each node), `bits` (from a root above all tops), `parent` (node number, -1 above tops), `level` edges."""

    def __init__(self, depth: np.ndarray, name: np.ndarray, above: np.ndarray, top: np.ndarray):
        n = len(depth)
        by_name = np.argsort(name)
        up = by_name[np.minimum(np.searchsorted(name, above, sorter=by_name), n - 1)]
        # relative levels: tops first, whatever their depth
        level = np.zeros(n, np.int64)
        rest = np.argsort(depth, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(depth[rest]) != 0, True])
        for a, b in zip(edges, edges[1:]):
            rows = rest[a:b]
            level[rows] = np.where(top[rows], 0, level[up[rows]] + 1)
        rank = np.full(n, -1)
        by_level = np.argsort(level, kind="stable")
        self.edges = np.flatnonzero(np.r_[True, np.diff(level[by_level]) != 0, True])
        self.order = np.empty(n, np.int64)
        for a, b in zip(self.edges, self.edges[1:]):
            rows = by_level[a:b]
            rows = rows[np.lexsort((name[rows], np.where(top[rows], -1, rank[up[rows]])))]
            rank[rows] = np.arange(a, b)
            self.order[a:b] = rows
        own = self.order
        degree = np.bincount(np.where(top[own], 0, rank[up[own]] + 1), minlength=n + 1)
        self.labels = name[own]
        self.bits = np.ones(int(degree.sum()) + n + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        ones = np.flatnonzero(self.bits)
        self.parent = ones - np.arange(n) - 1  # zeros before the node's 1, less the root above all

    def children(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """Each node's sum over its subtree; values and sums by node number."""
        out = values.copy()
        for a, b in zip(self.edges[-2:0:-1], self.edges[:0:-1]):
            np.add.at(out, self.parent[a:b], out[a:b])
        return out


def built(t: pa.Table) -> pa.RecordBatch:
    """Nodes (d, p1, p2, q1, q2, n, conv_id, words, top, leaves, saved, more) with the sums over their subtrees.

    more, leaves, saved: what a node has from children that aren't among the rows.
    """
    d, p1, p2, q1, q2, n, words, leaves, saved, more = (t[c].to_numpy() for c in (*NAME, "q1", "q2", "n", "words", "leaves", "saved", "more"))
    trie = Louds(d, names(p1, p2), names(q1, q2), t["top"].to_numpy())
    own = trie.order
    children = trie.children() + more[own]
    all_leaves = trie.add_up(np.where(children == 0, 1, leaves[own]))
    all_saved = trie.add_up((n[own] - 1) * words[own] + saved[own])
    conv = t["conv_id"].combine_chunks().take(pa.array(own))
    parent = conv.take(pa.array(np.where(trie.parent < 0, 0, trie.parent), mask=trie.parent < 0))
    return pa.RecordBatch.from_arrays([*(pa.array(x[own]) for x in (d, p1, p2, q1, q2)), pa.array(t["top"].to_numpy()[own]), pa.array(children), pa.array(all_leaves), pa.array(all_saved), parent], RESULT_NAMES)


NODES = [*NAME, "q1", "q2", "n", "conv_id", "words", "top", "leaves", "saved", "more"]
RESULT_NAMES = [*NAME, "q1", "q2", "top", "n_children", "n_leaves", "saved_tokens", "parent_conv_id"]
RESULT = "d long, p1 long, p2 long, q1 long, q2 long, top boolean, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def rolled(nodes: DataFrame) -> DataFrame:
    """The sums of the nodes of shards (NODES, c1, c2): rows come by shard, whole shards are built some BUILD_NODES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < BUILD_NODES:
                continue
            t = pa.Table.from_batches(held)
            c1, c2 = t["c1"].to_numpy(), t["c2"].to_numpy()
            past = len(t) - int(((c1 == c1[-1]) & (c2 == c2[-1])).sum())  # the last shard may go on
            if past:
                yield built(t.slice(0, past))
            held = t.slice(past).combine_chunks().to_batches()
            size = len(t) - past
        if size:
            yield built(pa.Table.from_batches(held))

    return nodes.repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(run, RESULT)


def ends(rows: DataFrame, all_convs: DataFrame) -> DataFrame:
    """(d, p1, p2, n_ends, ends_sha256): the conversations that end at a node, their decimal ids ascending and joined by commas (a null id: empty).

    Ids are sorted over all tasks and joined where they lie, ID_BYTES a row at most; a node's rows are then hashed in a stream, in order.
    """
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NAME), "d").alias("e"))
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in NAME))
    turnless = all_convs.join(last, all_convs["conv_id"].eqNullSafe(last["conv_id"]), "left_anti").select("conv_id", none.alias("e"))
    at = materialise(last.unionByName(turnless).select("e.*", "conv_id"), "ends")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, size, first = None, [], 0, None
        row = lambda: pa.RecordBatch.from_pylist([{"d": own[0], "p1": own[1], "p2": own[2], "first": first, "n": len(ids), "ids": ",".join(ids)}], CHUNKS)
        for b in batches:
            for *node, conv in zip(*(column(b, c).to_pylist() for c in (*NAME, "conv_id"))):
                if node != own or size > ID_BYTES:
                    if own is not None:
                        yield row()
                    own, ids, size, first = node, [], 0, conv
                ids.append("" if conv is None else str(conv))
                size += len(ids[-1]) + 1
        if own is not None:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, h = None, 0, sha256()
        row = lambda: pa.RecordBatch.from_pylist([{"d": own[0], "p1": own[1], "p2": own[2], "n_ends": n, "ends_sha256": h.hexdigest()}], DIGESTS)
        for b in batches:
            for *node, m, ids in zip(*(column(b, c).to_pylist() for c in (*NAME, "n", "ids"))):
                if node != own:
                    if own is not None:
                        yield row()
                    own, n, h = node, 0, sha256()
                h.update((("," if n else "") + ids).encode())
                n += m
        if own is not None:
            yield row()

    chunks = at.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").mapInArrow(join, "d long, p1 long, p2 long, first long, n long, ids string")
    return chunks.repartition(*NAME).sortWithinPartitions(*NAME, "first").drop("first").mapInArrow(digest, "d long, p1 long, p2 long, n_ends long, ends_sha256 string")


CHUNKS = pa.schema([("d", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("d", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])


def heavy_above(nodes: DataFrame, members: int) -> int:
    """The least power-of-two multiple of `members` above which no more than TOP_NODES nodes lie."""
    step = F.floor(F.log2(F.greatest(F.col("n") - 1, F.lit(1)) / members))
    sizes = sorted(((int(r[0]), r[1]) for r in nodes.where(F.col("n") > members).groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, 0
    for s, count in sizes:
        total += count
        if total > TOP_NODES:
            least = s + 1
            break
    return members << least


def prefix_trie(df: DataFrame, members: int = MEMBERS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text): the contract's columns.

    Turns are ordered by `turn`, nulls first, ties by a hash of role and text; null role or text is empty. Rows of one conversation and turn all
    count, repeated rows too. Rows with a null conv_id make up one conversation that takes no turns from another and whose decimal id is empty; it never names a
    node that has another member. Texts are hashed whole, where they are read. A table without rows has no conversations, so no node. Other columns
    are ignored. A shard's task holds the nodes below a node with `members` members; only a stretch of turns that several conversations share
    and that is itself too long for a task's memory would not fit.
    """
    zero = lambda *cs: [F.lit(0).cast("long").alias(c) for c in cs]
    placed = numbered(materialise(labelled(df), "turns"), "conv_id", ["turn", "l1", "l2"], "place")
    rows = materialise(prefixes(materialise(rebuilt(placed), "rebuilt")), "prefixes")
    all_convs = materialise(placed.select("conv_id").distinct(), "conversations")
    counted = rows.groupBy(*NAME).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    root = all_convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0").select(*zero(*NAME), "n", "conv_id", *zero("words", "q1", "q2"))
    nodes = materialise(counted.unionByName(root), "nodes")
    above = heavy_above(nodes, members)
    is_heavy = (F.col("n") > above) | (F.col("d") == 0)
    heavy = nodes.where(is_heavy)
    by_parent = [(F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    heavy_names = F.broadcast(heavy.select(*NAME))  # TOP_NODES rows at most
    under = F.broadcast(heavy.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"), F.lit(True).alias("top")))
    # the light part: nodes that several conversations share, and the heads of single ones' chains
    light = nodes.where(~is_heavy)
    single = light.where("n = 1")
    head = single.groupBy("conv_id").agg(F.min(F.struct("d", "p1", "p2", "q1", "q2", "n", "words")).alias("x")).select("conv_id", "x.*")
    placed_light = light.where("n > 1").unionByName(head).join(under, ["d", "q1", "q2"], "left").withColumn("top", F.coalesce("top", F.lit(False)))
    placed_light = materialise(placed_light, "light")
    cut = rows.join(heavy_names, NAME, "left_anti").groupBy("conv_id").agg(F.min(F.struct("d", "p1", "p2")).alias("c")).select(F.col("conv_id").alias("by"), F.col("c.p1").alias("c1"), F.col("c.p2").alias("c2"))
    dealt = placed_light.where("n > 1 or not top")
    dealt = dealt.join(cut, dealt["conv_id"].eqNullSafe(cut["by"])).select(*NAME, "q1", "q2", "n", "conv_id", "words", "top", *zero("leaves", "saved", "more"), "c1", "c2")
    low = materialise(rolled(dealt), "shards")
    # the heavy part: what hangs below it is added up by parent
    alone = placed_light.where("n = 1 and top").select(*NAME, "q1", "q2", F.lit(True).alias("top"), *zero("n_children"), F.lit(1).cast("long").alias("n_leaves"), *zero("saved_tokens"), F.lit(None).cast("long").alias("parent_conv_id"))
    below = low.unionByName(alone)
    sums = below.where("top").groupBy(*by_parent).agg(F.count("*").alias("more"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    upper = heavy.join(sums, NAME, "left").select(*NAME, "q1", "q2", "n", "conv_id", "words", (F.col("d") == 0).alias("top"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("leaves", "saved", "more")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield built(pa.Table.from_batches(held))

    high = upper.repartition(1).mapInArrow(build, RESULT)  # TOP_NODES rows at most
    tops = below.where("top").drop("parent_conv_id").join(under.drop("top"), ["d", "q1", "q2"]).withColumnRenamed("above", "parent_conv_id")
    sums = reduce(DataFrame.unionByName, (x.select(*NAME, "n_children", "n_leaves", "saved_tokens", "parent_conv_id", F.lit(True).alias("known")) for x in (low.where("not top"), tops, high)))
    empty = sha256().hexdigest()
    out = nodes.join(sums, NAME, "left").join(ends(rows, all_convs), NAME, "left")
    one = (F.col("n") == 1) & (F.col("d") > 0)
    return out.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("known"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(one, F.when(F.col("n_ends") > 0, 0).otherwise(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"),
        F.when(one, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), F.when(one, 0).otherwise(F.col("saved_tokens")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
