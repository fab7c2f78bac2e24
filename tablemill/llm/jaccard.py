"""Exact n-gram Jaccard join by skipping over set relations.

1. Lists by blocks. A set's shingle hashes, in the order of their values, are cut into blocks by position in the hash space. Linked sets differ in at
most k shingles, so among more than k blocks at least one is equal in both, and a set with f filled blocks shares f - k of them with any partner.
Lists are keyed by (size class, block, contents of the block): blocks whose contents differ are skipped unread. Only sets that share as many
lists as a partner would need go on; most documents end here, and only of the others the sets are stored.

2. Answers taken over. Each set is compared with one leader only, the list leader that it shares most lists with. A set that is linked to its leader
takes the leader's answer, its component, and needs no further one; lists whose members are all in one component are skipped from then on. This is repeated
for the lists that are left, with a member of another component as leader.

3. Lists by position. The sets that still share enough lists with another component are joined exactly, rarest shingles first. Shingles that no other component
has can't be shared, so they come first and only use up positions. A list's entries are sorted by size and held in blocks with the partner sizes that the
block's positions still allow; whole blocks are skipped. Pairs that are left and whose sets were both compared with one leader get bounds from those two answers,
    |L & x| + |L & y| - |L| <= |x & y| <= min(|L & x|, |L & y|) + min(|x \\ L|, |y \\ L|),
and only pairs that these don't decide are intersected.

Which leaders are compared in step 2 changes the work of step 3, never the links. Tables of each step are in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, column, components, fresh_name, hash_words, materialise, mix, row_key, seeded, starts_of, text_chunks

#: Ratio of the size classes' ends, and permutations that sets with many empty blocks may take.
CLASS_RATIO, PERMUTATIONS = 0.6, 3
#: Rounds in which sets take a leader's answer over.
ROUNDS = 2
#: Rows up to which a table of one long a row is broadcast (16 MB), entries of a list that one task holds, and entries of a block that is skipped whole.
BROADCAST_ROWS, LIST_SHARE, BLOCK = 2_000_000, 4096, 64
#: Bytes of text whose lists are put together before they are sent.
COMBINE_BYTES = 8 << 20


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Each document's set as sorted distinct hashes; with fewer than n words the whole sequence is the one shingle."""
    starts = starts_of(counts)
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            acc = hashes[: len(hashes) - n + 1].copy()
            for k in range(1, n):
                acc = acc * U64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
            grams = mix(acc)
        else:
            grams = np.empty(0, U64)
        out = []
        for a, c in zip(starts[:-1].tolist(), counts.tolist()):
            if c >= n:
                out.append(np.unique(grams[a : a + c - n + 1]))
            elif c:
                acc = U64(c)
                for h in hashes[a : a + c]:
                    acc = acc * U64(0x9E3779B97F4A7C15) + h
                out.append(mix(np.array([acc ^ U64(0xA5A5A5A5A5A5A5A5)], U64)))
            else:
                out.append(np.empty(0, U64))
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, from its contents."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def class_of(n: int) -> int:
    return math.floor(math.log(n) / -math.log(CLASS_RATIO) + 1e-9)


@cache
def scheme(c: int, percent: int) -> tuple[int, int]:
    """The blocks of a class, and the most shingles that two sets of it differ in if they are linked. Its lists hold its own sets and the smaller sets that can reach one of its own.

    One more than the shingles that two of its sets can differ in, and some more for the empty blocks that its largest sets have.
    """
    largest = smallest(c + 1) - 1
    k = 2 * largest * (100 - percent) // (100 + percent)
    for m in range(k + 1, 2 * k + 2):
        mean = m * math.exp(-largest / m)
        if m - k - 1 >= mean + 2 * math.sqrt(mean) - 0.5:
            return m, k
    return k + 1, k


def lists_of(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, int, int]]:
    """The lists that a set stands in, as (keys, lot, need) for each lot. Any two different sets over the threshold have a list in common.

    Linked sets differ in at most n * (100 - percent) / percent shingles, so that many blocks at most. If the set's empty blocks are no more than the
    blocks that stay equal at least, less one, then one that is equal is not empty. A set with more takes another permutation too, and at last its empty blocks.
    need: a set has a partner only if in one of its lots it shares this many lists with other sets.
    """
    n, out = len(s), []
    classes = [class_of(n)]
    while 100 * n >= percent * smallest(classes[-1] + 1):
        classes.append(classes[-1] + 1)
    for own in classes:
        m, k = scheme(own, percent)
        differ = min(k, n * (100 - percent) // percent)
        for turn in range(PERMUTATIONS):
            x = s if not turn else np.sort(seeded(s, 1 + turn))
            block = (x >> U64(32)) * U64(m) >> U64(32)  # ascending, as x is
            edges = np.searchsorted(block, np.arange(m + 1, dtype=U64))
            total = np.zeros(n + 1, U64)
            np.cumsum(seeded(x, 99), out=total[1:])
            held, full = total[edges[1:]] - total[edges[:-1]], edges[1:] > edges[:-1]
            filled = int(full.sum())
            many = m - filled > m - 1 - differ
            lot = own * 16 + turn
            with np.errstate(over="ignore"):
                keys = mix(held + seeded(np.arange(m, dtype=np.int64).view(U64) + U64(lot * 1_000_003) * U64(0x9E3779B97F4A7C15), 7))
            out.append((keys if many and turn == PERMUTATIONS - 1 else keys[full], lot, 1 if many else filled - differ))
            if not many:
                break
    return out


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    return np.concatenate([keys for keys, _, _ in lists_of(s, percent)])


@cache
def smallest(c: int) -> int:
    n = max(1, math.floor(CLASS_RATIO ** -c))
    while class_of(n) < c:
        n += 1
    while n > 1 and class_of(n - 1) >= c:
        n -= 1
    return n


def sets_of(df: DataFrame, n: int) -> DataFrame:
    """(doc_id, _row, n_shingles, node): node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part, texts in text_chunks(batch):
                sets = shingles(*hash_words([t.lower() for t in texts], memo), n)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "_row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "_row", "n_shingles", "node"])

    return df.select(F.col("doc_id").cast("long"), "_row", "text").mapInArrow(run, "doc_id long, _row long, n_shingles long, node long")


LISTS = "key long, node long, lot int, need int"


def postings(df: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node, lot, need, held): the lists that each text's set stands in.

    What a task reads is put together some COMBINE_BYTES at a time, so that a list that very many sets stand in gets one row from each: of the sets of a
    list the least node stands for the others (held: 1; 0 if it is alone), which are known to share the list (2). A task names a set once.
    """

    def rows(key: list, node: list, lot: list, need: list) -> pa.RecordBatch:
        keys = np.concatenate(key).view(np.int64)
        each = [np.repeat(np.array(x), [len(y) for y in key]) for x in (node, lot, need)]
        order = np.lexsort((each[0], keys))
        k = keys[order]
        new = np.r_[True, k[1:] != k[:-1]]
        mark = np.where(new, 0, 2)
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        mark[first[~new]] = 1
        held = np.empty(len(k), np.int32)
        held[order] = mark  # rows stay in the order of their nodes, which compresses well
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((keys, *each, held), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["key", "node", "lot", "need", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, size = WordHashes(), set(), 0
        out: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for _, texts in text_chunks(batch):
                for s in shingles(*hash_words([t.lower() for t in texts], memo), n):
                    if not len(s) or (name := node_of(s)) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    for keys, lot, need in lists_of(s, percent):
                        for x, y in zip(out, (keys, name, lot, need)):
                            x.append(y)
                size += sum(map(len, texts))
                if size >= COMBINE_BYTES and out[0]:
                    yield rows(*out)
                    out, size = ([], [], [], []), 0
        if out[0]:
            yield rows(*out)

    return df.select("text").mapInArrow(run, LISTS + ", held int")


def shared(lists: DataFrame) -> DataFrame:
    """The rows of lists that two sets or more stand in. Rows come to a task sorted; a list is read in a stream, whatever its length.

    Rows that are known to share their list aren't gathered by it, so a list that very many sets stand in is spread over the tasks.
    """
    names = ["key", "node", "lot", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waits = (None, None), None  # the last row's key and node; the row of a list that has no second one yet
        for b in batches:
            rows = b.select(names)
            key, node, held = (column(b, c).to_numpy() for c in ("key", "node", "held"))
            if (held == 2).any():
                yield rows.filter(pa.array(held == 2))
            again = np.r_[(key[:1] == last[0]) & (node[:1] == last[1]) if last[0] is not None else np.zeros(len(key[:1]), bool), (key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (held[:-1] != 2)]
            at = np.flatnonzero((held != 2) & ~again)
            if not len(at):
                continue
            key, node, held, rows = key[at], node[at], held[at], rows.take(pa.array(at))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            full = (size > 1) | (np.maximum.reduceat(held, start) == 1)
            if key[0] == last[0]:
                full[0] = True
                if waits is not None:
                    yield waits
            keep = np.repeat(full, size)
            waits, last = None if full[-1] else rows.slice(len(key) - 1), (key[-1], node[-1])
            if keep.any():
                yield rows.filter(pa.array(keep))

    where = F.when(F.col("held") == 2, F.xxhash64("key", "node")).otherwise(F.xxhash64("key"))
    # of equal rows the one that stands for others comes first; rows that aren't gathered come after those that are
    order = [F.col("held") == 2, F.col("key"), F.col("node"), F.col("held").desc()]
    return lists.repartition(where).sortWithinPartitions(*order).mapInArrow(run, LISTS)


def set_rows(df: DataFrame, n: int) -> DataFrame:
    """(node, n, s): the set of each text, by its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for _, texts in text_chunks(batch):
                sets = shingles(*hash_words([t.lower() for t in texts], memo), n)
                values = pa.ListArray.from_arrays(pa.array(starts_of(np.array([len(s) for s in sets], np.int64)), pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, U64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), values], ["node", "n", "s"])

    return df.select("text").mapInArrow(run, "node long, n long, s array<long>")


def linked(o, na, nb, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * o >= percent * (na + nb - o)


def rooted(df: DataFrame, comp: DataFrame | None, node: str) -> DataFrame:
    """Adds `root`, the component of a column of nodes; a node without a link is its own."""
    if comp is None:
        return df.withColumn("root", F.col(node))
    return df.join(comp.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))


def weighed(lists: DataFrame) -> DataFrame:
    """Adds `weight` to each row's node: the sum of its lists' lengths, largest for the sets in the middle of many near copies."""
    length = lists.groupBy("key").agg(F.count("*").alias("length"))
    weight = lists.join(length, "key").groupBy("node").agg(F.sum("length").alias("weight"))
    return lists.join(weight, "node")


def mixed(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows of lists with members of different components, of nodes that share enough such lists; lead: a list's member of most weight."""
    own = rooted(lists, comp, "node")
    lead = own.groupBy("key").agg(F.max(F.struct("weight", "node", "root")).alias("lead"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key", "lead")
    met = own.join(lead, "key")
    enough = met.groupBy("node", "lot").agg(F.count("*").alias("c"), F.max("need").alias("least")).where("c >= least").select("node", "lot")
    return met.join(enough, ["node", "lot"], "left_semi")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, o) for pairs (a, b)."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))


def contracted(comp: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after further links (a, b)."""
    ends = rooted(links.select("a", "b"), comp, "a").withColumnRenamed("root", "ra")
    more = components(links.sparkSession, rooted(ends, comp, "b").select(F.col("ra").alias("a"), F.col("root").alias("b")))
    if comp is None:
        return more
    old = comp.withColumnRenamed("root", "was").join(more.select(F.col("node").alias("was"), "root"), "was", "left").select("node", F.coalesce("root", "was").alias("root"))
    return materialise(old.unionAll(more.join(comp, "node", "left_anti").select("node", "root")), "components")


def linked_sets(df: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (doc_id, _row, n_shingles, node), and the components (node, root) of the nodes that have a link."""
    docs = row_key(df.select("doc_id", "text"))
    named = materialise(sets_of(docs, n), "sets")
    lists = materialise(shared(postings(docs, n, percent)), "lists")
    lists = materialise(weighed(materialise(mixed(lists.withColumn("weight", F.lit(0)), None).select("key", "node", "lot", "need"), "lists")), "lists")
    sets = stored_sets(docs, named, lists.select("node").distinct(), n)
    comp, tested = None, None
    for _ in range(ROUNDS):
        met = mixed(lists, comp).where("root <> lead.root")
        pairs = met.groupBy(F.col("lead.node").alias("a"), F.col("node").alias("b"), "lot").agg(F.count("*").alias("c"), F.max("need").alias("least")).where("c >= least")
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        best = pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
        now = materialise(compared(best, sets), "tested")
        tested = now if tested is None else tested.unionAll(now)
        comp = contracted(comp, now.where(linked(F.col("o"), F.col("na"), F.col("nb"), percent)))
    found = rest(sets, rooted(mixed(lists, comp).select("node").distinct(), comp, "node"), tested, percent)
    return named, contracted(comp, found)


def stored_sets(docs: DataFrame, named: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The sets of the nodes, each from one of its rows, as a table."""
    rows = materialise(named.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_row").alias("_row")).select("_row"), "rows")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return materialise(set_rows(docs.join(rows, "_row", "left_semi"), n).dropDuplicates(["node"]), "members")


def rest(sets: DataFrame, nodes: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) between the components (root) of nodes (node, root), exactly, as a table; tested: pairs that were compared."""
    each = sets.join(nodes, "node").select("node", "root", "n", F.explode("s").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("df"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("e", "df")
    own = each.join(often, "e").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    # a partner shares least elements or more; what only this component has can't be among them
    least, reach = F.ceil(percent * F.col("n") / 100), F.size("es")
    own = own.where(reach >= least).select("node", "root", "n", reach.alias("reach"), F.posexplode(F.slice("es", F.lit(1), (reach - least + 1).cast("int"))).alias("p", "x"))
    entries = materialise(own.select(F.col("x.e").alias("e"), "node", "root", "n", (F.col("reach") - F.col("p")).alias("reach")), "entries")
    shares = entries.groupBy("e").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("e", F.ceil(F.col("c") / LIST_SHARE).cast("int").alias("shares"))
    dealt = entries.join(shares, "e")
    index = dealt.withColumn("share", F.pmod(F.xxhash64("node"), "shares").cast("int")).withColumn("probe", F.lit(False))
    probe = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("probe", F.lit(True))
    rows = index.unionByName(probe).drop("shares").repartition("e", "share").sortWithinPartitions("e", "share", "probe", "n", "node")
    pairs = rows.mapInArrow(lambda batches: met_by_position(batches, percent), "a long, b long").distinct()
    if tested is None:
        return materialise(compared(pairs, sets).where(linked(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b"), "rest")
    # a node was compared with a leader once a round: of the leaders that both ends have, all bounds hold
    side = lambda k: tested.select(F.col("b").alias(k), F.col("a").alias("l"), F.col("na").alias("nl"), F.col("nb").alias(f"n{k}"), F.col("o").alias(f"o{k}"))
    low = F.col("oa") + F.col("ob") - F.col("nl")
    high = F.least("oa", "ob") + F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
    bounds = pairs.join(side("a"), "a").join(side("b").drop("nl"), ["b", "l"])
    known = bounds.groupBy("a", "b").agg(F.max(linked(low, F.col("na"), F.col("nb"), percent)).alias("yes"), F.max(~linked(high, F.col("na"), F.col("nb"), percent)).alias("no"))
    pairs = materialise(pairs.join(known, ["a", "b"], "left"), "met")
    read = compared(pairs.where("yes is null or not (yes or no)"), sets).where(linked(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    return materialise(read.unionAll(pairs.where("yes").select("a", "b")), "rest")


def met_by_position(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of different components that a list doesn't exclude by size and position; rows (e, share, probe, n, reach, node, root) sorted, index before probes.

    Two sets of sizes n and m that share at least percent * (n + m) / (100 + percent) elements have as many left, from their first common element on:
    so a set with `reach` elements left takes partners of at most reach * (100 + percent) / percent - n elements.
    """
    own: tuple | None = None
    index: list[np.ndarray] = []
    edges = low = high = top = np.empty(0, np.int64)
    for batch in batches:
        e, share, probe, n, reach, node, root = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("e", "share", "probe", "n", "reach", "node", "root"))
        most = np.minimum(reach * (100 + percent) // percent - n, 100 * n // percent)  # the largest partner
        for a, b in zip(*stretches(e, share, probe)):
            name = (e[a], share[a])
            if name != own:
                own, index = name, []
            if not probe[a]:
                index.append(np.stack([n[a:b], most[a:b], node[a:b], root[a:b]]))
                continue
            if not index:
                continue
            held = np.concatenate(index, axis=1)
            index = [held]
            edges = np.arange(0, held.shape[1], BLOCK)
            low, high, top = held[0, edges], held[0, np.r_[edges[1:], held.shape[1]] - 1], np.maximum.reduceat(held[1], edges)
            for c in range(a, b, 256):
                p = slice(c, min(c + 256, b))
                nn, mm = n[p, None], most[p, None]
                at, blocks = np.nonzero((high * 100 >= percent * nn) & (low <= mm) & (top >= nn))
                if not len(at):
                    continue
                y = (edges[blocks][:, None] + np.arange(BLOCK)).ravel()
                x = np.repeat(at, BLOCK) + c
                x, y = x[y < held.shape[1]], y[y < held.shape[1]]
                size, past, who, part = held[:, y]
                ok = (100 * size >= percent * n[x]) & (size <= most[x]) & (past >= n[x]) & (who > node[x]) & (part != root[x])
                if ok.any():
                    pair = np.unique(np.stack([node[x][ok], who[ok]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def stretches(*keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches of rows with equal keys."""
    n = len(keys[0])
    if not n:
        return [], []
    edges = [0, *(np.flatnonzero(reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))) + 1).tolist(), n]
    return edges[:-1], edges[1:]


def join_components(df: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of (doc_id, text): n_shingles and component_id, the least doc_id that links reach, its own included.

    A row with an empty set (null or blank text) is linked with nothing: its component is its own doc_id. Equal rows, and rows with equal sets, are
    linked. A null doc_id never becomes a component's id unless no row of the component has another. Other columns are ignored.
    """
    sets, comp = linked_sets(df, n, percent)
    names = sets.where("node is not null").join(comp, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    least = names.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = comp.join(least, "root").select("node", "component_id")
    single = names.groupBy("node").agg(F.min("doc_id").alias("own"))
    final = single.join(by_node, "node", "left").select("node", F.coalesce("component_id", "own").alias("component_id"))
    out = sets.join(final, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df less near copies: of each component the row with the least doc_id stays (null ids come last); of rows with that id, one.

    Only linked rows go, whatever ids they have: rows with an empty set (null, empty or blank text) all stay. Any further columns are kept as
    they are, whatever their names; an empty table gives none.
    """
    key = fresh_name(df, "row_key")
    docs = row_key(df, key)
    sets, comp = linked_sets(df, n, percent)
    full = rooted(sets.where("node is not null"), comp, "node")
    stay = full.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("least")).select(F.col("least._row").alias(key))
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")) == 0
    one = docs.where(~blank).join(stay, key, "left_semi").dropDuplicates([key])
    return docs.where(blank).drop(key).unionByName(one.drop(key))
