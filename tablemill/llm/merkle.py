"""Merkle dataset manifest: every row a leaf, a tree over each group's leaves, a tree over the groups' roots, and a proof for every row.

1. Leaves are hashed by Spark where the rows are read; from then on only digests move.
2. Digests are numbered in each group's order (common.numbered) and dealt as blocks of 2 ** k neighbours, so a large group is spread over the tasks.
   Each block is reduced to one node.
3. The nodes, at most TOP_BLOCKS and one a group, are the driver's part: it builds the levels above them, up to the root, and broadcasts
   each block's suffix path.
4. The blocks are dealt again. A task builds a block's levels, puts each row's path inside it before the suffix path, and folds each
   row's claimed leaf along the path to a root of its own.

A run of a level's nodes is two neighbours; a last node without a neighbour is hashed alone. Digests are lower-case hex text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, numbered, quoted

#: Blocks that the driver's tree has at most (besides one a group), the smallest block's height, and groups that it takes.
TOP_BLOCKS, LEAST_HEIGHT, MOST_GROUPS = 1 << 16, 12, 1 << 18

#: A path's step: the sibling's digest and whether it stands left; without a sibling the digest is None.
Step = tuple[str | None, bool]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """SHA-256 of the values one after another: `-` for a null, else its length in UTF-8 bytes, a colon and itself."""

    def shown(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.sha2(F.concat(*map(shown, values)), 256)


def parents(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """The levels from the nodes up: `height` of them, or up to a single node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append(parents(out[-1]))
    return out


def path(tree: list[list[str]], at: int) -> list[Step]:
    """The steps from a node of the lowest level to the tree's top."""
    out = []
    for nodes in tree[:-1]:
        out.append((nodes[at ^ 1] if at ^ 1 < len(nodes) else None, bool(at & 1)))
        at >>= 1
    return out


def fold(node: str, steps: list[Step]) -> str:
    for other, left in steps:
        node = digest(node if other is None else other + node if left else node + other)
    return node


def height_for(sizes: list[int]) -> int:
    """The least block height with no more than TOP_BLOCKS blocks, less the groups' last ones."""
    k = LEAST_HEIGHT
    while sum(n >> k for n in sizes) > TOP_BLOCKS:
        k += 1
    return k


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, pa.Table]]:
    """Whole blocks (group, block, rows) of a stream sorted by (group, block, place)."""
    own, held = None, []
    for b in batches:
        names = list(zip(column(b, "grp").to_pylist(), column(b, "block").to_pylist()))
        start = 0
        while start < len(names):
            end = start
            while end < len(names) and names[end] == names[start]:
                end += 1
            if own is not None and names[start] != own:
                yield *own, pa.Table.from_batches(held)
                held = []
            own = names[start]
            held.append(b.slice(start, end - start))
            start = end
    if own is not None:
        yield *own, pa.Table.from_batches(held)


def prove(rows: DataFrame) -> DataFrame:
    """rows (grp string, key long, leaf string, claim string) with subroot, root, siblings and folded_root.

    Groups' leaves ascend by key, nulls first, rows with equal keys by leaf; groups ascend by their bytes, the null group first. siblings: the digests
    beside the row's path from its leaf up to the root; a level where it has none gives none. folded_root: what the claimed leaf gives along
    that path. A group of one leaf has it as its subroot, one group has its subroot as the root; no rows give none. More than
    MOST_GROUPS groups are refused, since their tree is built by the driver.
    """
    spark = rows.sparkSession
    placed = numbered(materialise(rows.select("grp", "key", "leaf", "claim"), "leaves"), "grp", ["key", "leaf"], "place")
    sizes = {r[0]: r[1] for r in placed.groupBy("grp").agg(F.count("*")).limit(MOST_GROUPS + 1).collect()}
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"a manifest takes {MOST_GROUPS} groups at most; group by a column with fewer values")
    k = height_for(list(sizes.values()))
    dealt = placed.withColumn("block", F.shiftright("place", k).cast("int")).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
    height = {g: k if n > 1 << k else None for g, n in sizes.items()}  # a group of one block ends in its subroot

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, part in blocks(batches):
            top = levels(part["leaf"].to_pylist(), height[group])[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([block], pa.int32()), pa.array([top])], ["grp", "block", "node"])

    nodes: dict[str | None, list[tuple[int, str]]] = {}
    for group, block, node in dealt.select("grp", "block", "place", "leaf").mapInArrow(tops, "grp string, block int, node string").collect():
        nodes.setdefault(group, []).append((block, node))
    order = sorted(nodes, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x for _, x in sorted(nodes[g])]) for g in order}
    upper = levels([trees[g][-1][0] for g in order]) if order else []
    rise = {g: path(upper, i) for i, g in enumerate(order)}
    suffix = {(g, b): path(tree, b) + rise[g] for g, tree in trees.items() for b in range(len(tree[0]))}
    top = spark.sparkContext.broadcast((suffix, {g: tree[-1][0] for g, tree in trees.items()}, upper[-1][0] if upper else None))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, subroots, root = top.value
        for group, block, part in blocks(batches):
            tree, rest = levels(part["leaf"].to_pylist(), height[group]), suffixes[group, block]
            for start in range(0, len(part), 4096):
                some = part.slice(start, 4096)
                steps = [path(tree, i) + rest for i in range(start, start + len(some))]
                folded = [fold(c, s) for c, s in zip(some["claim"].to_pylist(), steps)]
                beside = [[x for x, _ in s if x is not None] for s in steps]
                n = len(some)
                own = [some[c].combine_chunks() for c in ("grp", "key", "leaf", "claim")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([subroots[group]] * n), pa.array([root] * n), pa.array(beside, pa.list_(pa.string())), pa.array(folded)], NAMES)

    return dealt.mapInArrow(finish, PROOFS)


NAMES = ["grp", "key", "leaf", "claim", "subroot", "root", "siblings", "folded_root"]
PROOFS = "grp string, key long, leaf string, claim string, subroot string, root string, siblings array<string>, folded_root string"


def manifest(df: DataFrame, fields: list[str], group: str, key: str, tampered: Column | None = None, change: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, path and fold of every row: leaves from `fields` in this order, a tree for each value of `group`, in the order of `key` (an integer).

    Where `tampered` holds, the claimed leaf is made with the columns of `change` instead; elsewhere it is the leaf itself. Nulls in any field
    count as such (a null key comes first, a null group is a group, a null `tampered` is false); empty and very long texts are hashed whole, where
    they are read; equal rows are leaves of their own with equal digests; further columns are ignored, whatever their names.
    """
    own = [quoted(c) for c in fields]
    made = leaf(own)
    claim = made if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf([(change or {}).get(c, quoted(c)) for c in fields])).otherwise(made)
    return prove(df.select(quoted(group).cast("string").alias("grp"), quoted(key).cast("long").alias("key"), made.alias("leaf"), claim.alias("claim")))


def documents_manifest(df: DataFrame) -> DataFrame:
    """The contract's columns for (doc_id, source, lang, n_chars, text): where 7 divides the CRC-32 of a row's decimal doc_id, a claim has 1 more in n_chars.

    A null n_chars stays as it is, so its claim holds; a null doc_id is never tampered with.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38, 0)") + 1
    proofs = manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", hit, {"n_chars": more})
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
