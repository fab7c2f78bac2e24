"""Merkle manifest, SimHash near copies and the conversation prefix trie against plain versions, and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablemill.llm import common, merkle, simhash, trie
from tests.llm.reference_versions import WORD, low, sha


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# --- prefix scan -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batch", [7, 10_000])
def test_numbered(spark, batch):
    rnd = random.Random(3)
    data = [(rnd.choice([None, "a", "a", "a", "a", "b"]), rnd.randrange(40), rnd.getrandbits(62)) for _ in range(3000)] + [("c", 1, 5)]
    df = common.materialise(spark.createDataFrame(data, "g string, k int, v long").repartition(5), "in")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in common.numbered(df, "g", ["k", "v"], "place", {"v": "chain"}).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for g in {x[0] for x in data}:
        h = 0
        for i, (_, k, v) in enumerate(sorted(x for x in data if x[0] == g)):
            h = (h * common.CHAIN + v) % (1 << 64)
            want.append((g, k, v, i, h - (1 << 64) if h >> 63 else h))
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- 11 ----------------------------------------------------------------------------------------------------------------


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text): the contract's columns."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda *v: sha("".join(map(show, v)))
    trees, out = {}, []

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted([(r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == g], key=lambda x: x[:3]) for g in langs}
    for g in langs:
        trees[g] = tree([x[2] for x in own[g]])
    top = tree([trees[g][-1][0] for g in langs]) if langs else []
    for j, g in enumerate(langs):
        for i, (_, _, h, r) in enumerate(own[g]):
            claim = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                claim = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            beside, x = "", claim
            for levels, at in ((trees[g], i), (top, j)):
                for nodes in levels[:-1]:
                    run = [at - at % 2, at - at % 2 + 1]
                    run = [k for k in run if k < len(nodes)]
                    x = sha("".join(x if k == at else nodes[k] for k in run))
                    beside += "".join(nodes[k] for k in run if k != at)
                    at //= 2
            out.append((r[0], h, trees[g][-1][0], top[-1][0], sha(beside), x, x == top[-1][0]))
    return sorted(out, key=repr)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def odd_rows(n=400):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "", "s", "é"]), rnd.choice([None, "", "en", "en", "en", "zz", "ü"]), rnd.choice([None, i, 0, -5, 2**63 - 1]), rnd.choice([None, "", "x" * 50_000, f"text {i} é"])) for i in range(n)]
    return [*rows, rows[3], rows[3], (None, "s", "en", 1, "no id"), (None, None, None, None, None), (7, "other", "en", 4, "same id")]


@pytest.mark.parametrize("height", [2, 5, 12])
def test_manifest_odd_rows(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "LEAST_HEIGHT", height)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], FIELDS + ", grp int, _tie string").repartition(3)
    assert rows_of(merkle.documents_manifest(df)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 9])
def test_manifest_small(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEAST_HEIGHT", 1)
    rows = [(i, "s", "en" if i != 4 else "de", i, f"t{i}") for i in range(n)]
    assert rows_of(merkle.documents_manifest(spark.createDataFrame(rows, FIELDS))) == plain_manifest(rows)


def test_manifest_table(spark, sf):
    got = entry.queries()["op11_merkle_manifest"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(got) == plain_manifest(rows)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    assert got.where(hit == F.col("verified")).count() == 0


def test_manifest_siblings_and_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i, sha(str(i)), sha(str(i))) for i in range(37)] + [("b", 1, sha("b"), sha("b"))], "grp string, key long, leaf string, claim string")
    monkeypatch.setattr(merkle, "LEAST_HEIGHT", 3)
    for r in merkle.prove(rows).collect():
        assert r["folded_root"] == r["root"] and len(r["siblings"]) <= 7
    monkeypatch.setattr(merkle, "MOST_GROUPS", 1)
    with pytest.raises(ValueError, match="groups at most"):
        merkle.prove(rows)
    assert merkle.height_for([5]) == 3 and sum(n >> merkle.height_for([10**9, 10**12]) for n in (10**9, 10**12)) <= merkle.TOP_BLOCKS


# --- 12 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(low(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    """Root of each of distinct fingerprints."""
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def plain_near_copies(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    root = plain_components(set(fps), 2)
    least = {}
    for (d, _), f in zip(docs, fps):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(docs, fps)), key=repr)


def test_near_copies_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(entry.queries()["op12_simhash_near_dedup"](spark, sf)) == plain_near_copies(docs)


def test_near_copies_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \n", "one", "ONE", "two Words", "a b c", "A B C", base, base + " more", base, "É é x y", " ".join(["a b c d"] * 30_000), "nb sp a\x0bb"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "orphan text"), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, fp int, mask string").repartition(3)
    assert rows_of(simhash.near_copies(df)) == plain_near_copies(docs)
    assert simhash.near_copies(df.limit(0)).collect() == []


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_of_crowded_blocks(spark, monkeypatch, distance):
    """Fingerprints that agree on most bits: keys run over, and no link may be lost."""
    monkeypatch.setattr(simhash, "MEMBERS", 4 if distance > 1 else 16)
    rnd = random.Random(distance)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << rnd.randrange(20) for _ in range(rnd.randrange(5))) for _ in range(120)} | {rnd.getrandbits(64) for _ in range(40)}
    fps |= {f ^ 1 << rnd.randrange(64) for f in list(fps)[:40]}
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    edges = simhash.links(spark.createDataFrame([(sign(f),) for f in fps], "fp long"), distance).collect()
    for a, b in edges:
        assert a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance * 200
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a & (1 << 64) - 1), find(b & (1 << 64) - 1)))
        root[y] = x
    want = plain_components(fps, distance)
    groups = lambda r: {frozenset(g) for g in by(r).values()}

    def by(r):
        out = collections.defaultdict(set)
        for f in fps:
            out[r(f)].add(f)
        return out

    assert groups(find) == groups(want.get)


def test_forest():
    fp = np.array([0, 1, 3, 7, 255, 8, 9], np.int64)
    key = np.array([0, 0, 0, 0, 0, 1, 1])
    a, b = simhash.forest(fp, key, 1)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 0), (3, 0), (7, 0), (9, 8)]


# --- 13 ----------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """rows (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in turns.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        made[c] = tuple((turns.get(c - c % 20, [])[:h] if c is not None else []) + own[h:])
    members = collections.defaultdict(set)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    first = lambda s: min((c for c in members[s] if c is not None), default=None)
    kids = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(WORD.findall(s[-1][1])) if s else 0
    out = []
    for s, m in members.items():
        ends = sorted((c for c in m if made[c] == s), key=lambda c: (c is not None, c))
        ids = ",".join("" if c is None else str(c) for c in ends)
        out.append((first(s), len(s), first(s[:-1]) if s else None, len(m), kids[s], leaves[s], saved[s], sha(ids)))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def some_turns(seed, convs=120, long=0):
    rnd = random.Random(seed)
    say = lambda: rnd.choice(["hi", "hello there", "a b c", "", "x y", None])
    out = []
    for c in range(convs):
        if rnd.random() < 0.1 and c % 20:
            continue
        n = rnd.choice([0, 1, 2, 3, 5, 8]) if c % 40 else 1
        for i in range(n):
            out.append((c, i, rnd.choice(["user", "user", "assistant", None]), say()))
    out += [(1000 + k, i, "user", f"long {min(i, 60)}") for k in range(3) for i in range(long)]
    return out


@pytest.mark.parametrize("members", [1, 3, 4096])
def test_trie(spark, members):
    rows = some_turns(members, long=90)
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", d int, p1 string").repartition(4), members=members)
    assert rows_of(got) == plain_trie(rows)


def test_trie_small_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "BUILD_NODES", 5)
    monkeypatch.setattr(trie, "ID_BYTES", 6)
    monkeypatch.setattr(trie, "TOP_NODES", 4)
    rows = some_turns(11)
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, TURNS), members=1)) == plain_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (None, None, None, None), (5, None, "user", "first"), (5, 0, "user", "then"), (5, 9, None, None), (25, 0, "user", "a"), (20, 1, "user", "b"), (45, 0, "user", "x " * 50_000), (45, 1, "user", "y")]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)
    one = [(33, 0, "user", "only")]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(one, TURNS))) == plain_trie(one)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_trie_repeated_rows_all_count(spark):
    rows = [(8, 0, "user", "twice"), (8, 0, "user", "twice"), (8, 1, "user", "end"), (0, 0, "user", "z")]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)


def test_trie_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(entry.queries()["op13_conversation_prefix_trie"](spark, sf)) == plain_trie(rows)


def test_louds():
    """A root with two children, the second with one."""
    depth = np.array([2, 1, 0, 1])
    name = trie.names(np.array([13, 12, 10, 11]), np.zeros(4, np.int64))
    above = trie.names(np.array([12, 10, 0, 10]), np.zeros(4, np.int64))
    t = trie.Louds(depth, name, above, np.array([False, False, True, False]))
    assert t.bits.astype(int).tolist() == [1, 0, 1, 1, 0, 0, 1, 0, 0] or t.bits.astype(int).tolist() == [1, 0, 1, 1, 0, 1, 0, 0, 0]
    assert t.order[0] == 2 and t.parent[0] == -1 and sorted(t.children().tolist()) == [0, 0, 1, 2]
    assert t.add_up(np.ones(4, np.int64))[0] == 4
    assert hashlib.sha256(b"").hexdigest() == sha("")
