"""Language-model scores from an Elias-Fano n-gram trie.

Learning counts words, which numbers them, then all windows of the order's length over the training documents, once; shorter n-grams are the windows' prefixes.
What is counted travels as packed arrays, one row a pack of text and shard. A window belongs to the shard of the pair that it starts with.
A shard is a file in the shared folder, mapped into memory to score. Its first level holds the contexts' numbers as an Elias-Fano sequence. Each further level holds,
for the entries above, monotone pointers to their successors, the successors' numbers relative to their entry as an Elias-Fano sequence, and a 16-bit quantised
log-probability for each; from the third level on also a quantised backoff weight for each entry above.
Scoring answers the n-grams of a pack of text shard by shard, level by level, by successor search within the context that the level above found.

P(w | v) = (c(v, w) + weight * P(w)) / (c(v) + weight), with P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), and P(w | u v) from P(w | v) likewise, and so on:
c / (c(context) + weight) is stored for an n-gram, weight / (c(context) + weight) for its context; the second level's sum is stored as a whole.
The end of a document is a token, and the context of its first word; no context reaches beyond it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import U64, column, mix, open_fs, scratch_path, seeded, starts_of, text_chunks

END = U64(0x5DEECE66D1CE4E5B)
#: Bits of a word's hash that are kept.
WORD_BITS = 52
#: Bytes of text from which a task packs counts at once, tokens that a shard has about, and shards that a worker keeps open.
PACK_BYTES, SHARD_TOKENS, SHARDS_HELD = 6 << 20, 1_500_000, 256
#: Range of the 16-bit codes of log10 probabilities.
FLOOR = -16.0


class EliasFano:
    """A sorted sequence of numbers in about 2 + log2(universe / n) bits each: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        """zeros, ones: how many there are before each 64 bits of the unary part, the directories for select."""
        self.n, self.low_bits, self.low, self.high, self.zeros, self.ones = n, low_bits, low, high, zeros, ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> U64(low_bits)).astype(np.int64)
        bits = np.zeros((int(universe >> low_bits) + n + 2 + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        packed = np.zeros((n * low_bits + 63) // 64 + 1, U64)
        if low_bits:
            low = values & U64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at // 64, (at % 64).astype(U64)
            np.bitwise_or.at(packed, word, low << shift)
            over = shift + U64(low_bits) > U64(64)
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (U64(64) - shift[over]))
        ones = np.bitwise_count(words).astype(np.int64)
        kind = "<u4" if 64 * len(words) < 1 << 32 else "<u8"
        return EliasFano(n, low_bits, packed, words, starts_of(64 - ones).astype(kind), starts_of(ones).astype(kind))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros, self.ones]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        word, shift = at // 64, (at % 64).astype(U64)
        out = self.low[word] >> shift
        over = shift + U64(self.low_bits) > U64(64)
        out[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return out & U64((1 << self.low_bits) - 1)

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero number k (from 0) in the unary part."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        left = k - self.zeros[word].astype(np.int64)
        x = ~self.high[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(x & U64((1 << width) - 1)).astype(np.int64)
            up = left >= ones
            left = np.where(up, left - ones, left)
            at += up * width
            x = np.where(up, x >> U64(width), x)
        return word * 64 + at

    def start_of(self, high: np.ndarray) -> np.ndarray:
        """The first index whose value has at least this high part."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        out[some] = self.select_zero(high[some] - 1) - (high[some] - 1)
        return out

    def find(self, values: np.ndarray, first: np.ndarray | None = None, past: np.ndarray | None = None) -> np.ndarray:
        """The index of each value, or -1: a successor search among the values with the same high part, from index `first` to before `past`."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high, low = (values >> U64(self.low_bits)).astype(np.int64), values & U64((1 << self.low_bits) - 1)
        # the ones after the zero that ends the high part below are the values with this high part
        at = np.zeros(len(high), np.int64)
        some = high > 0
        at[some] = self.select_zero(high[some] - 1) + 1
        a = at - high
        word, shift = at >> 6, (at & 63).astype(U64)
        x = self.high[word] >> shift
        over = (shift > 0) & (word + 1 < len(self.high))
        x[over] |= self.high[word[over] + 1] << (U64(64) - shift[over])
        ones = np.bitwise_count(x ^ (x + U64(1))).astype(np.int64) - 1
        b = a + ones
        long = np.flatnonzero(ones >= 63)
        if len(long):
            b[long] = self.start_of(high[long] + 1)
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, past)
        open_ = np.flatnonzero(a < b)
        a, b, low = a[open_], b[open_], low[open_]
        while len(open_):
            mid = (a + b) >> 1
            there = self.lows(mid)
            same = there == low
            out[open_[same]] = mid[same]
            a, b = np.where(there < low, mid + 1, a), np.where(there < low, b, mid)
            left = np.flatnonzero(~same & (a < b))
            open_, a, b, low = open_[left], a[left], b[left], low[left]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index: the unary part's one number i gives the high bits."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        left, x, at = i - self.ones[word].astype(np.int64), self.high[word], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(x & U64((1 << width) - 1)).astype(np.int64)
            up = left >= n
            left, at = np.where(up, left - n, left), at + up * width
            x = np.where(up, x >> U64(width), x)
        return ((word * 64 + at - i).astype(U64) << U64(self.low_bits)) | self.lows(i)


def save(fs, path: str, meta: dict, arrays: list[np.ndarray]) -> None:
    """A level file: its header's length, the header (JSON), then the arrays, each from a multiple of 8 bytes."""
    at, places = 0, []
    for a in arrays:
        places.append([a.dtype.str, len(a), at])
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(meta | {"arrays": places}).encode()
    head += b" " * (-len(head) % 8)
    with fs.open_output_stream(path) as out:
        out.write(struct.pack("<Q", len(head)) + head)
        for a in arrays:
            out.write(a.tobytes() + bytes(-a.nbytes % 8))


def load(fs, path: str) -> tuple[dict, list[np.ndarray]]:
    """A level file mapped into memory where the file system is a local mount, else read."""
    import pyarrow.fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    meta = json.loads(raw[8 : 8 + n].tobytes())
    base = 8 + n
    return meta, [raw[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for kind, size, at in meta["arrays"]]


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10, FLOOR, 0) / FLOOR * 65535).astype("<u2")


def dequantise(code: np.ndarray) -> np.ndarray:
    return code * (FLOOR / 65535)


# --- counting ---------------------------------------------------------------------------------------------------------


def is_held_out(doc_ids: list[int | None], folds: int = 5, fold: int = 1) -> np.ndarray:
    """Whether CRC-32 of the id as text leaves the fold's remainder; a null id is empty text."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds == fold for d in doc_ids], bool)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, ascending; all tokens (words in lower case, an end after each text's) by their place there; and tokens of each text."""
    words, counts = words_of(pa.array(texts, pa.binary()).view(pa.string()))
    held = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, held.dictionary.view(pa.binary()).to_pylist()), U64, len(held.dictionary))
    distinct, place = np.unique(np.r_[hashes, END], return_inverse=True)
    n = counts + 1
    out = np.empty(int(n.sum()), np.int64)
    ends = starts_of(n)[1:] - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = place[-1], place[held.indices.to_numpy(zero_copy_only=False)]
    return distinct, out, n


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, one after another, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, at = split.flatten(), starts_of(split.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # none at a text's ends
    return words.filter(pa.array(some)), np.diff(starts_of(some)[at])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Texts with their ids, some PACK_BYTES at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for part, own in text_chunks(batch):
            ids += column(part, "doc_id").cast(pa.int64()).to_pylist()
            texts += own
            held += sum(map(len, own))
            if held >= PACK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers packed, each in as few bytes a number as its largest needs; ascending ones as differences."""
    out = []
    for a in arrays:
        a = a.astype("<u8")
        rises = len(a) > 1 and bool((a[1:] > a[:-1]).all())
        if rises:
            a = np.r_[a[:1], np.diff(a)]
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        body = a.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        out.append(struct.pack("<BBQ", rises, width, len(body)) + body)
    return b"".join(out)


def unblob(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        rises, width, n = struct.unpack_from("<BBQ", data, at)
        full = np.zeros((n // width, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n, at + 10).reshape(-1, width)
        at += 10 + n
        a = full.view("<u8").ravel()
        out.append(np.cumsum(a, dtype=U64) if rises else a)
    return out


def summed(keys: list[np.ndarray], counts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of counts over equal keys, sorted by the keys; numbers below 2 ** bits but for the first key's, which are ranked."""
    if not len(counts):
        return keys, counts
    ranks, rank = np.unique(keys[0], return_inverse=True)
    if len(ranks).bit_length() + bits * (len(keys) - 1) <= 63:
        one = rank
        for k in keys[1:]:
            one = (one << bits) | k
        order = np.argsort(one)
        one = one[order]
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        own = one[first]
        out = []
        for _ in keys[1:]:
            out.append(own & ((1 << bits) - 1))
            own = own >> bits
        return [ranks[own], *out[::-1]], np.add.reduceat(counts[order], first)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return [k[first] for k in keys], np.add.reduceat(counts[order], first)


#: Parts that a reducer of words holds before it merges them; what it holds then is its shard's distinct words.
MERGE_PARTS = 24


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, hashes, counts) of rows (shard, data) that come sorted by shard."""

    def merge() -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)

    shard, parts = None, []
    for b in batches:
        for s, data in zip(column(b, "shard").to_pylist(), column(b, "data")):
            if s != shard and parts:
                yield shard, *merge()
                parts = []
            shard = s
            parts.append(unblob(data.as_py()))
            if len(parts) >= MERGE_PARTS:
                parts = [merge()]
    if parts:
        yield shard, *merge()


class Words:
    """The words: hashes as an Elias-Fano sequence in each shard, a range of hash values, and exact counts. A word's number is its place among all."""

    def __init__(self, folder: str, files: list[tuple[int, str, int]], shards: int, total: int, distinct: int):
        self.fs, self.root = open_fs(folder)
        files = sorted(files)
        self.files = {s: (name, i) for i, (s, name, _) in enumerate(files)}
        self.names, self.bases = [name for _, name, _ in files], starts_of(np.array([n for _, _, n in files], np.int64))
        self.shards, self.total, self.distinct = shards, total, distinct
        self.held: dict[str, tuple[EliasFano, np.ndarray]] = {}

    def shard(self, name: str) -> tuple[EliasFano, np.ndarray]:
        if name not in self.held:
            if len(self.held) >= SHARDS_HELD:
                self.held.clear()
            meta, (*parts, counts) = load(self.fs, f"{self.root}/{name}")
            self.held[name] = EliasFano(meta["n"], meta["low_bits"], *parts), counts
        return self.held[name]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of sorted distinct hashes; an unknown word has the number of the words, and 0."""
        ids, out = np.full(len(hashes), self.distinct, np.int64), np.zeros(len(hashes), np.int64)
        for s, a, b in ranges(shard_of(hashes, self.shards)):
            if s in self.files:
                name, i = self.files[s]
                ef, counts = self.shard(name)
                at = ef.find(hashes[a:b] >> U64(64 - WORD_BITS))
                ids[a:b][at >= 0] = self.bases[i] + at[at >= 0]
                out[a:b][at >= 0] = counts[at[at >= 0]]
        return ids, out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words by their numbers."""
        distinct, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        for i, a, b in ranges(np.searchsorted(self.bases, distinct, side="right") - 1):
            if i < len(self.names):
                out[a:b] = self.shard(self.names[i])[1][distinct[a:b] - self.bases[i]]
        return out[back]

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def ranges(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, past) of each stretch of equal values."""
    if len(sorted_values):
        edges = np.r_[0, np.flatnonzero(np.diff(sorted_values)) + 1, len(sorted_values)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(sorted_values[a]), a, b


def pair_shards(contexts: np.ndarray, successors: np.ndarray, context_counts: np.ndarray, shards: int, total: int) -> np.ndarray:
    """A context's pairs share a shard; those of one with more than its part of a shard's tokens are spread by the successor."""
    split = 1 + context_counts * 4 * shards // max(total, 1)
    with np.errstate(over="ignore"):
        part = seeded(successors.astype(U64), 5) % split.astype(U64)
        return (mix(contexts.astype(U64) + part * U64(0x9E3779B97F4A7C15)) % U64(shards)).astype(np.int64)


def learn_words(df: DataFrame, folder: str, shards: int) -> dict:
    """Count training words and write them; returns what Words needs. df: (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in packed(batches):
            train = [t for t, h in zip(texts, is_held_out(ids)) if not h]
            if not train:
                continue
            values, token, _ = tokens_of(train)
            n = np.bincount(token, minlength=len(values))
            out = [(s, blob(values[a:b], n[a:b])) for s, a, b in ranges(shard_of(values, shards))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["shard", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        for s, values, n in merged(batches):
            ef, name = EliasFano.build(values >> U64(64 - WORD_BITS), 1 << WORD_BITS), f"words-{s}-{uuid.uuid4().hex}"
            save(fs, f"{root}/{name}", {"n": ef.n, "low_bits": ef.low_bits}, [*ef.arrays(), narrow(n)])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([name]), pa.array([int(n.sum())], pa.int64()), pa.array([len(n)], pa.int64())], ["shard", "file", "total", "distinct"])

    parts = df.select("doc_id", "text").mapInArrow(count, "shard int, data binary")
    rows = parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, file string, total long, distinct long").collect()  # a row a shard
    return {"folder": folder, "files": [(r[0], r[1], r[3]) for r in rows], "shards": shards, "total": sum(r[2] for r in rows), "distinct": sum(r[3] for r in rows)}


def narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(next(k for k in ("u1", "<u2", "<u4", "<u8") if top < 1 << 8 * np.dtype(k).itemsize))


def nested(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted keys without repeated prefixes: for each key but the last the distinct prefixes' last numbers and how many each has of the next."""
    out, new = [], np.zeros(len(keys[0]), bool)
    lead = np.arange(len(keys[0]))
    starts = []
    for k in keys[:-1]:
        new = new | np.r_[True, k[1:] != k[:-1]]
        starts.append(np.flatnonzero(new))
    for k, own, below in zip(keys[:-1], starts, [*starts[1:], lead]):
        first = np.searchsorted(below, own)
        out += [k[own], np.diff(np.r_[first, len(below)])]
    return [*out, keys[-1]]


def flat(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The keys that nested() took."""
    out: list[np.ndarray] = []
    for k, each in zip(parts[:-1:2], parts[1::2]):
        out = [np.repeat(x, each) for x in [*out, k]]
    return [*out, parts[-1]]


def learn_grams(df: DataFrame, words: dict, shards: int, weight: float, order: int) -> dict:
    """Count the training windows of `order` tokens and write the trie's shards; returns what Trie needs.

    A window that reaches past a document's end is filled up with a number that no word has, so each token ends the first pair of one window.
    """
    folder, none = words["folder"], words["distinct"]
    bits = max(1, none.bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(**words)
        for ids, texts in packed(batches):
            train = [t for t, h in zip(texts, is_held_out(ids)) if not h]
            if not train:
                continue
            distinct, which, each = tokens_of(train)
            number, held = level.find(distinct)
            token = number[which]
            left = np.repeat(starts_of(each)[1:], each) - np.arange(len(token))  # tokens of the document from here on
            end = number[np.searchsorted(distinct, END)]
            keys = [np.r_[end, token[:-1]], token]
            for k in range(2, order):
                ahead = np.r_[token[k - 1 :], np.full(min(k - 1, len(token)), none)][: len(token)]
                keys.append(np.where(left > k - 1, ahead, none))
            keys, n = summed(keys, np.ones(len(token), np.int64), bits)
            by_id = np.argsort(number)
            shard = pair_shards(keys[0], keys[1], held[by_id][np.searchsorted(number[by_id], keys[0])], shards, words["total"])
            order_ = np.argsort(shard, kind="stable")
            out = [(s, blob(*nested([k[order_[a:b]] for k in keys]), n[order_[a:b]])) for s, a, b in ranges(shard[order_])]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["shard", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        level = Words(**words)

        def put(s: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            keys, n = summed([np.concatenate(x) for x in zip(*(p[:-1] for p in parts))], np.concatenate([p[-1] for p in parts]), bits)
            name = f"grams-{s}-{uuid.uuid4().hex}"
            save_trie(fs, f"{root}/{name}", keys, n, level, weight, none, bits)
            return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([name])], ["shard", "file"])

        shard, parts = None, []  # a shard's parts: SHARD_TOKENS windows, about
        for b in batches:
            for s, data in zip(column(b, "shard").to_pylist(), column(b, "data")):
                if s != shard and parts:
                    yield put(shard, parts)
                    parts = []
                shard = s
                *keys, n = (x.astype(np.int64) for x in unblob(data.as_py()))
                parts.append([*flat(keys), n])
        if parts:
            yield put(shard, parts)

    parts = df.select("doc_id", "text").mapInArrow(count, "shard int, data binary")
    rows = parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, file string").collect()  # a row a shard
    return {"folder": folder, "files": [(r[0], r[1]) for r in rows], "shards": shards, "weight": weight, "order": order, "none": none}


def save_trie(fs, path: str, keys: list[np.ndarray], n: np.ndarray, words: Words, weight: float, none: int, bits: int) -> None:
    """A shard's levels from its sorted windows and their counts."""
    new = np.r_[True, keys[0][1:] != keys[0][:-1]]
    contexts = keys[0][new]
    trees, arrays = [EliasFano.build(contexts.astype(U64), none + 1)], []
    above, held = np.cumsum(new) - 1, len(contexts)
    for k, key in enumerate(keys[1:], 2):
        new = new | np.r_[True, key[1:] != key[:-1]]
        lead = np.flatnonzero(new)
        count, live = np.add.reduceat(n, lead), key[lead] < none
        parent, child, count = above[lead][live], key[lead][live], count[live]
        trees.append(EliasFano.build(np.searchsorted(parent, np.arange(held + 1)).astype(U64), len(parent) + 1))
        trees.append(EliasFano.build((parent.astype(U64) << U64(bits)) | child.astype(U64), max(1, held) << bits))
        if k == 2:
            own = np.log10((count + weight * 10 ** words.log10(words.counts(child))) / (words.counts(contexts)[parent] + weight))
        else:
            whole = np.bincount(parent, count, held)
            own = np.log10(count / (whole[parent] + weight))
            arrays.append(quantise(np.log10(weight / (whole + weight))))
        arrays.append(quantise(own))
        above, held = (np.cumsum(live) - 1)[np.cumsum(new) - 1], len(parent)
    save(fs, path, {"trees": [[e.n, e.low_bits] for e in trees]}, [*(a for e in trees for a in e.arrays()), *arrays])


class Trie:
    """The shards of windows: entries by shard and place, and what is stored of them."""

    def __init__(self, folder: str, files: list[tuple[int, str]], shards: int, weight: float, order: int, none: int):
        self.fs, self.root = open_fs(folder)
        self.files, self.shards, self.weight, self.order, self.none = dict(files), shards, weight, order, none
        self.bits = U64(max(1, none.bit_length()))
        self.held: dict[int, tuple[list[EliasFano], list[np.ndarray]]] = {}

    def shard(self, s: int) -> tuple[list[EliasFano], list[np.ndarray]]:
        if s not in self.held:
            if len(self.held) >= SHARDS_HELD:
                self.held.clear()
            meta, arrays = load(self.fs, f"{self.root}/{self.files[s]}")
            trees = [EliasFano(n, low_bits, *arrays[4 * i : 4 * i + 4]) for i, (n, low_bits) in enumerate(meta["trees"])]
            self.held[s] = trees, arrays[4 * len(trees) :]
        return self.held[s]

    def successors(self, s: int, k: int, above: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Where tokens stand among the successors of entries of the level above k, sorted, of a shard, or -1."""
        trees, _ = self.shard(s)
        pointers, children = trees[2 * k - 3], trees[2 * k - 2]
        lead = np.r_[True, above[1:] != above[:-1]]
        entry, which = above[lead], np.cumsum(lead) - 1
        first, past = (pointers.get(entry + i).astype(np.int64)[which] for i in (0, 1))
        return children.find((above.astype(U64) << self.bits) | tokens.astype(U64), first, past)

    def pairs(self, contexts: np.ndarray, tokens: np.ndarray, context_counts: np.ndarray, token_log10: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P(token | context) of pairs sorted by context, and each pair's shard and place (-1: not seen)."""
        out, place = np.log10(self.weight) + token_log10 - np.log10(context_counts + self.weight), np.full(len(tokens), -1, np.int64)
        shard = pair_shards(contexts, tokens, context_counts, self.shards, total)
        known = np.flatnonzero((contexts < self.none) & (tokens < self.none))
        known = known[np.argsort(shard[known], kind="stable")]
        for s, a, b in ranges(shard[known]):
            if s not in self.files:
                continue
            own = known[a:b]
            trees, arrays = self.shard(s)
            lead = np.r_[True, contexts[own][1:] != contexts[own][:-1]]
            at = trees[0].find(contexts[own][lead].astype(U64))[np.cumsum(lead) - 1]
            own, at = own[at >= 0], at[at >= 0]
            if len(own):
                place[own] = found = self.successors(s, 2, at, tokens[own])
                out[own[found >= 0]] = dequantise(arrays[0][found[found >= 0]])
        return out, shard, place

    def extend(self, k: int, shard: np.ndarray, above: np.ndarray, tokens: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(token | entry of the level above k), log being that without the entry's first word; and the places. Rows come sorted by shard and entry."""
        out, place = log.copy(), np.full(len(tokens), -1, np.int64)
        known = np.flatnonzero(above >= 0)
        for s, a, b in ranges(shard[known]):
            own = known[a:b]
            _, arrays = self.shard(s)
            back, codes = arrays[2 * k - 5], arrays[2 * k - 4]
            place[own] = found = self.successors(s, k, above[own], tokens[own])
            p = 10 ** (dequantise(back[above[own]]) + log[own])
            seen = found >= 0
            p[seen] += 10 ** dequantise(codes[found[seen]])
            out[own] = np.log10(p)
        return out, place


def learn(df: DataFrame, weight: float = 32.0, folder: str | None = None, order: int = 2) -> dict:
    """The model of the training documents of (doc_id, text): where its files are, and its totals; order: 2 or more."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "lm")
    words = learn_words(df, folder, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return {"words": words, "grams": learn_grams(df, words, max(1, words["total"] // SHARD_TOKENS), weight, order)}


def score(df: DataFrame, model: dict) -> DataFrame:
    """Per row of (doc_id, text): the contract's counts and base score, and the model's score; null text is one end token.

    With an empty training set every count is 0 and the base is that of one unknown token. Repeated rows are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie = Words(**model["words"]), Trie(**model["grams"])
        for ids, texts in packed(batches):
            distinct, which, n = tokens_of(texts)
            number, counts = words.find(distinct)
            base = words.log10(counts)
            before = np.r_[np.searchsorted(distinct, END), which[:-1]]
            pair, pair_of = np.unique(before * np.int64(len(distinct)) + which, return_inverse=True)
            v, w = pair // len(distinct), pair % len(distinct)
            log, shard, place = trie.pairs(number[v], number[w], counts[v], base[w], words.total)
            log, shard, place = log[pair_of], shard[pair_of], place[pair_of]
            del before, pair, pair_of, v, w
            depth = np.arange(len(which)) - np.repeat(starts_of(n)[:-1], n)
            for k in range(3, trie.order + 1):
                at = np.flatnonzero(depth >= k - 2)
                at = at[(place[at - 1] >= 0) & (number[which[at]] < trie.none)]
                at = at[np.lexsort((which[at], place[at - 1], shard[at - 1]))]
                unseen = np.flatnonzero((depth >= k - 2) & (number[which] >= trie.none))  # only the backoff weight counts
                unseen = unseen[place[unseen - 1] >= 0]
                unseen = unseen[np.lexsort((place[unseen - 1], shard[unseen - 1]))]
                old, above, in_shard = log.copy(), place, shard
                place, shard = np.full(len(which), -1, np.int64), np.zeros(len(which), np.int64)
                for rows in (at, unseen):
                    log[rows], place[rows] = trie.extend(k, in_shard[rows - 1], above[rows - 1], number[which[rows]], old[rows])
                    shard[rows] = in_shard[rows - 1]
            starts = starts_of(n)[:-1]
            total = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(is_held_out(ids)), pa.array(n), pa.array(total((counts[which] > 0).astype(np.int64))), pa.array(np.full(len(ids), words.total, np.int64)), pa.array(total(base[which])), pa.array(total(log))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(df: DataFrame, weight: float = 32.0, order: int = 2) -> DataFrame:
    """Learn n-grams up to `order` (2 or more) from the training folds and score every document, the held-out ones too.

    Null ids are in the training folds by their empty text's remainder; an empty table gives none. Extra columns are ignored.
    """
    return score(df, learn(df, weight, order=order))
