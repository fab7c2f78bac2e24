"""Plain single-machine versions of the operators' contracts, to hold results against."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import re
import zlib

import public_tokenizers as P
import tiktoken

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = P.path("byte_bpe_50k.tiktoken")


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def low(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingle_set(t: str | None, n: int) -> frozenset:
    w = WORD.findall(low(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs: list[tuple[int, str | None]], window: int) -> list[tuple[int, int, int, str]]:
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept))))
    return sorted(out, key=repr)


def base_spans(t: str) -> list[tuple[int, int, str]]:
    letters = "(password|passwd|secret|token|api_?key)"
    either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", letters)
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(either + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def quality(t: str) -> tuple[int, int, int, int, int]:
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def held_out(d: int) -> bool:
    return zlib.crc32(str(d).encode()) % 5 == 1


def base_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    toks = {d: [*WORD.findall(low(t or "")), None] for d, t in docs}
    counts = collections.Counter(x for d, ts in toks.items() if not held_out(d) for x in ts)
    n, v = sum(counts.values()), len(counts)
    return {d: (held_out(d), len(ts), sum(counts[x] > 0 for x in ts), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for d, ts in toks.items()}
