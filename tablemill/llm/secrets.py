"""Secret scans: patterns of known shapes, and a token-efficiency test for random strings.

A string that a text vocabulary must cut into very short tokens is unlikely to be language. What stands between white space, less the marks
at its ends, is measured in characters per token, plain words by the ranks of their tokens too; known digests and identifiers are left out first.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_chunks

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Greedy runs of at least the wanted length are the greedy runs of any length less the short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What stands between white space, in ASCII; marks at its ends aren't measured.
_RUN = re.compile(r"[!-~]{8,}")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Least lengths of the runs that are measured: with both letters and digits, and others.
LEAST_MIXED, LEAST = 8, 12
#: From LEAST characters on a run that no language writes (letters with digits, or capitals inside) may have so many times the bound.
ODD_SHARE = 1.1
#: Plain words of LEAST characters or more need this much more: bits per character by the ranks of their tokens (log2 of the rank, a vocabulary's guess at
#: how rare a token is). Invented words of frequent syllables have as few characters per token as random letters have, but frequent tokens. Words that are half vowels are left to language.
WORD_BITS = 4.95
#: Digests by their hex length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and UUIDs.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})$")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
#: Identifiers: words and numbers joined by marks, such as table_12_of_34, 2021-04-03-release, a host, a path or a mail address.
_PART = r"(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+[A-Za-z]?[0-9]*)"
_IDENTIFIER = re.compile(rf"{_PART}(?:[^A-Za-z0-9]+{_PART})+$")
_LETTER, _DIGIT, _VOWEL = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]"), re.compile(r"[AEIOUaeiou]")
_PLAIN, _CAPITALS = re.compile(r"[A-Z]?[a-z]+$"), re.compile(r"[A-Z]+$")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if (":" in low or "=" in low) and any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def random_spans(text: str, unlikely, taken: list[Span]) -> list[Span]:
    """Spans of the parts of runs that none of `taken` covers and that are `unlikely`, without the marks at their ends."""
    out: list[Span] = []
    spans = sorted((a, b) for _, a, b in taken)
    k, covered = 0, 0
    for m in _RUN.finditer(text):
        parts = []
        while k < len(spans) and spans[k][0] < m.end():
            parts.append((max(m.start(), covered), spans[k][0]))
            covered = max(covered, spans[k][1])
            k += 1
        parts.append((max(m.start(), covered), m.end()))
        for a, b in parts:
            part = text[a:b] if b - a >= LEAST_MIXED else ""
            run = part.strip(_MARKS)
            if len(run) < LEAST_MIXED or run.isalpha() and (len(run) < LEAST or text[a - 1 : a].isalpha() or text[b : b + 1].isalpha()):
                continue  # letters beside other scripts' are part of a word
            if unlikely(run):
                at = a + part.index(run)
                out.append(("random", at, at + len(run)))
    return out


class Scanner:
    def __init__(self, ranks_path: str, pattern: str, chars_per_token: float):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limit = chars_per_token

    def unlikely(self, run: str) -> bool:
        """Whether a run of LEAST_MIXED ASCII characters or more is cut into tokens too short for language; digests, identifiers and numbers aren't."""
        letters = run.isalpha()
        if not letters and (not _LETTER.search(run) or _DIGEST.match(run) or _UUID.match(run) or _IDENTIFIER.match(run)):
            return False
        if len(run) < LEAST and not _DIGIT.search(run):
            return False
        ids = self.encoding.encode_ordinary(run)
        if letters and _CAPITALS.match(run):
            return len(run) < self.limit * len(ids)
        if letters and _PLAIN.match(run):
            return len(run) <= self.limit * ODD_SHARE * len(ids) and sum(math.log2(i + 1) for i in ids) >= WORD_BITS * len(run) and 2 * len(_VOWEL.findall(run)) < len(run)
        return len(run) < self.limit * (ODD_SHARE if len(run) >= LEAST else 1) * len(ids)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans; both by start, then by kind."""
        base = base_spans(text)
        every = base + random_spans(text, self.unlikely, base)
        order = lambda s: (s[1], KINDS.index(s[0]))
        return sorted(base, key=order), sorted(every, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mark: str) -> str:
    """The text with each maximal union of overlapping spans replaced by the mark."""
    out, end = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def scan(df: DataFrame, ranks_path: str, pattern: str, chars_per_token: float = 2.0) -> DataFrame:
    """Per row of (doc_id, text): counts of each kind, spans in code points and a digest of the base spans.

    Null text counts as empty (no spans); repeated rows are kept; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks_path, pattern, chars_per_token)
        for batch in batches:
            for part, texts in text_chunks(batch):
                found = [scanner.spans(t.decode()) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in e) for _, e in found], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), *counts, digest, pa.array([joined(e) for _, e in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_secrets(df: DataFrame, ranks_path: str, pattern: str, chars_per_token: float = 2.0, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by the mark; n_chars, where present, follows. Null texts stay null.

    Texts are scanned whole, one after another, however long; equal rows give equal rows; other columns stay, whatever their names; an empty table gives none.
    """

    def run(texts):
        scanner = Scanner(ranks_path, pattern, chars_per_token)
        for batch in texts:
            yield batch.map(lambda t: t if t is None else redact(t, scanner.spans(t)[1], mark))

    # a function over one column keeps any other column, whatever its type or name
    from collections.abc import Iterator as It

    import pandas as pd

    run.__annotations__ = {"texts": It[pd.Series], "return": It[pd.Series]}
    out = df.withColumn("text", F.pandas_udf(run, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out
