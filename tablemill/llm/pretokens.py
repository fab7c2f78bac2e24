"""Byte-level BPE of whole texts through memos: each distinct pre-token is encoded once by the tokenizer library.

Texts are cut where the library cuts them: its letters, numbers and white space are asked of it once, and characters that it takes for
something else than this package's pattern engine does (their Unicode versions differ) are cut as a stand-in of the library's class.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import starts_of

#: Entries of the memos of parts and of pre-tokens after which what was not looked up since is forgotten, and the longest key that is kept.
PART_ENTRIES, PIECE_ENTRIES, MEMO_CHARS = 500_000, 50_000, 48
#: Marks that follow words.
MARKS = ".,;:?!"


#: Classes of a pattern, and a character of each that every Unicode version has there and no pattern names; the last one is of none.
CLASSES, STAND_INS, OTHER = (r"\p{L}", r"\p{N}", r"\s"), ("\u0416", "\u0663", "\u2003"), "\u00a7"


def _all_characters() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@cache
def library_classes(library: str) -> tuple[frozenset[str], ...]:
    """The characters of each of CLASSES, as the pattern engine inside `tiktoken` or `tokenizers` has them."""
    every = _all_characters()
    if library == "tiktoken":
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        own = lambda k: bytes(tiktoken.Encoding(k, pat_str=k, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
    else:
        from tokenizers import Regex, normalizers

        own = lambda k: normalizers.Replace(Regex(f"[^{k}]+"), "").normalize_str(every)
    return tuple(frozenset(own(k)) for k in CLASSES)


@cache
def stand_ins(library: str) -> dict[int, str]:
    """For each character that the library classes otherwise than this module's engine or str methods: one of the library's class."""
    every, theirs = _all_characters(), library_classes(library)
    doubtful: set[str] = set()
    for own, k in zip(theirs, CLASSES):
        doubtful.update(own.symmetric_difference(regex.findall(k, every)))
    doubtful.update(c for c in every if c.isalpha() and c not in theirs[0])
    doubtful.update(c for c in theirs[2] if not c.isspace())
    return {ord(c): next((x for own, x in zip(theirs, STAND_INS) if c in own), OTHER) for c in doubtful}


class Memo(dict):
    """A dictionary that forgets: of two generations the elder goes when the younger is full; what is looked up is young."""

    def __init__(self, entries: int):
        self.entries = entries
        self.elder: dict = {}

    def unknown(self, keys: set) -> list:
        """The keys that neither generation has; the elder's become young."""
        new = keys.difference(self)
        elder = self.elder
        held = [k for k in new if k in elder]
        self.update([(k, elder[k]) for k in held])
        return list(new.difference(held)) if held else list(new)

    def trim(self) -> None:
        if len(self) > self.entries:
            self.elder = dict(self)
            self.clear()


#: Kinds of bytes where texts are cut.
LETTER, MARK, SPACE, NEWLINE, SHOWN = 1, 2, 4, 8, 16
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = SHOWN
KINDS[0xC3] = SHOWN  # begins U+00C0 to U+00FF
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    KINDS[_c] |= LETTER
for _c in MARKS.encode():
    KINDS[_c] |= MARK
KINDS[ord(" ")], KINDS[ord("\n")] = SPACE, NEWLINE


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, one after another, and where each text's begin; texts without nulls.

    Cut is before a space, before a mark between a letter and a space or line end, and around a line end between two shown characters.
    """
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KINDS[text]
    cut = kind == SPACE
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    cut[1:-1] |= ((kind[1:-1] & MARK) > 0) & ((kind[:-2] & LETTER) > 0) & ((kind[2:] & (SPACE | NEWLINE)) > 0)
    line = np.flatnonzero(kind[1:-1] == NEWLINE) + 1
    line = line[(kind[line - 1] & kind[line + 1] & SHOWN) > 0]
    cut[line] = cut[line + 1] = True
    begins = np.flatnonzero(cut)
    parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, len(text)].astype(np.int32)), pa.py_buffer(text))
    return parts, np.searchsorted(begins, offsets)


class Parts:
    """Parts by number and their ids, in arrays: those of all parts one after another, and how many each has.

    odd: parts that are no pre-tokens of their own, without ids.
    """

    def __init__(self, entries: int):
        self.entries, self.turn = entries, 0
        self.parts = pa.array([], pa.string())
        self.ids, self.sizes, self.odd, self.used = np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.int64)

    def rows(self, parts: pa.Array) -> np.ndarray:
        """The parts' numbers; -1: unknown."""
        return pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy(zero_copy_only=False).copy()

    def add(self, parts: list[str], ids: list[bytes | None]) -> None:
        self.parts = pa.concat_arrays([self.parts, pa.array(parts, pa.string())])
        self.odd = np.r_[self.odd, np.array([x is None for x in ids], bool)]
        self.sizes = np.r_[self.sizes, np.array([len(x or b"") // 4 for x in ids], np.int32)]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(x or b"" for x in ids), "<u4")]
        self.used = np.r_[self.used, np.full(len(parts), self.turn)]

    def look(self, rows: np.ndarray) -> None:
        self.used[rows] = self.turn

    def trim(self) -> None:
        """Of more parts than `entries`, the half looked up last stays; of this turn's, none that are too long."""
        self.turn += 1
        keep = pc.less_equal(pc.utf8_length(self.parts), MEMO_CHARS).to_numpy(zero_copy_only=False)
        if len(keep) > self.entries:
            keep = keep.copy()
            keep[np.argsort(-self.used, kind="stable")[self.entries // 2 :]] = False
        if not keep.all():
            self.ids = self.ids[np.repeat(keep, self.sizes)]
            self.parts = self.parts.filter(pa.array(keep))
            self.sizes, self.odd, self.used = self.sizes[keep], self.odd[keep], self.used[keep]


class MemoEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A pre-token starts at every space that a word or mark follows, at a mark after a word, and at a line end and the character after it between two
    shown ones; so a text can be cut there and each part looked up. A part that is a space alone, or before white space, means a space inside a run;
    its text takes the pattern itself.
    encode_many: from pre-tokens to the ids of each, as bytes; encode_parts: from parts that start with a space, for a library that cuts them itself.
    library: whose cuts are wanted, `tiktoken` or `tokenizers`.
    """

    def __init__(self, pattern: str, library: str, encode_many: Callable[[list[str]], Iterable[bytes]], encode_parts: Callable[[list[str]], Iterable[bytes]] | None = None):
        compiled = regex.compile(pattern)
        self.find, self.iterate = compiled.findall, compiled.finditer
        self.stand_ins = stand_ins(library)
        self.doubt = re.compile("[" + "".join(map(re.escape, map(chr, sorted(self.stand_ins)))) + "]").search if self.stand_ins else lambda t: None
        self.encode_many, self.encode_parts = encode_many, encode_parts
        self.parts, self.pieces = Parts(PART_ENTRIES), Memo(PIECE_ENTRIES)

    def doubtful(self, text: str) -> bool:
        """Whether a text has a character that needs a stand-in; Latin-1 has none."""
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.doubt(text) is not None
        return False

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of any text."""
        if not self.doubtful(text):
            return self.find(text)
        return [text[m.start() : m.end()] for m in self.iterate(text.translate(self.stand_ins))]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = [self.cut(t) for t in texts]
        seen = self.pieces
        new = seen.unknown(set(chain.from_iterable(split)))
        seen.update(zip(new, self.encode_many(new) if new else ()))
        out = [b"".join(map(seen.__getitem__, s)) for s in split]
        for p in new:
            if len(p) > MEMO_CHARS:
                del seen[p]
        seen.trim()
        return out

    def _learn(self, parts: list[str]) -> None:
        """Take up parts, in this order."""
        some = self.doubtful("".join(parts))
        odd = {p for p in parts if (p[0] == " " and (len(p) == 1 or p[1].isspace())) or (some and self.doubtful(p))}
        ids: dict[str, bytes | None] = dict.fromkeys(odd)
        sure = [p for p in parts if p not in odd] if odd else parts
        if self.encode_parts is not None:
            one, rest = [p for p in sure if p[0] == " "], [p for p in sure if p[0] != " "]
            ids.update(zip(one, self.encode_parts(one) if one else ()))
            ids.update(zip(rest, self.encode_many(rest) if rest else ()))
        else:  # most parts are a pre-token
            one, rest = [], []
            for p in sure:
                (one if (p[1:] if p[0] == " " else p).isalpha() else rest).append(p)
            ids.update(zip(one, self.encode_many(one) if one else ()))
            ids.update(zip(rest, self._pieces(rest)))
        self.parts.add(parts, [ids[p] for p in parts])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has; null is empty.

        Parts are told apart where they lie in the array; only those that are not known become strings.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts, at = parts_of(texts)
        if not len(parts):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        held, known = parts.dictionary_encode(), self.parts
        row = known.rows(held.dictionary)
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(known.parts) + np.arange(len(new))
            self._learn(held.dictionary.take(pa.array(new)).to_pylist())
        known.look(row)
        place = row[held.indices.to_numpy(zero_copy_only=False)]
        sizes, starts, store = known.sizes, starts_of(known.sizes)[:-1], known.ids
        apart = np.unique(np.searchsorted(at, np.flatnonzero(known.odd[place]), side="right") - 1) if known.odd.any() else np.empty(0, np.int64)
        if len(apart):  # cut as a whole
            own = self._pieces(texts.take(pa.array(apart)).to_pylist())
            place = np.where(np.isin(np.repeat(np.arange(len(texts)), np.diff(at)), apart), len(sizes) + len(apart), place)
            place[at[apart]] = len(sizes) + np.arange(len(apart))
            sizes = np.r_[sizes, np.array([len(x) // 4 for x in own], np.int32), np.zeros(1, np.int32)]
            store = np.r_[store, np.frombuffer(b"".join(own), "<u4")]
            starts = starts_of(sizes)[:-1]
        size = sizes[place]
        ends = starts_of(size)
        source = np.repeat((starts[place] - ends[:-1]).astype(np.int32), size)
        source += np.arange(len(source), dtype=np.int32)
        known.trim()
        return store[source], np.diff(ends[at])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, each = self.encode_array(pa.array(texts, pa.string()))
        at = starts_of(each).tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
