"""Cuts before encoding: every code point where the libraries cut, and the same ids as theirs."""

from __future__ import annotations

import copy
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablemill.llm import bpe, packing, pretokens
from tablemill.llm.queries import MULTI_RANKS, PATTERN, RANKS, TOKENIZER
from tests.llm.reference_versions import encoding

EVERY = pretokens._all_characters()


def probes(step=1):
    """Each code point between letters, at a contraction and after white space, in texts of some hundreds."""
    marks = ("a {0}'s x", "x{0}1 {0}{0} ", " {0}\n{0}")
    chosen = [c for c in EVERY if ord(c) in pretokens.stand_ins("tiktoken")]
    rnd = random.Random(1)
    chosen += rnd.sample(EVERY, 4000) + [c for c in EVERY[:0x3100]]
    return [m.format(c) for c in chosen[::step] for m in marks]


@pytest.mark.parametrize("library", ["tiktoken", "tokenizers"])
def test_every_code_point_has_the_class_of_the_library(library):
    letters, numbers, spaces = pretokens.library_classes(library)
    table = pretokens.stand_ins(library)
    shown = EVERY.translate(table)
    assert len(shown) == len(EVERY)
    for k, own in zip(pretokens.CLASSES, (letters, numbers, spaces)):
        assert {EVERY[m.start()] for m in pretokens.regex.finditer(k, shown)} == own
    assert min(table, default=256) > 255


def test_classes_by_pre_tokenizer():
    """The classes asked of `tokenizers` are those by which its byte-level pre-tokenizer cuts, for every code point."""
    cut = Tokenizer.from_file(TOKENIZER).pre_tokenizer.pre_tokenize_str
    letters, numbers, spaces = pretokens.library_classes("tokenizers")
    plain = [c for c in EVERY if c not in letters and c not in numbers and c not in spaces]
    for some, left, right in ((letters, "x", "x"), (numbers, "1", "1"), (plain, "!", "!")):
        some = sorted(some)
        for at in range(0, len(some), 2000):
            part = some[at : at + 2000]
            assert len(cut(" ".join(left + c + right for c in part))) == len(part)


def test_ids_of_tokenizers():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    texts = probes()
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = packing.encoder(TOKENIZER, PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("ranks", [RANKS, MULTI_RANKS])
def test_ids_of_tiktoken(ranks):
    import tiktoken

    enc = encoding() if ranks == RANKS else tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks={x: i for i, x in enumerate(bpe.read_ranks(ranks))}, special_tokens={})
    texts = probes(2)
    rnd = random.Random(2)
    doubtful = [chr(c) for c in pretokens.stand_ins("tiktoken")]
    texts += ["".join(rnd.choice(["a", " ", "'s", "1", "\n", "é", rnd.choice(doubtful), chr(0x4E2D)]) for _ in range(30)) for _ in range(500)]
    assert [x.tolist() for x in bpe.encoder(ranks, PATTERN).encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_cuts_at_marks_and_line_ends():
    """Any mix of words, marks, line ends and spaces has the ids of both libraries, also while parts are forgotten."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(3)
    pieces = ["ab", "Word", "é", "Éa", "ÿ", "中", "12", "'s", "'", ".", ",", "?!", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\x1c", " ", "　", "×", "_", "<|endoftext|>"]
    texts = ["", " ", "\n", ".", "x", "x.", "x.\n", "\nx", "x\ny", " x \ny", None] + ["".join(rnd.choices(pieces, [4] * 6 + [1] * (len(pieces) - 6) if rnd.random() < 0.5 else None, k=rnd.randrange(1, 25))) for _ in range(6000)]
    tokenizer.encode_special_tokens = True
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    made = packing.encoder(TOKENIZER, PATTERN)
    small = copy.copy(made)
    small.parts = pretokens.Parts(50)
    for memo in (made, small):
        got = []
        for a in range(0, len(texts), 500):
            ids, each = memo.encode_array(pa.array([None, *texts], pa.string())[a + 1 : a + 501])
            got += [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])]
        assert [t for t, x, y in zip(texts, got, want) if x != y] == []
    assert len(small.parts.parts) <= 50
    enc, got = encoding(), bpe.encoder(RANKS, PATTERN).encode([t or "" for t in texts])
    assert [t for t, x in zip(texts, got) if x.tolist() != enc.encode_ordinary(t or "")] == []


def test_what_stands_around_line_ends_is_cut_once():
    """60 words before and after a line end are 3600 lines, of which the pattern is asked for marks and line ends alone."""
    fresh, cut = copy.copy(bpe.encoder(RANKS, PATTERN).memo), []
    find = fresh.find
    fresh.find = lambda t: cut.append(t) or find(t)
    words = ["w" + "abcdefghij"[i // 10] + "klmnopqrst"[i % 10] for i in range(60)]
    fresh.encode([f"x {a}.\n{b} y" for a in words for b in words])
    assert len(cut) < 100
