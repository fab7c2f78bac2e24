"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from a rank file.

Each vocabulary entry becomes a piece of byte-mapped characters with its negative rank as score, so that
sentencepiece's best-scored merge is the lowest-ranked one. Normalisation is the identity. Pre-tokens are encoded one
by one; decoding maps ids back to the entries' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, text_chunks
from .pretokens import MemoEncoder


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def byte_chars() -> dict[int, str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(entries: list[bytes]) -> bytes:
    """A serialised model: id = rank; the unknown piece, which no text reaches, comes last."""
    chars = byte_chars()
    out = bytearray()
    for rank, entry in enumerate(entries):
        piece = "".join(chars[b] for b in entry).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(entries)
    # trainer: model_type BPE, vocab_size, unk/bos/eos/pad ids; normaliser: identity, nothing added, removed or escaped
    out += _field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class SentencePieceBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import sentencepiece

        self.entries = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.entries))
        self.table = {b: c for b, c in byte_chars().items()}
        self.memo = MemoEncoder(pattern, "tiktoken", self._encode_many)

    def _encode_many(self, pretokens: list[str]) -> Iterator[bytes]:
        mapped = [p.encode().decode("latin-1").translate(self.table) for p in pretokens]
        for ids in self.model.encode(mapped, num_threads=1):
            yield np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.memo.encode(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> SentencePieceBpe:
    """A worker's encoder; its memos serve all tasks of the worker."""
    return SentencePieceBpe(ranks_path, pattern)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of (doc_id, text): token count, digests of the ids and of the decoded bytes, and the ids if asked for.

    Null text counts as empty (no ids); repeated rows are kept; any other column is ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        decimal = [str(i) for i in range(len(bpe.entries))]
        for batch in batches:
            for part, texts in text_chunks(batch):
                out = []
                for ids in bpe.encode([t.decode() for t in texts]):
                    own = ids.tolist()
                    row = (len(own), hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest(), hashlib.sha256(bpe.decode(own)).hexdigest())
                    out.append((*row, own) if with_ids else row)
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                cols = [pa.array([r[i] for r in out], kinds[i]) for i in range(3 + with_ids)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), *cols], names[: 4 + with_ids])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select("doc_id", "text").mapInArrow(run, schema)
