"""Media columns: a Spark data source over archives of small media files.

An archive is members one after another, then a directory (a JSON line a member: name, offset, length, CRC-32, attributes), an index of
fixed width over it (each member's offset and its line's) and a trailer that says where they start. The source plans byte ranges over the
archives from their sizes alone; the reader of a range finds the members that start in it by binary search in the index, reads their lines of the
directory and fetches each by its offset, retrying a member without touching the others. Members are read into Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import column, open_fs, scratch_path, text_chunks

#: Magic, members, starts of the directory and of the index; an index entry: the offsets of a member and of its line.
TRAILER, ENTRY = struct.Struct("<8sQQQ"), struct.Struct("<QQ")
MAGIC = b"MEDIAAR2"
WIDTH = 64
#: Bytes a planned range has, bytes an Arrow batch holds, and tries a member gets.
RANGE_BYTES, BATCH_BYTES, TRIES = 8 << 20, 8 << 20, 3


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """With zero bytes up to a positive multiple of the unit."""
    return payload + bytes(unit - len(payload) % unit if len(payload) % unit or not payload else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale PNG with the samples as pixels, row by row; lossless."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)  # each row starts with filter type 0
    raw[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """The samples of a PNG that write_png made; checks every chunk."""
    at, body, width, height = 8, [], 0, 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only filter type 0 is read")
    return raw[:, 1:].tobytes()


class ArchiveWriter:
    def __init__(self, fs: pafs.FileSystem, path: str):
        self.out, self.at, self.directory, self.offsets = fs.open_output_stream(path), 0, [], []

    def add(self, name: str, data: bytes, **attributes) -> int:
        self.directory.append(json.dumps([name, self.at, len(data), zlib.crc32(data), attributes]).encode() + b"\n")
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        lines = self.at + np.cumsum([0, *map(len, self.directory)])
        self.out.write(b"".join(self.directory))
        self.out.write(np.stack([np.array(self.offsets, "<u8"), lines[:-1].astype("<u8")], axis=1).tobytes())
        self.out.write(TRAILER.pack(MAGIC, len(self.directory), self.at, int(lines[-1])))
        self.out.close()


def read_directory(source, size: int, start: int = 0, end: int | None = None) -> list[list]:
    """The directory's entries of the members that start in [start, end); reads their lines and some entries of the index."""
    source.seek(size - TRAILER.size)
    magic, n, lines, index = TRAILER.unpack(source.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not an archive")

    def entry(i: int) -> tuple[int, int]:
        if i == n:
            return lines, index  # past the last member, and past its line
        source.seek(index + i * ENTRY.size)
        return ENTRY.unpack(source.read(ENTRY.size))

    def first(offset: int) -> int:
        """The first member that starts at the offset or later."""
        low, high = 0, n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if entry(mid)[0] < offset else (low, mid)
        return low

    a, b = first(start), n if end is None else first(end)
    if a >= b:
        return []
    begin, past = entry(a)[1], entry(b)[1]
    source.seek(begin)
    return [json.loads(x) for x in source.read(past - begin).decode().split("\n") if x]


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Store each text of (doc_id, text) as a PNG in an archive a task; returns (archive, members), for an action to run.

    A task that is repeated writes another archive; only archives that the result names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        name = f"{uuid.uuid4().hex}.arc"
        writer, n = None, 0
        for batch in batches:
            for part, texts in text_chunks(batch):
                for doc_id, text in zip(column(part, "doc_id").cast(pa.int64()).to_pylist(), texts):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        writer = ArchiveWriter(fs, f"{root}/{name}")
                    writer.add(f"{n}.png", write_png(padded(text)), doc_id=doc_id, n_bytes=len(text))
                    n += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "members"])

    return df.select("doc_id", "text").mapInArrow(run, "archive string, members long")


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.only = set(options["archives"].split(",")) - {""} if "archives" in options else None
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        fs, root = open_fs(self.folder)
        out = []
        for f in sorted(fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda f: f.path):
            if f.type == pafs.FileType.File and (self.only is None or f.base_name in self.only):
                n = max(1, -(-f.size // self.range_bytes))
                out += [Range(f.path, f.size, f.size * i // n, f.size * (i + 1) // n) for i in range(n)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_fs(self.folder)
        handle = Handle(fs, partition.path)
        try:
            held, rows = 0, []
            for name, offset, length, crc, attributes in read_directory(handle.open(), partition.size, partition.start, partition.end):
                data, error = fetch(handle, offset, length, crc)
                rows.append((partition.path.rpartition("/")[2], name, offset, attributes.get("doc_id"), attributes.get("n_bytes"), data, error))
                held += length
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    held, rows = 0, []
            if rows:
                yield _batch(rows)
        finally:
            handle.close()


class Handle:
    """An archive opened once for all members of a range; after a fault it is opened anew."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.source = fs, path, None

    def open(self):
        if self.source is None:
            self.source = self.fs.open_input_file(self.path)
        return self.source

    def close(self) -> None:
        source, self.source = self.source, None
        if source is not None:
            source.close()


def fetch(handle: Handle, offset: int, length: int, crc: int, tries: int = TRIES) -> tuple[bytes | None, str | None]:
    """One member by its offset; (None, what went wrong) after the last try."""
    error = None
    for k in range(tries):
        try:
            source = handle.open()
            source.seek(offset)
            data = source.read(length)
            if zlib.crc32(data) == crc:
                return data, None
            error = "checksum"
        except OSError as e:
            error = str(e)
        handle.close()
        if k + 1 < tries:
            time.sleep(0.05 * 2**k)
    return None, error


SCHEMA = "archive string, member string, offset long, doc_id long, n_bytes long, media binary, error string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("archives", "a.arc,b.arc").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def features(media: DataFrame, strict: bool = False) -> DataFrame:
    """Per member of the source: digests of the stored form and of the payload read back, and a feature of the samples.

    The feature is the samples' mean, standard deviation and mean step, rounded. A member that could not be read gives nulls and its error;
    strict: it fails the task, so that Spark tries it again elsewhere and no result is less than whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            out = []
            for doc_id, n, media, error in zip(*(column(b, c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error"))):
                try:
                    if media is None:
                        raise ValueError(error)
                    payload = read_png(media)
                    x = np.frombuffer(payload, np.uint8).astype(np.int64)
                    mean, var, step = x.mean(), x.var(), np.abs(np.diff(x)).mean()
                    out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), f"mean={mean:.4f};std={var**0.5:.4f};step={step:.4f}", None))
                except (ValueError, zlib.error) as e:
                    if strict:
                        raise RuntimeError(f"member of document {doc_id} could not be read: {e}") from e
                    out.append((doc_id, n, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media_columns(df: DataFrame) -> DataFrame:
    """Store the texts of (doc_id, text) as media in the shared folder, read them back through the source and compute features.

    Null text counts as empty (a payload of 64 zero bytes); repeated rows are members of their own; an empty table gives none.
    Long texts are long members, each stored and read whole. A member that cannot be read after all tries fails the query.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "media")
    names = [r[0] for r in write_archives(df, folder).collect()]  # a name a task
    spark.dataSource.register(ArchiveSource)
    return features(spark.read.format("media_archive").option("archives", ",".join(names)).load(folder), strict=True)
