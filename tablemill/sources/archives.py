"""ZIP archives as a Spark data source: reads plan ranges of members from the central directory, writes are published by one commit."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Packed bytes of a range of members, and unpacked bytes of a batch of rows.
RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
SCHEMA = "archive string, name string, content binary"
MANIFEST = "_manifest.json"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and the path in it; a plain path is local."""
    scheme = urlparse(uri).scheme
    if not scheme or scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path if scheme else uri
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Members(InputPartition):
    """Neighbouring members of an archive: (name, place of the local header, packed size, method, CRC-32) each."""

    path: str
    members: list[tuple[str, int, int, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def archives(self, fs: pafs.FileSystem, root: str) -> list[str]:
        """The archive itself, or those that the folder's manifest names: what an unfinished write left is not read."""
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [root]
        with fs.open_input_stream(f"{root.rstrip('/')}/{MANIFEST}") as f:
            return [f"{root.rstrip('/')}/{name}" for name in json.loads(f.read())]

    def partitions(self) -> list[Members]:
        """Ranges of members; of each archive only the directory at its end is read."""
        fs, root = open_fs(self.path)
        out = []
        for path in self.archives(fs, root):
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for m in sorted(z.infolist(), key=lambda m: m.header_offset):
                    if m.is_dir():
                        continue
                    held.append((m.filename, m.header_offset, m.compress_size, m.compress_type, m.CRC))
                    size += m.compress_size
                    if size >= self.range_bytes:
                        out.append(Members(path, held))
                        held, size = [], 0
                if held:
                    out.append(Members(path, held))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        fs, _ = open_fs(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as f:
            for name, at, packed, method, crc in partition.members:
                rows.append((partition.path.rpartition("/")[2], name, member(f, at, packed, method, crc)))
                size += len(rows[-1][2])
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["archive", "name", "content"])


def member(f, at: int, packed: int, method: int, crc: int) -> bytes:
    """A member by its local header; stored or deflated, checked by its CRC-32."""
    f.seek(at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {at}")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    f.seek(at + 30 + n_name + n_extra)
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"packing method {method} is not read")
    if zlib.crc32(data) != crc:
        raise ValueError(f"member at {at} is damaged")
    return data


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """One archive a task, in a folder of this write; commit moves them into place and names them in a manifest, abort removes them."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.own = f"_write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(f"{root}/{self.own}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.zip"
        out, n = None, 0
        try:
            for batch in iterator:
                for member_name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                    if out is None:
                        sink = fs.open_output_stream(f"{root}/{self.own}/{name}")
                        out = zipfile.ZipFile(_Stream(sink), "w", zipfile.ZIP_DEFLATED, compresslevel=6)
                    # a fixed time, so that equal members give equal archives
                    out.writestr(zipfile.ZipInfo(member_name, (1980, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
                    n += 1
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(name if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        names = sorted(m.name for m in messages if m is not None and m.name)
        old = []
        manifest = f"{root}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                old = json.loads(f.read())
        for name in names:
            fs.move(f"{root}/{self.own}/{name}", f"{root}/{name}")
        self._clear(fs, root)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{manifest}.{self.own}") as f:
            f.write(json.dumps(names if self.overwrite else old + names).encode())
        fs.move(f"{manifest}.{self.own}", manifest)  # from here on the write counts
        for name in old if self.overwrite else []:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.own}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.own}")


class _Stream(io.RawIOBase):
    """An output stream that zipfile takes as one that can't seek."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        if not self.sink.closed:
            self.sink.flush()


class ZipSource(DataSource):
    """spark.read.format("zip_archive").load(archive or folder); df.write.format("zip_archive").save(folder) with columns name and content."""

    @classmethod
    def name(cls) -> str:
        return "zip_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of each member of an archive, or of a folder of archives that write() made."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_archive").load(path)


def write(members: DataFrame, path: str, overwrite: bool = True) -> None:
    """Members (name, content) as ZIP archives below the folder, one for each partition that has any; coalesce(1) first for a single archive."""
    members.sparkSession.dataSource.register(ZipSource)
    members.select("name", "content").write.format("zip_archive").mode("overwrite" if overwrite else "append").save(path)
