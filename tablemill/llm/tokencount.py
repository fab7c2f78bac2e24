"""Token counts of flat, unindexed token files by a separator scan.

A file is little-endian token ids with an end-of-document id after each document and nothing else. Blocks of a file are
searched for that id with vector operations, each on its own; a prefix scan over the blocks' summaries numbers the documents and
joins the one that a block boundary cuts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import column, materialise, open_fs, scratch_path, text_chunks

#: Bytes a block has.
BLOCK_BYTES = 4 << 20


def write_token_files(df: DataFrame, folder: str, ranks_path: str, pattern: str, end_id: int, dtype: str = "<u2") -> DataFrame:
    """Tokenise (doc_id, text) into a flat file a task; returns (file, doc_no, doc_id), for one action to run. Null text is an empty document.

    Ids must fit the files' width: a vocabulary or end id above it is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        bpe, name, out, n = encoder(ranks_path, pattern), f"{uuid.uuid4().hex}.tok", None, 0
        if max(end_id, len(bpe.entries) - 1) > np.iinfo(dtype).max:
            raise ValueError(f"ids up to {max(end_id, len(bpe.entries) - 1)} don't fit {dtype}")
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for part, texts in text_chunks(batch):
                if out is None and texts:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                for ids in bpe.encode([t.decode() for t in texts]):
                    out.write(ids.astype(dtype).tobytes() + end)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(range(n, n + len(texts)), pa.int64()), column(part, "doc_id").cast(pa.int64())], ["file", "doc_no", "doc_id"])
                n += len(texts)
        if out is not None:
            out.close()

    return df.select("doc_id", "text").mapInArrow(run, "file string, doc_no long, doc_id long")


def plan_blocks(spark: SparkSession, folder: str, files: list[str] | None, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (file, file_no, block, start, end): whole ids, from the files' sizes alone."""
    fs, root = open_fs(folder)
    wanted = None if files is None else set(files)
    found = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File and (wanted is None or f.base_name in wanted)]
    found.sort(key=lambda f: f.path)
    step = max(width, block_bytes // width * width)
    sizes = spark.createDataFrame([(f.path, i, f.size) for i, f in enumerate(found)], "file string, file_no int, size long")
    blocks = sizes.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (size - 1) div {step})")))
    n = max(1, sum(-(-f.size // step) for f in found))
    return blocks.select("file", "file_no", "block", (F.col("block") * step).alias("start"), F.least(F.col("size"), (F.col("block") + 1) * step).alias("end")).repartition(min(n, 4096))


def separator_scan(spark: SparkSession, folder: str, end_id: int, files: list[str] | None = None, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the files: file_no, doc_no (from 0 in its file), start (its first id's index) and n_tokens (without the separator).

    Ids after a file's last separator are a document of their own; empty files and empty folders have none.
    """
    width = np.dtype(dtype).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for file, file_no, block, start, end in zip(*(column(b, c).to_pylist() for c in ("file", "file_no", "block", "start", "end"))):
                with fs.open_input_file(file) as source:
                    source.seek(start)
                    ids = np.frombuffer(source.read((end - start) // width * width), dtype)
                ends = np.flatnonzero(ids == end_id).astype(np.int64) + start // width
                yield pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([block], pa.int64()), pa.array([start // width], pa.int64()), pa.array([start // width + len(ids)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file_no", "block", "first", "past", "ends"])

    blocks = materialise(plan_blocks(spark, folder, files, width, block_bytes).mapInArrow(scan, "file_no int, block long, first long, past long, ends array<long>"), "blocks")
    # the prefix scan: what earlier blocks of the file hold, from a summary of a few numbers a block; the blocks' own ids stay where they are
    last_of = lambda n: F.when(F.col(n) > 0, F.element_at("ends", F.greatest(n, F.lit(1))))
    summary = blocks.withColumn("n", F.size("ends")).select("file_no", "block", "n", last_of("n").alias("last"))
    before = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        "file_no", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("docs_before"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open_from"),
        (F.max("block").over(Window.partitionBy("file_no")) == F.col("block")).alias("is_last"),
    )
    blocks = blocks.join(summary, ["file_no", "block"])
    tail = F.when(F.col("is_last") & (F.col("past") > F.when(F.size("ends") > 0, F.element_at("ends", F.greatest(F.size("ends"), F.lit(1))) + 1).otherwise(F.col("open_from"))), F.array("past"))
    stops = F.concat("ends", F.coalesce(tail, F.array().cast("array<long>")))
    starts = F.concat(F.array("open_from"), F.transform("ends", lambda e: e + 1))
    docs = blocks.select("file_no", "docs_before", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size(stops)).alias("a"), stops.alias("b"))).alias("k", "d"))
    return docs.select("file_no", (F.col("docs_before") + F.col("k")).alias("doc_no"), F.col("d.a").alias("start"), (F.col("d.b") - F.col("d.a")).alias("n_tokens"))


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """Write the documents as flat token files in the shared folder and count each one's tokens from the files alone.

    Per row of (doc_id, text): doc_id, from a side table by file and doc_no, and what separator_scan gives. Repeated and null ids are kept.
    Null and empty texts have no tokens; texts are encoded whole, however long; other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "tokens")
    ids = materialise(write_token_files(df, folder, ranks_path, pattern, end_id), "token-ids")
    files = sorted(r[0] for r in ids.select("file").distinct().collect())  # a name a task
    numbers = spark.createDataFrame(list(zip(files, range(len(files)))), "file string, file_no int")  # plan_blocks numbers files by path
    ids = ids.join(F.broadcast(numbers), "file").select("file_no", "doc_no", "doc_id")
    return separator_scan(spark, folder, end_id, files).join(ids.hint("merge"), ["file_no", "doc_no"]).select("doc_id", "file_no", "doc_no", "start", "n_tokens")
