"""Incremental ingestion: new report files become documents and tables as they arrive, each version of a document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablemill.sources import reports, scan


def read_stream(spark: SparkSession, folder: str, pattern: str = "*_extracted.txt", max_files: int = 10_000) -> DataFrame:
    """(path, modified, text) of files as they arrive."""
    stream = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).format("text").load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.make_valid_utf8("value").alias("text"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*_extracted.txt", max_files: int = 10_000) -> StreamingQuery:
    """Writes document rows and scanned tables of new files below `out`, a folder a batch; a batch that is repeated replaces its own part.

    Keyed state holds what was seen, a digest of a document's id and text each: the same content again, in whatever file or batch, is left out without
    a look at earlier output, and a document that changed comes in anew. `current` gives each document's last version. The state grows with the number
    of versions; on a cluster use the RocksDB state store (session() sets it).
    """

    def batch(docs: DataFrame, number: int) -> None:
        docs = docs.persist()
        try:
            docs.drop("text").write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
            reports.write_batch(docs, f"{out}/tables", number)
        finally:
            docs.unpersist()

    docs = reports.documents(read_stream(spark, folder, pattern, max_files), keep=("modified",))
    docs = docs.withColumn("digest", F.sha2(F.concat_ws("\n", F.coalesce("doc_id", F.lit("")), F.coalesce("text", F.lit(""))), 256)).dropDuplicates(["digest"])
    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The last version of each document, by its file's time, then by batch and digest, and that version's tables, described. Documents without an id all count."""
    docs = spark.read.option("basePath", f"{out}/docs").parquet(f"{out}/docs/batch=*")
    key = F.coalesce("doc_id", F.concat(F.lit("\n"), "digest"))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("modified"), F.desc("batch"), "digest"))
    docs = docs.withColumn("_n", last).where("_n = 1").drop("_n")
    rows = spark.read.schema(f"{scan.SCANNED}, batch int").option("basePath", f"{out}/tables").parquet(f"{out}/tables/batch=*").where("table_idx is not null")
    return docs, reports.described(rows.join(docs.select("digest"), "digest", "left_semi"))


def first_by_key(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key's first event within the watermark; state is dropped behind it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, window: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    """Counts by time window and keys, final once the watermark has passed a window."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")
