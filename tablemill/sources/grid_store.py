"""Tables laid out for point lookups: files ranged and sorted by (doc_id, table_idx), with Bloom filters on the document's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that go into the scan as a list; more are joined.
MOST_KEYS = 10_000


def save(tables: DataFrame, path: str, file_rows: int = 100_000) -> None:
    """tables (doc_id, table_idx, …) in ranges of keys; a reader skips files and row groups by their statistics and Bloom filters."""
    ranged = tables.repartitionByRange("doc_id", "table_idx").sortWithinPartitions("doc_id", "table_idx")
    writer = ranged.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", file_rows)
    writer.option("parquet.bloom.filter.enabled#doc_id", "true").option("parquet.bloom.filter.expected.ndv#doc_id", str(file_rows)).parquet(path)


def fetch(spark: SparkSession, path: str, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the tables with these keys (doc_id, table_idx), one row a key: of tables with one key the first in reading order of its columns counts.

    Up to MOST_KEYS keys are a stated list whose documents go into the scan; more keys are joined to the whole store. Keys without a table give no row.
    """
    wanted = keys.select("doc_id", "table_idx").distinct()
    stated = [r[0] for r in wanted.select("doc_id").distinct().limit(MOST_KEYS + 1).collect()]
    rows = spark.read.parquet(path).select("doc_id", "table_idx", *columns)
    if len(stated) <= MOST_KEYS:
        rows = rows.where(F.col("doc_id").isin([x for x in stated if x is not None]))
    met = rows.join(wanted, ["doc_id", "table_idx"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "table_idx").orderBy(*columns))
    return met.withColumn("_n", first).where("_n = 1").drop("_n")
