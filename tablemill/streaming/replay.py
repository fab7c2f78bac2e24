"""A table replayed as a stream: the same counts, built up by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.session import shared_path


def counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows by key, counted by a stream over the table's files with its state in the shared checkpoint folder."""
    # a stream reads folders; a table may be one file
    folder, _, file = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(2).collect()
    single = len(whole) == 1 and whole[0][0].rstrip("/").endswith(file)
    stream = reader.option("pathGlobFilter", file).parquet(folder) if single else reader.parquet(path)
    out = shared_path(spark, "replay")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.select(key).writeStream.foreachBatch(batch).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(f"{key} {schema[key].dataType.simpleString()}").option("recursiveFileLookup", True).parquet(out).groupBy(key).agg(F.count("*").alias("n"))
