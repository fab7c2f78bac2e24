"""Stored vectors that know their model: a search with another model's vectors gives numbers, not errors, so they are checked before use.

Model and dimensions are constant columns beside each vector, which Parquet stores once a page: they can't part from their vectors as a
file beside them could, and a check reads no vector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, path: str, model: str) -> None:
    """Writes rows (id, vec)."""
    rows.select("id", "vec", F.lit(model).alias("model"), F.size("vec").alias("dims")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def usable(spark: SparkSession, path: str, model: str, n_rows: int, dims: int) -> bool:
    """Whether the path holds this many vectors of this size by this model. Vectors that name no model are judged by their shape alone."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    size = F.col("dims") if "dims" in held.columns else F.size("vec")
    by = F.col("model") if "model" in held.columns else F.lit(model)
    n, wrong = held.agg(F.count("*"), F.count_if(F.coalesce((size != dims) | (by != model), F.lit(True)))).first()
    return n == n_rows and not wrong


def load(spark: SparkSession, path: str, model: str, n_rows: int, dims: int, embed: Callable[[], DataFrame]) -> DataFrame:
    """Rows (id, vec): the stored ones if they are usable, else those of `embed`, which are stored first."""
    if not usable(spark, path, model, n_rows, dims):
        save(embed(), path, model)
    return spark.read.parquet(path).select("id", "vec")
