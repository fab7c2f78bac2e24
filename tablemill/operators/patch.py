"""Merging planner results into a submission, resuming unfinished work, and last-write-wins logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; the order must be total."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def pending(asked: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is asked and not done: a resumed run goes on with it."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def prefix_fits(local: Column, seen: Column) -> Column:
    """Whether the local evidence starts with what the planner saw; a planner that saw none is believed."""
    return seen.isNull() | (F.slice(local, F.lit(1), F.size(seen)) == seen)


def merge(base: DataFrame, patches: DataFrame, order: list[Column], tolerance: float = 0.02) -> DataFrame:
    """base (id, answer, evidence, …) with patches (id, new_answer, seen, rule_answer) put in where they are sound.

    Of an id's patches the last line counts: the first by `order`, which must be total (as [F.desc("line")]). It counts whether it is sound or not: a later
    line takes back an earlier one. base keeps its rows, one each; a patch without a base row is left out.

    Adds status (applied, mismatch, rejected, none) and conflict: an applied answer further than the tolerance from the rule's.
    """
    patches = last_write(patches, ["id"], order)
    both = base.join(patches.select("id", "new_answer", "seen", "rule_answer", F.lit(True).alias("_p")), "id", "left")
    number = F.col("new_answer").isNotNull() & ~F.isnan("new_answer") & (F.abs("new_answer") < float("inf"))
    status = F.when(F.col("_p").isNull(), "none").when(~prefix_fits(F.col("evidence"), F.col("seen")), "mismatch").when(~number, "rejected").otherwise("applied")
    both = both.withColumn("status", status)
    applied = F.col("status") == "applied"
    conflict = applied & F.col("rule_answer").isNotNull() & (F.col("rule_answer") != 0) & (F.abs(F.col("new_answer") - F.col("rule_answer")) > tolerance * F.abs("rule_answer"))
    return both.withColumns({"answer": F.when(applied, F.col("new_answer")).otherwise(F.col("answer")), "conflict": F.coalesce(conflict, F.lit(False))}).drop("new_answer", "seen", "rule_answer", "_p")


def append(df: DataFrame, path: str) -> None:
    """JSON lines, appended; readers take each id's last."""
    df.write.mode("append").json(path)
