"""A planner model's batch loop: which questions it is asked, attempts by temperature, raw answers stored before any is judged, resuming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from .patch import pending
from .prompts import check_code, fenced

# Operations, units of answers and the least tier that make a question hard.
HARD_OPS = ("RATIO", "GROWTH", "MEDIAN", "CONDITIONAL", "COUNT", "AVERAGE", "SUPERLATIVE")
HARD_UNITS = ("percent", "pp", "times", "year", "count")
HARD_TIER = 3
# Temperatures of an answer's attempts, and prompts that the model is given at once.
TEMPERATURES = (0.0, 0.35, 0.35)
PROMPTS_AT_ONCE = 128

#: From prompts and a temperature to answers.
Model = Callable[[list[str], float], list[str]]


def in_scope(ops: Column, unit_kind: Column, tier: Column, scope: str = "all") -> Column:
    """Whether the planner is asked: every question, or the hard ones by operation, unit or tier. Nulls make no question hard."""
    if scope not in ("all", "hard"):
        raise ValueError(f"scope must be all or hard, not {scope!r}")
    hard = F.lit(False)
    for rule in (F.arrays_overlap(ops, F.array(*map(F.lit, HARD_OPS))), unit_kind.isin(*HARD_UNITS), tier >= HARD_TIER):
        hard = hard | F.coalesce(rule, F.lit(False))
    return F.lit(True) if scope == "all" else hard


def generate(asked: DataFrame, model: Callable[[], Model], temperature: float, attempt: int, at_once: int = PROMPTS_AT_ONCE) -> DataFrame:
    """(id, attempt, raw) for rows (id, prompt); the hook loads its model once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = model()
        for b in batches:
            for k in range(0, len(b), at_once):
                part = b.iloc[k : k + at_once]
                yield pd.DataFrame({"id": part["id"], "attempt": attempt, "raw": list(answer(part["prompt"].tolist(), temperature))})

    return asked.select("id", "prompt").mapInPandas(run, _logged(asked))


def _logged(asked: DataFrame) -> StructType:
    return StructType([asked.schema["id"]]).add("attempt", IntegerType()).add("raw", StringType())


def judged(raw: DataFrame) -> DataFrame:
    """Adds code, ok, form and reason: the first fenced block of each raw answer under the guard; nothing is run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [check_code(c) for c in b.pop("_code")]
            yield b.assign(code=[c.code for c in seen], ok=[c.ok for c in seen], form=[c.form for c in seen], reason=[c.reason for c in seen])

    schema = StructType(list(raw.schema)).add("code", StringType()).add("ok", BooleanType()).add("form", StringType()).add("reason", StringType())
    return raw.withColumn("_code", fenced(F.col("raw"))).mapInPandas(run, schema)


def plan(asked: DataFrame, model: Callable[[], Model], log: str, temperatures: tuple[float, ...] = TEMPERATURES, seconds: float | None = None) -> DataFrame:
    """(id, attempt, raw, code, ok, form, reason) of each answered row (id, prompt): its first accepted attempt, else its last.

    Attempts go on for what no earlier one settled. Each one's raw answers are in the table `log` before any is judged, so a later call
    goes on where one stopped, and `seconds` only keeps it from starting another attempt. Ids must differ; null ids are not asked.
    """
    spark, began = asked.sparkSession, time.monotonic()
    asked = asked.where("id is not null")
    schema = _logged(asked)
    spark.createDataFrame([], schema).write.mode("append").parquet(log)
    read = lambda: spark.read.schema(schema).parquet(log)
    for attempt, temperature in enumerate(temperatures):
        if seconds is not None and time.monotonic() - began > seconds:
            break
        held = read()
        todo = pending(pending(asked, judged(held).where("ok")), held.where(F.col("attempt") >= attempt))
        generate(todo, model, temperature, attempt).write.mode("append").parquet(log)
    order = [F.desc("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt"))]
    best = judged(read()).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return best.where("_n = 1").drop("_n").join(asked.select("id"), "id", "left_semi")
