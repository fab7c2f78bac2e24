"""Auditing a submission: form, execution, agreement and traceability of every reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numbers import is_close


def trace_refs(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, ref, status): ok, bad_format, bad_doc or bad_line, for rows (id, ref) against tables (doc_id, line_no)."""
    part = F.regexp_extract("ref", r"^(.*)\|([^|]*)$", 1)
    r = refs.withColumns({"doc_id": F.when(F.contains("ref", F.lit("|")), part), "line_no": F.regexp_extract("ref", r"^(.*)\|([^|]*)$", 2).try_cast("int")})
    docs = tables.select("doc_id").distinct().withColumn("_doc", F.lit(True))
    real = tables.select("doc_id", "line_no").distinct().withColumn("_line", F.lit(True))
    r = r.join(docs, "doc_id", "left").join(real, ["doc_id", "line_no"], "left")
    status = F.when(F.col("doc_id").isNull(), "bad_format").when(F.col("_doc").isNull(), "bad_doc").when(F.col("line_no").isNull(), "bad_format").when(F.col("_line").isNull(), "bad_line").otherwise("ok")
    return r.select("id", "ref", status.alias("status"))


def trace_rate(traced: DataFrame) -> DataFrame:
    return traced.agg(F.count("*").alias("n_ref"), F.count_if(F.col("status") == "bad_format").alias("bad_format"), F.count_if(F.col("status") == "bad_doc").alias("bad_doc"), F.count_if(F.col("status") == "bad_line").alias("bad_line"), F.round(F.avg((F.col("status") == "ok").cast("int")), 6).alias("ok_rate"))


def compare(answers: DataFrame, recomputed: DataFrame, relative: float = 1e-6) -> DataFrame:
    """(id, executes, matches): whether an answer's plan gives a number, and whether it is the answer."""
    both = answers.select("id", "answer").join(recomputed.select("id", F.col("value").alias("again")), "id", "left")
    return both.select("id", F.col("again").isNotNull().alias("executes"), is_close(F.col("answer"), F.col("again"), relative).alias("matches"))


def summary(form_errors: DataFrame, compared: DataFrame, traced: DataFrame) -> DataFrame:
    """One row with the four tiers' counts and whether all pass."""
    c = compared.agg(F.count("*").alias("records"), F.count_if("executes").alias("executes"), F.count_if("matches").alias("matches"))
    e = form_errors.agg(F.count("*").alias("form_errors"))
    out = c.crossJoin(e).crossJoin(trace_rate(traced))  # one row each
    return out.withColumn("passed", (F.col("form_errors") == 0) & (F.col("executes") == F.col("records")) & (F.col("matches") == F.col("records")))
