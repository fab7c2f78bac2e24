"""Evidence files, references, submissions and traces."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.sources import archives

from . import grids

POSITIONS = ("table_idx", "line_no", "page_no", "char_start")
DOC_SCHEMES = ("folder", "file_stem")


def doc_ref(doc_id: Column, scheme: str = "folder") -> Column:
    if scheme not in DOC_SCHEMES:
        raise ValueError(f"scheme must be one of {DOC_SCHEMES}, not {scheme!r}")
    return F.concat(doc_id, F.lit("_extracted")) if scheme == "file_stem" else doc_id


def table_ref(position: str = "line_no", scheme: str = "folder", doc_id: str = "doc_id") -> Column:
    """document|position; null without the position, so that no reference points to a line 0."""
    if position not in POSITIONS:
        raise ValueError(f"position must be one of {POSITIONS}, not {position!r}")
    return F.concat(doc_ref(F.col(doc_id), scheme), F.lit("|"), F.col(position).cast("string"))


def table_refs(scheme: str = "folder") -> Column:
    """Every encoding of a table's position, distinct, in order."""
    return F.array_distinct(F.array_compact(F.array(*(table_ref(p, scheme) for p in POSITIONS))))


def csv_name(doc_id: Column, table_idx: Column) -> Column:
    return F.format_string("%s_table_%d.csv", doc_id, table_idx)


def evidence(tables: DataFrame) -> DataFrame:
    """(doc_id, table_idx, file, columns, rows, numeric): a table as an evidence file holds it."""
    g = F.col("grid")
    some = F.size(g) > 0
    head = F.when(F.size(g) > 1, grids.header_count(g, F.col("n_header_rows"))).otherwise(0)
    t = tables.withColumn("_head", head).where(some)
    t = t.withColumns({"columns": grids.flatten_header(g, F.col("_head")), "_body": grids.body(g, F.col("_head"))})
    numeric = F.transform(grids.numeric_columns(F.col("_body"), F.size("columns")), lambda i: F.get("columns", i))
    return t.select("doc_id", "table_idx", csv_name(F.col("doc_id"), F.col("table_idx")).alias("file"), "columns", grids.evidence_rows(g, F.col("_head")).alias("rows"), numeric.alias("numeric"))


def csv_text(columns: Column, rows: Column) -> Column:
    """One string in CSV: cells with a comma, quote or line break are quoted."""
    cell = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    line = lambda r: F.array_join(F.transform(r, cell), ",")
    return F.concat(F.array_join(F.concat(F.array(line(columns)), F.transform(rows, line)), "\n"), F.lit("\n"))


def write_evidence(tables: DataFrame, path: str) -> None:
    """Evidence as a table by document, one row a file; no file a row is made at scale."""
    e = evidence(tables)
    e.select("doc_id", "file", "columns", "numeric", csv_text(F.col("columns"), F.col("rows")).alias("csv")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def records(answers: DataFrame) -> DataFrame:
    """Submission rows (id, question, answer, relevant_docs, relevant_tables, evidence, query), lists without repeats in order, sorted by id."""
    return answers.withColumns({"relevant_docs": F.array_distinct("relevant_docs"), "relevant_tables": F.array_distinct("relevant_tables")}).orderBy("id")


def unused_files(files: DataFrame, answers: DataFrame) -> DataFrame:
    """Files (file) that no answer's evidence names."""
    used = answers.select(F.explode("evidence").alias("e")).select(F.regexp_replace("e.csv_path", "^data/", "").alias("file")).distinct()
    return files.join(used, "file", "left_anti")


def validate(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(id, error) of every violation: repeated ids, answers that are no number, missing or malformed references, paths and files, blank queries."""
    one = lambda cond, text: answers.where(cond).select("id", F.lit(text).alias("error"))
    repeated = answers.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("error"))
    paths = answers.select("id", F.explode("evidence").alias("e")).select("id", F.col("e.csv_path").alias("path"))
    missing = paths.withColumn("file", F.regexp_replace("path", "^data/", "")).join(files.select("file"), "file", "left_anti").select("id", F.lit("missing file").alias("error"))
    return (
        repeated.unionByName(one(F.col("answer").isNull() | F.isnan("answer"), "answer is not a number"))
        .unionByName(one(F.coalesce(F.size("relevant_tables"), F.lit(0)) <= 0, "no tables"))
        .unionByName(one(F.exists("relevant_tables", lambda t: ~F.contains(t, F.lit("|"))), "malformed reference"))
        .unionByName(paths.where(~F.startswith("path", F.lit("data/"))).select("id", F.lit("path outside data/").alias("error")))
        .unionByName(missing)
        .unionByName(one(F.coalesce(F.trim("query"), F.lit("")) == "", "blank query"))
    )


def members(answers: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """(name, content) of a package's files: submission.json, the records as one JSON array, and data/*.csv.

    The records of one submission are put together by one task, in order of their ids: one JSON array has to be written by one hand. They are one
    for each question asked; evidence files, which are the bulk, stay where they are.
    """
    one = records(answers).select("id", F.to_json(F.struct("*")).alias("json"))
    text = one.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "json"))), lambda r: r["json"]), ", ").alias("x"))
    submission = text.select(F.lit("submission.json").alias("name"), F.encode(F.concat(F.lit("["), "x", F.lit("]")), "UTF-8").alias("content"))
    files = evidence_rows.select(F.concat(F.lit("data/"), "file").alias("name"), F.encode(csv_text(F.col("columns"), F.col("rows")), "UTF-8").alias("content"))
    return submission.unionAll(files)


def package(answers: DataFrame, evidence_rows: DataFrame, path: str, single: bool = False) -> None:
    """A package's files as ZIP archives below the path, written by the tasks and published together; single: one archive, written by one task."""
    files = members(answers, evidence_rows)
    archives.write(files.coalesce(1) if single else files, path)


def traces(df: DataFrame, key: str = "qid") -> DataFrame:
    """One JSON object a question."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("trace"))


def trace_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Questions and mean answer size by route, tier, …"""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("answer")), 4).alias("mean_abs"))


def run_metadata(config: dict, counters: DataFrame) -> str:
    """Configuration and counters (name, n) as JSON."""
    return json.dumps({"config": config, "counters": {r[0]: r[1] for r in counters.collect()}}, ensure_ascii=False, sort_keys=True)
