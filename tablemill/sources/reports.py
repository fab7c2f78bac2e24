"""Report collections: text files with page marks, headings and HTML tables, as DataFrames of documents and tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.periods import classify_period, detect_unit
from tablemill.functions.text import strip
from tablemill.operators import grids
from tablemill.sources import archives, html, scan

PAGE = r"^=====\s*PAGE\s+(\d+)\s*=====\s*$"

TABLES = (
    "doc_id string, ticker string, year int, stmt_type string, table_idx int, char_start int, char_end int, line_no int, page_no int, caption string, section string, "
    "n_rows int, n_cols int, n_header_rows int, has_ma_so boolean, unit_scale double, unit_source string, n_numeric_cells int, "
    "col_periods array<struct<period_type:string,year:int,is_begin:boolean>>, grid array<array<string>>, raw_html string"
)


def read_corpus(spark: SparkSession, folder: str, pattern: str = "*_extracted.txt") -> DataFrame:
    """(path, text) of all matching files below ticker/year/document folders; malformed bytes become U+FFFD."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text"))


def document_meta(path: Column) -> dict[str, Column]:
    """doc_id, ticker, year, … of a path …/ticker/year/document/file."""
    parts = F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/")
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    doc_id, year_dir = at(2), F.when(at(3).rlike(r"^\d+$"), at(3).try_cast("int"))
    low = F.lower(doc_id)
    kind = F.when(F.contains(low, F.lit("consolidated")), "consolidated").when(F.contains(low, F.lit("separate")), "separate").when(F.contains(low, F.lit("aggregated")), "aggregated").otherwise("other")
    year = F.when(doc_id.rlike(r"20\d{2}"), F.regexp_extract(doc_id, r"(20\d{2})", 1).try_cast("int")).otherwise(year_dir)
    return {"doc_id": doc_id, "file_stem": F.regexp_replace(at(1), r"\.txt$", ""), "ticker": at(4), "year": year, "year_dir": year_dir, "stmt_type": kind, "rel_path": F.array_join(F.slice(parts, -4, 4), "/")}


def documents(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Document rows of (path, text), with their counts of characters, pages and tables; keep: further columns that stay."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= scan.LINE_CHARS) & strip(x).rlike(PAGE))
    own = files.select(*(c.alias(k) for k, c in document_meta(F.col("path")).items()), "text", *keep)
    return own.withColumns({"n_chars": F.length("text"), "n_pages": F.size(lines), "n_tables": F.size(html.tables_in(F.col("text")))})


def tables(docs: DataFrame) -> DataFrame:
    """Table rows of (doc_id, ticker, year, stmt_type, text): position, caption, section, grid, unit and periods.

    One pass over each text and no shuffle: every row of docs gives its tables, rows with one doc_id or none too.
    """
    return described(scan.scan(docs).where("table_idx is not null"))


def described(rows: DataFrame) -> DataFrame:
    """Table rows of scanned ones."""
    return _select(describe_tables(rows))


#: What a dead letter says; a table whose HTML was read in part is among the tables too.
FAULTS = ["doc_id", "table_idx", "stage", "fault"]


def write_batch(docs: DataFrame, path: str, batch: int) -> None:
    """Tables and dead letters of a batch of documents, from one pass and with one commit: both lie in the batch's folder, told apart by a column.

    A batch that is written again replaces itself.
    """
    scan.scan(docs).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables, described, and the dead letters (doc_id, table_idx, stage, fault) of all batches."""
    rows = spark.read.schema(f"{scan.SCANNED}, batch int").option("basePath", path).parquet(f"{path}/batch=*")
    return described(rows.where("table_idx is not null")), rows.where("fault is not null").select(*FAULTS)


def describe_tables(rows: DataFrame) -> DataFrame:
    """Adds what grids say: sizes, header rows, unit and the columns' periods. rows: (grid, caption, section, year, …)."""
    g = F.col("grid")
    rows = rows.withColumn("n_header_rows", grids.header_rows(g))
    head = F.col("n_header_rows")
    rows = rows.withColumns({"n_rows": F.size(g), "n_cols": grids.n_columns(g), "_header": grids.header_text(g, head)})
    unit = detect_unit(F.col("caption"), F.col("_header"))
    periods = F.transform(grids.column_headers(g, head), lambda h: classify_period(h, F.col("year"), F.col("section")))
    return rows.withColumns({"_unit": unit, "col_periods": periods, "has_ma_so": grids.has_code_column(g, head), "n_numeric_cells": grids.n_numeric_cells(g)}).withColumns({"unit_scale": F.col("_unit.scale"), "unit_source": F.col("_unit.source")}).drop("_unit", "_header")


def _select(df: DataFrame) -> DataFrame:
    return df.select(*T._parse_datatype_string(TABLES).fieldNames())


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) from JSON lines or one JSON array, told apart by the first character; blank lines are skipped."""
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema("id int, question string").option("multiLine", array).option("mode", "DROPMALFORMED").json(path)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name) from the first two columns of a CSV file with a header; rows without a ticker go."""
    raw = spark.read.option("header", True).csv(path)
    a, b = raw.columns[:2]
    clean = lambda c: F.trim(F.regexp_replace(F.col(f"`{c}`"), "﻿", ""))
    return raw.select(clean(a).alias("ticker"), F.coalesce(clean(b), F.lit("")).alias("name")).where("ticker <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed and cut lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_evidence(spark: SparkSession, path: str, columns: list[str], numeric: list[str]) -> DataFrame:
    """An evidence file with declared types: inference would read 713.942 as a fraction."""
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Each row of (path, text) as a file below the folder, written by the tasks; the number of files.

    The folder is one that all tasks reach: a path on a mount they share, or an address of a store that Arrow knows. A task that is
    repeated writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = archives.open_fs(folder)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where = f"{root.rstrip('/')}/{path.lstrip('/')}"
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(where) as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", F.coalesce("text", F.lit(""))).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_package(spark: SparkSession, path: str, name: str = "submission.json") -> tuple[DataFrame, DataFrame]:
    """The records (JSON text, one a row) and the evidence files (file, rows) of a packaged submission; members are read by the tasks."""
    members = archives.read(spark, path)
    records = members.where(F.col("name") == name).select(F.explode(F.from_json(F.col("content").cast("string"), "array<string>")).alias("record"))
    lines = members.where(F.endswith("name", F.lit(".csv")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [list(csv.reader(io.StringIO(x.decode()))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parsed, pa.list_(pa.list_(pa.string())))], ["file", "rows"])

    return records, lines.select("name", "content").mapInArrow(rows, "file string, rows array<array<string>>")
