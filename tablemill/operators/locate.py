"""The best cell for a question in its retrieved tables, and the best table among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numbers import parse_number
from tablemill.functions.periods import column_period_score
from tablemill.functions.text import column_unit_penalty, label_score, strip, tokens

from . import grids
from .retrieve import top_k

#: Least row scores, plain and relaxed.
LEAST_ROW, LEAST_ROW_RELAXED = 0.25, 0.15


def cells(ir: DataFrame, tables: DataFrame, relax: bool = False) -> DataFrame:
    """Scored number cells of (qid, place, doc_id, table_idx, section, n_header_rows, col_periods, grid) rows.

    A row counts by its label, a column by its period and unit; both above their bounds. score = 0.7 row + 0.3 column, each rounded to 4 places.
    """
    q = ir.select("qid", "years", "time_point", "unit_kind", tokens(F.col("retrieval_query")).alias("qt")).where(F.size("qt") > 0)
    t = tables.where(F.size("grid") > F.greatest(F.col("n_header_rows"), F.lit(0))).join(q, "qid").withColumn("_head", grids.header_count(F.col("grid"), F.col("n_header_rows")))
    t = t.withColumn("_names", grids.flatten_header(F.col("grid"), F.col("_head")))
    period = lambda i: F.get("col_periods", i)
    columns = F.transform("_names", lambda n, i: F.struct(i.alias("col"), n.alias("col_name"), F.round(column_period_score(period(i), F.col("years"), F.col("time_point"), F.col("section"), relax) + column_unit_penalty(n, F.col("unit_kind")), 4).alias("col_score")))
    t = t.withColumn("_cols", F.filter(columns, lambda c: c["col_score"] > 0)).where(F.size("_cols") > 0)
    rows = t.select("qid", "place", "doc_id", "table_idx", "qt", "_cols", F.posexplode(grids.body(F.col("grid"), F.col("_head"))).alias("row", "r"))
    rows = rows.withColumn("x", grids.row_label(F.col("r"))).where("x is not null").withColumn("row_score", F.round(label_score(F.col("qt"), F.col("x.label")), 4))
    rows = rows.where(F.col("row_score") >= (LEAST_ROW_RELAXED if relax else LEAST_ROW)).withColumn("c", F.explode("_cols")).where("c.col <> x.label_col")
    rows = rows.withColumns({"raw": strip(F.get("r", F.col("c.col"))), "value": parse_number(F.get("r", F.col("c.col")))}).where("value is not null")
    return rows.select("qid", "place", "doc_id", "table_idx", "row", F.col("c.col").alias("col"), F.col("x.label").alias("label"), F.col("x.label_col").alias("label_col"), F.col("c.col_name").alias("col_name"), "raw", "value", "row_score", F.col("c.col_score").alias("col_score"), F.round(0.7 * F.col("row_score") + 0.3 * F.col("c.col_score"), 6).alias("score"))


def best_cells(found: DataFrame) -> DataFrame:
    """Of each question and table the best cell; of equals the first in reading order."""
    return top_k(found, 1, [F.desc("score"), F.col("row"), F.col("col")], "qid", "place")


def locate_best(ir: DataFrame, tables: DataFrame) -> DataFrame:
    """Of each question the best cell over its tables, the earlier table among equals; without one, the first table's best relaxed cell."""
    plain = top_k(best_cells(cells(ir, tables)), 1, [F.desc("score"), F.col("place")], "qid")
    rest = tables.join(plain.select("qid"), "qid", "left_anti")
    relaxed = top_k(best_cells(cells(ir, rest, relax=True)), 1, [F.col("place")], "qid")
    return plain.withColumn("relaxed", F.lit(False)).unionByName(relaxed.withColumn("relaxed", F.lit(True)))


def occurrence(cells_of_table: DataFrame) -> DataFrame:
    """Adds `nth`, from 0: which of the rows with this label a cell is in."""
    from pyspark.sql import Window

    return cells_of_table.withColumn("nth", F.dense_rank().over(Window.partitionBy("doc_id", "table_idx", "label").orderBy("row")) - 1)
