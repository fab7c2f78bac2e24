"""Tables to facts: the unpivot of row labels and period columns, with units applied and concepts assigned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numbers import parse_number
from tablemill.functions.text import first_matching, norm_label, strip
from tablemill.operators import grids
from tablemill.sources import packs

FACTS = (
    "ticker string, year int, stmt_type string, doc_id string, table_idx int, statement string, adapter string, ma_so string, label string, label_norm string, concept string, "
    "period_year int, period_type string, is_begin boolean, unit_scale double, value_raw double, value double, row_idx int, col_idx int, label_col string, col_name string"
)
MAIN_STATEMENTS = ["CDKT", "KQKD", "LCTT"]


def adapter_of(ticker: Column) -> Column:
    """The accounting scheme of a company."""
    out = None
    for name, tickers in packs.ADAPTERS.items():
        out = F.when(ticker.isin(tickers), name) if out is None else out.when(ticker.isin(tickers), name)
    return out.otherwise("TT200")


def concept_of(code: Column, label_norm: Column, section: Column, adapter: Column) -> Column:
    """By line code for all but banks (leading zeros dropped first, then as it is), else by the first label pattern."""
    table = F.create_map(*[F.lit(x) for section, codes in packs.CODE_CONCEPTS.items() for c, concept in codes.items() for x in (f"{section}:{c}", concept)])
    short = F.when(F.ltrim(code, F.lit("0")) != "", F.ltrim(code, F.lit("0"))).otherwise(code)
    key = lambda c: F.concat(section, F.lit(":"), c)
    by_code = F.when(adapter != "TCTD", F.coalesce(F.try_element_at(table, key(short)), F.try_element_at(table, key(code))))
    by_label = F.when(adapter == "TCTD", first_matching(label_norm, packs.BANK_LABELS)).otherwise(first_matching(label_norm, packs.COMPANY_LABELS))
    return F.coalesce(by_code, by_label)


def extract(tables: DataFrame, sections: list[str] | None = None, least_numeric: int = 4) -> DataFrame:
    """One fact per labelled row and period column that holds a number. Sections and numeric cells are filtered before anything is exploded.

    tables: (ticker, year, stmt_type, doc_id, table_idx, section, unit_scale, n_header_rows, col_periods, grid, n_numeric_cells).
    """
    rows = tables.where(F.col("section").isin(sections or MAIN_STATEMENTS) & (F.col("n_numeric_cells") >= least_numeric) & (F.size("grid") > F.col("n_header_rows")))
    g = F.col("grid")
    rows = rows.withColumn("_head", grids.header_count(g, F.col("n_header_rows")))
    rows = rows.withColumn("_names", grids.flatten_header(g, F.col("_head")))
    rows = rows.withColumns({"_code": grids.code_column(g, F.col("_head"), F.col("_names")), "_periods": F.filter(F.transform("col_periods", lambda p, i: F.struct(i.alias("col_idx"), p.alias("p"))), lambda x: x["p"]["year"].isNotNull() & (x["col_idx"] < F.size("_names")))})
    rows = rows.where(F.size("_periods") > 0)
    keep = ["ticker", "year", "stmt_type", "doc_id", "table_idx", "section", "unit_scale", "_names", "_code", "_periods"]
    body = rows.select(*keep, F.posexplode(grids.body(g, F.col("_head"))).alias("row_idx", "row"))
    body = body.withColumn("_label", grids.row_label(F.col("row"), F.col("_code"))).where("_label is not null")
    code = F.when(F.col("_code") >= 0, strip(F.get("row", F.col("_code"))))
    body = body.withColumns({"label_norm": norm_label(F.col("_label.label")), "ma_so": F.when(code.rlike(packs.LINE_CODE), code), "adapter": adapter_of(F.col("ticker"))}).where("label_norm <> ''")
    body = body.withColumn("concept", concept_of(F.col("ma_so"), F.col("label_norm"), F.col("section"), F.col("adapter")))
    facts = body.withColumn("x", F.explode("_periods")).withColumn("value_raw", parse_number(F.get("row", F.col("x.col_idx")))).where("value_raw is not null")
    return facts.select(
        "ticker", "year", "stmt_type", "doc_id", "table_idx", F.col("section").alias("statement"), "adapter", "ma_so",
        F.left("_label.label", F.lit(200)).alias("label"), F.left("label_norm", F.lit(200)).alias("label_norm"), "concept",
        F.col("x.p.year").alias("period_year"), F.col("x.p.period_type").alias("period_type"), F.col("x.p.is_begin").alias("is_begin"),
        "unit_scale", "value_raw", (F.col("value_raw") * F.col("unit_scale")).alias("value"), "row_idx", F.col("x.col_idx").alias("col_idx"),
        F.get("_names", F.col("_label.label_col")).alias("label_col"), F.get("_names", F.col("x.col_idx")).alias("col_name"),
    )


def write(facts: DataFrame, path: str) -> None:
    """Facts by ticker, so that a question reads its companies' folders only."""
    facts.repartition("ticker").sortWithinPartitions("period_year").write.mode("overwrite").option("compression", "zstd").partitionBy("ticker").parquet(path)
