"""The engine's registered queries over the driver tables, each with the SQL that must give the same rows.

A query that has no SQL form over the tables compares its results with stated values.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import suppress

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.functions import numbers, periods, text, vectors
from tablemill.operators import blockmax, bm25, companies, documents, emit, facts, grids, locate, lookup, patch, phrases, planner, probes, prompts, quality, questions, retrieve, solve, verify
from tablemill.operators import vectors as vector_search
from tablemill.plans import ir as plan_ir
from tablemill.session import shared_path, store
from tablemill.sources import grid_store, html, matrices, packs, reports, scan, statements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + v.replace("'", "''") + "'"


_DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


#: What a case's texts may name of the part that it is dealt to: a year and the one before, a number of three digits and one of two, and its name as it
#: is (two lower-case words), in capitals and as a slug.
_FILL = {
    "{y}": (lambda: (F.lit(2011) + F.col("p_size") % 14).cast("string"), "CAST(2011 + p_size % 14 AS VARCHAR)"),
    "{p}": (lambda: (F.lit(2010) + F.col("p_size") % 14).cast("string"), "CAST(2010 + p_size % 14 AS VARCHAR)"),
    "{n}": (lambda: (F.lit(100) + F.col("p_partkey") % 900).cast("string"), "CAST(100 + p_partkey % 900 AS VARCHAR)"),
    "{m}": (lambda: (F.lit(10) + F.col("p_partkey") % 90).cast("string"), "CAST(10 + p_partkey % 90 AS VARCHAR)"),
    "{w}": (lambda: F.col("p_name"), "p_name"),
    "{W}": (lambda: F.upper("p_name"), "upper(p_name)"),
    "{s}": (lambda: F.translate("p_name", " ", "_"), "replace(p_name, ' ', '_')"),
}


def _deal(spark: SparkSession, sf_dir: str, schema: str, cases: list[tuple]) -> DataFrame:
    """Parts (p_partkey) with the inputs (schema) of the case that each is dealt to, filled in from the part."""
    inputs = [x.split() for x in schema.split(", ")]
    text_of = lambda v: None if v is None else str(v)
    dealt = spark.createDataFrame([(i, *map(text_of, c)) for i, c in enumerate(cases)], ", ".join(["case_no long", *(f"`{n}` string" for n, _ in inputs)]))
    parts = table(spark, sf_dir, "part").withColumn("case_no", F.col("p_partkey") % len(cases))
    rows = parts.join(F.broadcast(dealt), "case_no")  # the stated cases

    def filled(name: str) -> Column:
        out = F.col(f"`{name}`")
        for mark, (make, _) in _FILL.items():
            out = F.replace(out, F.lit(mark), make())
        return out

    return rows.select("p_partkey", *(filled(n).cast(t).alias(n) for n, t in inputs))


def _dealt_sql(cases: list[tuple], out: dict[str, str]) -> str:
    """The outputs (name: type) of the case that each part is dealt to."""
    shown = lambda v: _literal(v if v is None else str(v))
    rows = ", ".join("(" + ", ".join([str(i), *map(shown, c)]) + ")" for i, c in enumerate(cases))

    def filled(name: str) -> str:
        text_ = name
        for mark, (_, made) in _FILL.items():
            text_ = f"replace({text_}, '{mark}', {made})"
        return text_

    cols = ", ".join(f"CAST({filled(k)} AS {_DUCK[t]}) AS {k}" for k, t in out.items())
    return f"SELECT p_partkey, {cols} FROM part JOIN (VALUES {rows}) AS v(case_no, {', '.join(out)}) ON case_no = p_partkey % {len(cases)}"


def golden(name: str, schema: str, cases: list[tuple], out: dict[str, str], build: Callable[[DataFrame], dict[str, Column]]) -> None:
    """Registers a query over all parts: each is dealt one case, whose inputs (schema) and wanted outputs (name: type) are filled in from the part."""
    n = len(schema.split(","))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _deal(spark, sf_dir, schema, [c[:n] for c in cases])
        made = build(df)
        return df.select("p_partkey", *(made[k].cast(t).alias(k) for k, t in out.items()))

    QUERIES[name] = run
    SQL[name] = _dealt_sql([c[n:] for c in cases], out)


# --- text and numbers --------------------------------------------------------------------------------------------------

FOLD = "upper(replace(trim(regexp_replace(strip_accents({0}), '\\s+', ' ', 'g')), 'ß', 'ss'))"


@query(f"SELECT doc_id, CAST(length({FOLD.format('text')}) AS INTEGER) AS n, md5({FOLD.format('text')}) AS folded_md5 FROM documents")
def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("f"))
    return d.select("doc_id", F.length("f").alias("n"), F.md5("f").alias("folded_md5"))


TOKENS = f"regexp_extract_all({FOLD}, '[A-Z0-9]+')"


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokens_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("SELECT c_custkey, CAST(floor(c_acctbal) AS DOUBLE) AS value FROM customer")
def parse_number_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.parse_number(statements.money(F.floor("c_acctbal"))).alias("value"))


golden(
    "parse_number_truth", "raw string",
    [("{n}.{n}.{n}", "{n}{n}{n}"), ("{n}.942", "{n}942"), ("({n}.105.381)", "-{n}105381"), ("1.{n},56", "1{n}.56"), ("1,{n}.56", "1{n}.56"), ("4,{m}", "4.{m}"), ("1{n}.567", "1{n}.567"), ("1.{m}.4", "1.{m}4"), (".{m}", None), ("{m}%", "{m}"), ("31/12/{y}", None), ("1.1.{y}", None), ("{n}a", None), ("(-{m})", "-{m}"), ("- {m}", "-{m}"), ("{m}.", "{m}"), ("0.{n}", "{n}"), ("-", None), ("", None), (None, None), ("  {m} {n} ", "{m}{n}"), ("{w}", None), ("+{m}", "{m}"), ("()", None), ("%", None), ("1,{m},3", "1.{m}3")],
    {"value": "double"}, lambda d: {"value": numbers.parse_number(d["raw"])},
)
golden(
    "norm_label", "label string",
    [("A. {w}", "{W}"), ("13. {w}", "{W}"), ("A. I. 1. {w}", "{W}"), ("(a) {w}", "{W}"), ("- {w}", "{W}"), ("{w} (TM 5)", "{W}"), ("  Lợi nhuận  {w}:", "LOI NHUAN {W}"), (None, "")],
    {"normal": "string"}, lambda d: {"normal": text.norm_label(d["label"])},
)
golden(
    "slug_headers", "name string",
    [("Tại ngày 31.12.{y} Triệu VND", "tai_ngay_31_12_{y}_trieu_vnd"), ("  Mã số {w} ", "ma_so_{s}"), ("***", ""), ("Đơn vị {n}", "don_vi_{n}"), ("{n}" + "x" * 60, "{n}" + "x" * 45)],
    {"slug": "string"}, lambda d: {"slug": text.slug(d["name"])},
)
golden(
    "label_score", "query string, label string",
    [("{W} THUAN", "{w} thuần", 0.85), ("{W} NGAN HAN", "{w} dài hạn", 0.0), ("{W}", "", 0.0), ("{W}", "Chi phí", 0.0)],
    {"score": "double"}, lambda d: {"score": F.round(text.label_score(F.split(d["query"], " "), d["label"]), 4)},
)
golden(
    "column_unit_penalty", "name string, kind string",
    [("thuyet_minh_{n}", "vnd", -0.5), ("so_co_phieu_{y}", "vnd", -0.45), ("ty_le_{y}", "usd", -0.35), ("nam_{y}", "vnd", 0.0), ("so_luong_{y}", "shares", 0.25), ("nam_{y}", "shares", -0.25), ("ty_le_{y}", "percent", 0.2), ("gia_{n}", "times", 0.0)],
    {"penalty": "double"}, lambda d: {"penalty": text.column_unit_penalty(d["name"], d["kind"])},
)

# --- structure ---------------------------------------------------------------------------------------------------------


#: Artefacts of this application: where each was stored.
_STORED: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An artefact that later stages start from, built and stored by the first query of an application that needs it, and again if it is gone.

    Queries that are about a stage itself build their own.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STORED:
        with suppress(AnalysisException):
            return spark.read.parquet(_STORED[key])
    path = shared_path(spark, name)
    build().write.option("compression", "zstd").parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.documents(_once(spark, sf_dir, "reports", lambda: statements.render(spark, sf_dir)))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "tables", lambda: reports.tables(_docs(spark, sf_dir)))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "facts", lambda: facts.extract(_tables(spark, sf_dir)))


_DOCS_SQL = f"WITH {statements.TRUTH_SQL}, docs AS (SELECT t.*, ticker || '_' || CAST(year AS VARCHAR) || '_consolidated' AS doc_id, EXISTS (SELECT 1 FROM truth p WHERE p.ticker = t.ticker AND p.year = t.year - 1) AS has_last FROM truth t)"


@query(_DOCS_SQL + " SELECT doc_id, ticker, year, 'consolidated' AS stmt_type, CAST(2 AS INTEGER) AS n_pages, CAST(2 AS INTEGER) AS n_tables FROM docs")
def document_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "ticker", "year", "stmt_type", "n_pages", "n_tables")


@query(_DOCS_SQL + """ SELECT doc_id, CAST(x.i AS INTEGER) AS table_idx, CAST(x.l AS INTEGER) AS line_no, CAST(x.i AS INTEGER) AS page_no, x.s AS section, x.c AS caption, CAST(1.0 AS DOUBLE) AS unit_scale, 'caption' AS unit_source
FROM docs, (VALUES (1, 6, 'CDKT', 'BẢNG CÂN ĐỐI KẾ TOÁN | Mẫu số B 01 – DN | Đơn vị tính: VND'), (2, 10, 'KQKD', 'Đơn vị tính: VND | BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH | Đơn vị tính: VND')) AS x(i, l, s, c)""")
def html_table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tables(_docs(spark, sf_dir)).select("doc_id", "table_idx", "line_no", "page_no", "section", "caption", "unit_scale", "unit_source")


@query(_DOCS_SQL + " SELECT doc_id, CAST(x.i AS INTEGER) AS table_idx, CAST(x.n + 1 AS INTEGER) AS n_rows, CAST(4 AS INTEGER) AS n_cols, CAST(1 AS INTEGER) AS n_header_rows, true AS has_ma_so, CAST(CASE WHEN has_last THEN 3 ELSE 2 END * x.n AS INTEGER) AS n_numeric_cells FROM docs, (VALUES (1, 6), (2, 4)) AS x(i, n)")
def grid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", "table_idx", "n_rows", "n_cols", "n_header_rows", "has_ma_so", "n_numeric_cells")


#: Pages as documents: an odd page is twice its own document (same id, other text), every third has no id, every seventh has markup that no parser reads, every eleventh no text.
_PAGES_SQL = """p AS (SELECT page_id, page_id % 3 = 0 AS nameless, page_id % 7 = 0 AS broken, page_id % 11 = 0 AS textless, length(html) AS n, length(html) - length(replace(html, chr(10), '')) AS breaks FROM pages),
c AS (SELECT *, 1 AS part FROM p UNION ALL SELECT *, 2 FROM p WHERE page_id % 2 = 1)"""


def _page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    copies = p.select("*", F.explode(F.when(F.col("page_id") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("part"))
    cell = F.when(F.col("page_id") % 7 == 0, F.lit("<![foo[")).otherwise(F.lit("Doanh thu"))
    made = F.concat(F.lit("===== PAGE "), (F.col("page_id") + F.col("part")).cast("string"), F.lit(" =====\n"), F.col("html"), F.lit("\n\nBáo cáo lưu chuyển tiền tệ\n Trang \n<TABLE>\n<tr><td rowspan=2>A<td>B\n<tr><td>"), cell, F.lit("</table> <table></table>\n<table><tr><td>open"))
    doc_id = F.when(F.col("page_id") % 3 != 0, F.col("page_id").cast("string"))
    return copies.select(doc_id.alias("doc_id"), F.lit("T").alias("ticker"), (F.lit(2000) + F.col("part")).alias("year"), F.lit("other").alias("stmt_type"), F.when(F.col("page_id") % 11 != 0, made).alias("text"), (F.col("page_id") % 2).alias("batch"))


@query(f"""WITH {_PAGES_SQL} SELECT CASE WHEN NOT nameless THEN page_id::VARCHAR END AS doc_id, (2000 + part)::INTEGER AS year, k::INTEGER AS table_idx, (breaks + 6 + (k - 1) * 2)::INTEGER AS line_no, (page_id + part)::INTEGER AS page_no, 'LCTT' AS section,
CASE WHEN k = 1 THEN 2 ELSE 0 END::INTEGER AS n_rows, (length('===== PAGE  =====') + length((page_id + part)::VARCHAR) + 1 + n + length('  Báo cáo lưu chuyển tiền tệ  Trang  ') + CASE WHEN k = 1 THEN 0 ELSE length('<TABLE> <tr><td rowspan=2>A<td>B <tr><td></table> ') + CASE WHEN broken THEN 7 ELSE 9 END END)::INTEGER AS char_start
FROM c, (VALUES (1), (2)) AS v(k) WHERE NOT textless""")
def one_pass_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated and missing ids: every row gives its tables."""
    return reports.tables(_page_docs(spark, sf_dir)).select("doc_id", "year", "table_idx", "line_no", "page_no", "section", "n_rows", "char_start")


@query(f"""WITH {_PAGES_SQL}, r AS (SELECT *, CASE WHEN NOT nameless THEN page_id::VARCHAR END AS doc_id FROM c)
SELECT 'table' AS kind, doc_id, k::INTEGER AS table_idx, NULL::VARCHAR AS stage FROM r, (VALUES (1), (2)) AS v(k) WHERE NOT textless
UNION ALL SELECT 'fault', doc_id, CASE WHEN textless THEN NULL ELSE 1 END::INTEGER, CASE WHEN textless THEN 'text' ELSE 'html' END FROM r WHERE textless OR broken""")
def batched_write_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches written with their dead letters, the first one twice; what a broken document costs is itself only."""
    path, docs = shared_path(spark, "batches"), _page_docs(spark, sf_dir)
    for batch in (0, 1, 0):
        reports.write_batch(docs.where(F.col("batch") == batch), path, batch)
    good, bad = reports.read_batches(spark, path)
    good = good.select(F.lit("table").alias("kind"), "doc_id", "table_idx", F.lit(None).cast("string").alias("stage"))
    return good.unionByName(bad.select(F.lit("fault").alias("kind"), "doc_id", "table_idx", "stage"))


_GRIDS = [
    ("<table><tr><td>{w}<td>{n}<tr><td>{y}</table>", '[["{w}","{n}"],["{y}",""]]'),
    ("<table><tr><td rowspan=2 colspan=2>{w}</td><td>{y}</td></tr><tr><td>{n}</td></tr></table>", '[["{w}","{w}","{y}"],["{w}","{w}","{n}"]]'),
    ("<table><tr><td rowspan=3>{w}</td><td>{n}</td></tr></table>", '[["{w}","{n}"],["{w}",""],["{w}",""]]'),
    ("<table><tr><td>{w}&amp;{n}<br>c</td></tr>", '[["{w}&{n} c"]]'),
    ("<table><tr><td colspan=99>{w}</td><td>{n}</td></tr></table>", '[["{w}","{n}"]]'),
    ("", "[]"), (None, "[]"), ("no table: {w}", "[]"),
    ("<table><tr><th>h1<th colspan=2>{w}</tr><tr></tr><tr><td>1<td>{n}<td>{y}</table>", '[["h1","{w}","{w}"],["1","{n}","{y}"]]'),
]
golden("grid_spans", "raw string", _GRIDS, {"grid": "string"}, lambda d: {"grid": F.to_json(html.grid(d["raw"]))})

_G = "array<array<string>>"


def _grid(c: Column) -> Column:
    return F.from_json(c, _G)


golden(
    "header_rows", "raw string",
    [('[["Chỉ tiêu","{y}"],["{w}","5"]]', 1), ('[["",""],["{w}","b"],["x","{n}"]]', 2), ('[["{w}","{w}"],["a","b"]]', 1), ("[]", 0), ('[["{w}","b","c","d"],["x","","",""],["y","1","2","{n}"]]', 1), ('[["a","b"],["c","d"],["{w}","f"],["g","h"]]', 3)],
    {"n": "int"}, lambda d: {"n": grids.header_rows(_grid(d["raw"]))},
)
golden(
    "flatten_header", "raw string, n int",
    [('[["Tại ngày","Tại ngày"],["31.12.{y} Triệu VND","31.12.{p}"]]', 2, "tai_ngay_31_12_{y}_trieu_vnd,tai_ngay_31_12_{p}"), ('[["","{w}"]]', 1, "col_0,{s}"), ('[["{w}","{w}","{w}"]]', 1, "{s},{s}_2,{s}_3"), ("[]", 1, ""), ('[["{w}"],["{w}"],["Y"]]', 3, "{s}_y")],
    {"names": "string"}, lambda d: {"names": F.array_join(grids.flatten_header(_grid(d["raw"]), d["n"]), ",")},
)
golden(
    "unit_detect", "caption string, header string",
    [("{w}", "31.12.{y}Triệu VND", 1e6, "header_cell"), ("{w} VND", "", 1.0, "caption"), ("{w} | Đơn vị: nghìn tỷ", "", 1e12, "caption"), ("", "{w}", 1.0, "default"), ("{w} | Triệu đồng", "VND", 1e6, "caption"), ("{w}", "VND", 1.0, "header_cell"), ("tỷ đồng {y}", "", 1e9, "caption"), ("Đơn vị: ngàn đồng {y}", "", 1e3, "caption")],
    {"scale": "double", "source": "string"}, lambda d: {"scale": periods.detect_unit(d["caption"], d["header"])["scale"], "source": periods.detect_unit(d["caption"], d["header"])["source"]},
)
golden(
    "period_classify", "header string, year int, section string",
    [("01/01/{y}", "{y}", "CDKT", "stock", "{y}", True), ("31/12/{y}", "{y}", "CDKT", "stock", "{y}", False), ("Năm {y}", "{y}", "KQKD", "flow", "{y}", False), ("Số cuối năm", "{y}", "CDKT", "stock", "{y}", False), ("Số đầu năm", "{y}", "CDKT", "stock", "{y}", True), ("Năm nay", "{y}", "KQKD", "flow", "{y}", False), ("Năm trước", "{y}", "KQKD", "flow", "{p}", False), ("{y}VND", "{y}", "KQKD", "flow", "{y}", False), ("{p}VND", "{y}", "CDKT", "stock", "{p}", False), ("Mã số", "{y}", "CDKT", None, None, None), ("{w}", "{y}", "CDKT", None, None, None)],
    {"period_type": "string", "period_year": "int", "is_begin": "boolean"}, lambda d: (lambda p: {"period_type": p["period_type"], "period_year": p["year"], "is_begin": p["is_begin"]})(periods.classify_period(d["header"], d["year"], d["section"])),
)
golden(
    "section_detect", "line string",
    [("Mẫu B02/TCTD {w}", "CDKT"), ("{w} B 02-DN/HN", "KQKD"), ("B 03 – DN {y}", "LCTT"), ("BẢNG CÂN ĐỐI KẾ TOÁN {w}", "CDKT"), ("{n} Báo cáo lưu chuyển tiền tệ", "LCTT"), ("Thuyết minh {n}", "TM"), ("khác: {w} {n}", None), ("B 09 - DN {w}", "TM")],
    {"section": "string"}, lambda d: {"section": periods.section_of_line(d["line"])},
)
golden(
    "row_labels", "raw string, n int",
    [('[["h","v"],["1.","{w}","5"],["Lãi {w}","{n}"],["12","34"]]', 1, "{w};Lãi {w}"), ("[]", 1, "")],
    {"labels": "string"}, lambda d: {"labels": F.array_join(grids.row_labels(_grid(d["raw"]), d["n"]), ";")},
)
golden(
    "code_column", "raw string, names string",
    [('[["a","b"],["{w}","100"],["y","200"],["z","270"],["w","{n}"]]', "a,b", 1), ('[["a","ma"],["{w}","y"]]', "a,ma_so", 1), ('[["a","b"],["{w}","1"]]', "a,b", -1)],
    {"col": "int"}, lambda d: {"col": grids.code_column(_grid(d["raw"]), F.lit(1), F.split(d["names"], ","))},
)
golden(
    "evidence_cells", "cell string",
    [("713.{n}", "713{n}.0"), ("(1.{n})", "-1{n}.0"), ("-", ""), ("{w}", "{w}"), ("{m},5", "{m}.5"), ("31/12/{y}", "31/12/{y}"), ("", "")],
    {"shown": "string"}, lambda d: {"shown": grids.evidence_cell(d["cell"])},
)
golden(
    "numeric_columns", "raw string",
    [('[["{w}","1","-"],["b","{n}","3"]]', "1"), ('[["5","{w}"],["","{n}"]]', "0"), ("[]", "")],
    {"cols": "string"}, lambda d: {"cols": F.array_join(F.transform(grids.numeric_columns(_grid(d["raw"]), grids.n_columns(_grid(d["raw"]))), lambda i: i.cast("string")), ",")},
)


def _passage_sql() -> str:
    unit = packs.UNIT_WORDS.get(1.0, "")
    heads = {"CDKT": "'Chỉ tiêu Mã số 31/12/' || year || ' 01/01/' || year", "KQKD": "'Chỉ tiêu Mã số Năm ' || year || ' Năm ' || (year - 1)"}
    captions = {"CDKT": "BẢNG CÂN ĐỐI KẾ TOÁN | Mẫu số B 01 – DN | Đơn vị tính: VND", "KQKD": "Đơn vị tính: VND | BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH | Đơn vị tính: VND"}
    texts = {s: f"ticker || ' ' || year || ' consolidated {s} {packs.SECTION_WORDS.get(s, '')} {unit}' || chr(10) || '{captions[s]}' || chr(10) || {heads[s]} || chr(10) || '{' ; '.join(x[2] for x in statements.LINES if x[0] == s)}'" for s in heads}
    return _DOCS_SQL + " " + " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS INTEGER) AS table_idx, md5({t}) AS passage_md5 FROM docs" for i, t in enumerate(texts.values(), 1))


@query(_passage_sql())
def table_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = grids.passage(c("ticker"), c("year"), c("stmt_type"), c("section"), c("unit_scale"), c("caption"), c("grid"), c("n_header_rows"))
    return _tables(spark, sf_dir).select("doc_id", "table_idx", F.md5(p).alias("passage_md5"))


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('error', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def asof_section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")), True).over(w).alias("section"))


@query("SELECT event_id, array_to_string((list(CASE WHEN event_type <> 'view' THEN CAST(event_id AS VARCHAR) END) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))[-3:], '|') AS caption FROM events")
def caption_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-scan.CAPTION_WINDOW, -1)
    near = F.collect_list(F.when(F.col("event_type") != "view", F.col("event_id").cast("string"))).over(w)
    e = table(spark, sf_dir, "events").select("event_id", near.alias("near"))
    return e.select("event_id", F.when(F.size("near") > 0, F.array_join(F.slice("near", F.greatest(F.size("near") - 2, F.lit(1)), 3), "|")).alias("caption"))


# --- facts and quality -------------------------------------------------------------------------------------------------

_COLUMNS = ", ".join(f"('{s}', '{code}', '{col}', '{concept}')" for s, code, _, col, concept in statements.LINES)
_UNPIVOT = "".join(f" WHEN '{col}' THEN {{0}}.{col}" for _, _, _, col, _ in statements.LINES)
_FACTS_SQL = _DOCS_SQL + f""", lines AS (SELECT * FROM (VALUES {_COLUMNS}) AS v(statement, code, name, concept)),
facts AS (SELECT d.ticker, d.year, d.doc_id, l.statement, l.code AS ma_so, l.concept, d.year AS period_year, false AS is_begin, CAST(CASE l.name{_UNPIVOT.format('d')} END AS DOUBLE) AS value FROM docs d, lines l
UNION ALL SELECT d.ticker, d.year, d.doc_id, l.statement, l.code, l.concept, CAST(CASE WHEN l.statement = 'CDKT' THEN d.year ELSE d.year - 1 END AS INTEGER), l.statement = 'CDKT', CAST(CASE l.name{_UNPIVOT.format('p')} END AS DOUBLE) FROM docs d JOIN truth p ON p.ticker = d.ticker AND p.year = d.year - 1, lines l)"""


@query(_FACTS_SQL + " SELECT ticker, year, doc_id, statement, ma_so, concept, CAST(period_year AS INTEGER) AS period_year, is_begin, value FROM facts")
def facts_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.extract(_tables(spark, sf_dir)).select("ticker", "year", "doc_id", "statement", "ma_so", "concept", "period_year", "is_begin", "value")


golden(
    "concept_map", "code string, label string, section string, ticker string",
    [("01", "{w}", "KQKD", "AAA", "DOANH_THU_BAN_HANG"), ("270", "{w}", "CDKT", "AAA", "TONG_TAI_SAN"), ("20", "{w}", "LCTT", "AAA", "LC_TIEN_THUAN_HDKD"), ("20", "{w}", "KQKD", "AAA", "LOI_NHUAN_GOP"), (None, "TONG TAI SAN", "CDKT", "VCB", "TONG_TAI_SAN"), ("270", "CHO VAY KHACH HANG", "CDKT", "VCB", "CHO_VAY_KHACH_HANG"), (None, "HANG TON KHO", "CDKT", "SSI", "HANG_TON_KHO"), (None, "{W}", "CDKT", "AAA", None)],
    {"concept": "string"}, lambda d: {"concept": facts.concept_of(d["code"], d["label"], d["section"], facts.adapter_of(d["ticker"]))},
)


@query(_FACTS_SQL + """, p AS (SELECT doc_id, period_year, is_begin, median(value) FILTER (concept = 'TONG_TAI_SAN') AS a, median(value) FILTER (concept = 'TONG_NGUON_VON') AS b, median(value) FILTER (concept = 'TAI_SAN_NGAN_HAN') AS c, median(value) FILTER (concept = 'TAI_SAN_DAI_HAN') AS d, median(value) FILTER (concept = 'NO_PHAI_TRA') AS e, median(value) FILTER (concept = 'VON_CHU_SO_HUU') AS f, median(value) FILTER (concept = 'LOI_NHUAN_GOP') AS g, median(value) FILTER (concept = 'DOANH_THU_THUAN') AS h, median(value) FILTER (concept = 'GIA_VON_HANG_BAN') AS i FROM facts GROUP BY ALL),
k AS (SELECT '270 == 440' AS rule, b AS lhs, a AS rhs FROM p UNION ALL SELECT '100+200 == 270', c + d, a FROM p UNION ALL SELECT '300+400 == 440', e + f, b FROM p UNION ALL SELECT '10-11 == 20', h - abs(i), g FROM p)
SELECT rule, count(lhs - rhs) AS n, count(*) FILTER (abs(lhs - rhs) <= 0.005 * greatest(abs(rhs), 1)) AS passed, round(avg(CASE WHEN lhs - rhs IS NOT NULL THEN CAST(abs(lhs - rhs) <= 0.005 * greatest(abs(rhs), 1) AS INTEGER) END), 4) AS rate FROM k GROUP BY rule""")
def qc_identity_pivot_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.identities(_facts(spark, sf_dir))


@query(_FACTS_SQL + ", m AS (SELECT ticker, period_year, concept, median(value) FILTER (is_begin) AS beg, median(value) FILTER (NOT is_begin) AS fin FROM facts WHERE statement = 'CDKT' GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (abs(b.beg - e.fin) <= 0.01 * greatest(abs(e.fin), 1)) AS passed, round(avg(CAST(abs(b.beg - e.fin) <= 0.01 * greatest(abs(e.fin), 1) AS INTEGER)), 4) AS rate FROM m b JOIN m e ON b.ticker = e.ticker AND b.concept = e.concept AND b.period_year - 1 = e.period_year WHERE b.beg IS NOT NULL AND e.fin IS NOT NULL")
def qc_cross_year_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cross_year_summary(_facts(spark, sf_dir))


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as balance-sheet facts that need not agree from year to year."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 25).cast("string").alias("ticker"), F.col("o_orderstatus").alias("stmt_type"), F.year("o_orderdate").alias("period_year"), F.col("o_orderpriority").alias("concept"), F.lit("CDKT").alias("statement"), (F.col("o_orderkey") % 2 == 0).alias("is_begin"), F.col("o_totalprice").alias("value"))


@query("""WITH m AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS ticker, o_orderstatus AS stmt_type, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority AS concept, median(o_totalprice) FILTER (o_orderkey % 2 = 0) AS beg, median(o_totalprice) FILTER (o_orderkey % 2 <> 0) AS fin FROM orders GROUP BY ALL)
SELECT e.ticker, e.stmt_type, e.y AS period_year, e.concept, round(abs(b.beg - e.fin), 4) AS dev FROM m b JOIN m e ON b.ticker = e.ticker AND b.stmt_type = e.stmt_type AND b.concept = e.concept AND b.y - 1 = e.y WHERE NOT abs(b.beg - e.fin) <= 0.01 * greatest(abs(e.fin), 1) ORDER BY dev DESC, 1, 2, 3, 4 LIMIT 20""")
def worst_deviation_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.worst(_order_facts(spark, sf_dir)).select("ticker", "stmt_type", "period_year", "concept", F.round("dev", 4).alias("dev"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_size_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("WITH g AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, count(DISTINCT l_partkey) AS c FROM lineitem GROUP BY ALL) SELECT count(*) AS groups, count(DISTINCT l_suppkey) AS tickers, median(c) AS median_concepts FROM g")
def nunique_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("period_year"), F.col("l_partkey").alias("concept"))
    return quality.coverage(li)


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'F')")
def bool_all_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "F").alias("all")).where("all").select("o_custkey")


@query(_DOCS_SQL + " SELECT 'tables' AS \"check\", CAST(count(*) * 2 AS DOUBLE) AS value, true AS ok FROM docs UNION ALL SELECT 'documents', CAST(count(*) AS DOUBLE), true FROM docs UNION ALL SELECT 'valid_grids', 1.0, true UNION ALL SELECT 'dated_statements', 1.0, true")
def corpus_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corpus_checks(_tables(spark, sf_dir))


# --- retrieval ---------------------------------------------------------------------------------------------------------

_BM25_SQL = f"""WITH words AS (SELECT doc_id AS id, {TOKENS.format('text')} AS ts FROM documents), lens AS (SELECT id, len(ts) AS n FROM words), tot AS (SELECT count(*) AS n, avg(n) AS a FROM lens),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM words) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
terms AS (SELECT term, df, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf FROM dfs, tot WHERE df >= 2 AND df <= 0.6 * n),
q AS (SELECT item_id AS qid, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark),
scored AS (SELECT qid, id, sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens.n / tot.a)) * idf) AS bm25 FROM q JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (id), tot GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, id) AS r FROM scored)"""


def _built_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    made: list[bm25.Index] = []  # built by the first part that isn't stored

    def part(name: str) -> DataFrame:
        if not made:
            made.append(_built_index(spark, sf_dir))
        return getattr(made[0], name)

    return bm25.Index(*(_once(spark, sf_dir, f"index-{name}", lambda name=name: part(name)) for name in ("docs", "terms", "totals")))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return store(bm25.best(_index(spark, sf_dir), _queries(spark, sf_dir), k, 6), "top")


@query(_BM25_SQL + " SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(_BM25_SQL + " SELECT qid, id, round(bm25, 6) AS bm25 FROM top WHERE r <= 10")
def bm25_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("qid", "id", F.round("bm25", 6).alias("bm25"))


@query(_BM25_SQL + ", c AS (SELECT q.item_id AS qid, d.doc_id AS id FROM benchmark q JOIN documents d ON d.source = 'src' || CAST(q.item_id % 20 AS VARCHAR)), s AS (SELECT qid, id, coalesce(bm25, 0) AS b FROM c LEFT JOIN scored USING (qid, id)) SELECT qid, id, round(CASE WHEN max(b) OVER (PARTITION BY qid) > 0 THEN b / max(b) OVER (PARTITION BY qid) ELSE b END, 6) AS bm25 FROM s")
def bm25_subset_maxnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _queries(spark, sf_dir), table(spark, sf_dir, "documents")
    pairs = q.select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("source")).join(d.select("source", F.col("doc_id").alias("id")), "source").select("qid", "id")
    s = pairs.join(bm25.score(_index(spark, sf_dir), q, pairs), ["qid", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return retrieve.normalised(s).select("qid", "id", F.round("bm25", 6).alias("bm25"))


_PASSAGES_SQL = _BM25_SQL + f""", pairs AS (SELECT qid, id, {FOLD.format('d.text')} AS p, {TOKENS.format('b.text')} AS ts FROM top JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = qid WHERE r <= 10)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("p"))
    found = _top(spark, sf_dir).join(d, "id").withColumn("p", text.fold(F.col("p")))  # only hits are folded
    return found.join(_queries(spark, sf_dir).select("qid", text.tokens(F.col("query")).alias("ts")), "qid")


@query(_PASSAGES_SQL + ", t AS (SELECT qid, id, p, unnest(list_distinct(ts)) AS term FROM pairs) SELECT qid, id, round(sum(CASE WHEN contains(p, term) THEN coalesce(idf, 0) ELSE 0 END) / CASE WHEN sum(coalesce(idf, 0)) = 0 THEN 1 ELSE sum(coalesce(idf, 0)) END, 6) AS cover FROM t LEFT JOIN terms USING (term) GROUP BY qid, id")
def cover_idf_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = bm25.query_weights(_index(spark, sf_dir), _queries(spark, sf_dir), "w")
    return _pairs(spark, sf_dir).join(w, "qid").select("qid", "id", F.round(retrieve.cover(F.col("w"), F.col("p")), 6).alias("cover"))


@query(_PASSAGES_SQL + """, g AS (SELECT qid, id, p, ts, unnest(generate_series(1, len(ts))) AS i FROM pairs), h AS (SELECT qid, id, p, ts, i, unnest(generate_series(3, 9)) AS l FROM g)
SELECT qid, id, round(least(max(CASE WHEN i + l - 1 <= len(ts) AND contains(p, array_to_string(ts[i : i + l - 1], ' ')) THEN l ELSE 0 END) / 6.0, 1.0), 6) AS phrase FROM h GROUP BY qid, id""")
def phrase_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("qid", "id", F.round(text.phrase_score(F.col("ts"), F.col("p")), 6).alias("phrase"))


_SIGNALS_SQL = _PASSAGES_SQL + f""", b AS (SELECT qid, id, bm25 / max(bm25) OVER (PARTITION BY qid) AS bm25 FROM top WHERE r <= 10),
c AS (SELECT qid, id, sum(CASE WHEN contains(p, term) THEN coalesce(idf, 0) ELSE 0 END) / CASE WHEN sum(coalesce(idf, 0)) = 0 THEN 1 ELSE sum(coalesce(idf, 0)) END AS cover FROM (SELECT qid, id, p, unnest(list_distinct(ts)) AS term FROM pairs) LEFT JOIN terms USING (term) GROUP BY qid, id),
h AS (SELECT qid, id, p, ts, i, unnest(generate_series(3, 9)) AS l FROM (SELECT qid, id, p, ts, unnest(generate_series(1, len(ts))) AS i FROM pairs)),
f AS (SELECT qid, id, least(max(CASE WHEN i + l - 1 <= len(ts) AND contains(p, array_to_string(ts[i : i + l - 1], ' ')) THEN l ELSE 0 END) / 6.0, 1.0) AS phrase FROM h GROUP BY qid, id),
sig AS (SELECT qid, id, d.source, round(bm25 + 3.0 * phrase + 2.0 * cover + 2.5 * CAST(d.n_chars % 7 = qid % 7 AS INTEGER) + 0.5 * CAST(d.n_chars >= 4 AS INTEGER), 4) AS score FROM b JOIN c USING (qid, id) JOIN f USING (qid, id) JOIN documents d ON d.doc_id = id)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lexical score; a document's length modulo 7 stands in for its period, a query's id for the year asked for."""
    index = _index(spark, sf_dir)
    ir = _queries(spark, sf_dir).select("qid", F.col("query").alias("retrieval_query"), F.array((F.col("qid") % 7).cast("int")).alias("years"))
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), F.col("text").alias("passage"), F.col("lang").alias("section"), F.col("n_chars").alias("n_numeric_cells"), F.array((F.col("n_chars") % 7).cast("int")).alias("period_years"))
    return retrieve.signals_of(ir, meta, index, _top(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(_SIGNALS_SQL + " SELECT qid, id, score FROM sig")
def lexical_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("qid", "id", "score")


@query(_SIGNALS_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) = 1 AS f FROM sig) SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY f DESC, score DESC, id) AS n FROM o) WHERE n <= 5")
def select_doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.cover_documents(_signals(spark, sf_dir), 5).select("qid", "id")


#: Questions with an even id name a source, the others search all documents; pre-filtered to 200 where there are more than 300.
_RETRIEVE_SQL = _BM25_SQL + f""", ir AS (SELECT item_id AS qid, text, item_id % 2 = 0 AS named, {TOKENS.format('text')} AS ts, 1 + item_id % 3 AS t, 1 + item_id % 4 // 2 AS y FROM benchmark),
cand AS (SELECT ir.qid, d.doc_id AS id, round(coalesce(bm25, 0), 9) AS bm25, named FROM ir JOIN documents d ON NOT named OR d.source = 'src' || CAST(qid % 20 AS VARCHAR) LEFT JOIN scored ON scored.qid = ir.qid AND scored.id = d.doc_id),
base AS (SELECT qid, id, bm25 FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS c, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS r FROM cand) WHERE c <= 300 OR r <= 200),
pairs AS (SELECT qid, id, CASE WHEN max(bm25) OVER (PARTITION BY qid) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY qid) ELSE bm25 END AS bm25, {FOLD.format('d.text')} AS p, ts, d.n_chars, d.source, y FROM base JOIN documents d ON d.doc_id = id JOIN ir USING (qid)),
c AS (SELECT qid, id, sum(CASE WHEN contains(p, term) THEN coalesce(idf, 0) ELSE 0 END) / CASE WHEN sum(coalesce(idf, 0)) = 0 THEN 1 ELSE sum(coalesce(idf, 0)) END AS cover FROM (SELECT qid, id, p, unnest(list_distinct(ts)) AS term FROM pairs) LEFT JOIN terms USING (term) GROUP BY qid, id),
h AS (SELECT qid, id, p, ts, i, unnest(generate_series(3, 9)) AS l FROM (SELECT qid, id, p, ts, unnest(generate_series(1, len(ts))) AS i FROM pairs)),
f AS (SELECT qid, id, least(max(CASE WHEN i + l - 1 <= len(ts) AND contains(p, array_to_string(ts[i : i + l - 1], ' ')) THEN l ELSE 0 END) / 6.0, 1.0) AS phrase FROM h GROUP BY qid, id),
sig AS (SELECT qid, id, source, round(bm25 + 3.0 * phrase + 2.0 * cover + 2.5 * CAST(n_chars % 7 = qid % 7 OR (y = 2 AND n_chars % 7 = (qid + 1) % 7) AS INTEGER) + 0.5 * CAST(n_chars >= 4 AS INTEGER), 6) AS score FROM pairs JOIN c USING (qid, id) JOIN f USING (qid, id)),
k AS (SELECT qid, greatest(2, least(12, round_even(2.5 * (CASE WHEN qid % 5 = 0 THEN 1.8 ELSE 1.2 END * CASE WHEN named THEN 1 ELSE t * y END), 0))) AS k FROM ir),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) = 1 AS first_ FROM sig)"""


@query(_RETRIEVE_SQL + " SELECT qid, id, score FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY first_ DESC, score DESC, id) AS n FROM o) JOIN k USING (qid) WHERE n <= k")
def retrieve_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to ranked tables, end to end: every document is a table, its source the document that it belongs to."""
    qid = F.col("qid")
    ops = F.when(qid % 5 == 0, F.array(F.lit("RATIO"))).otherwise(F.array().cast("array<string>"))
    years = F.slice(F.array((qid % 7).cast("int"), ((qid + 1) % 7).cast("int")), F.lit(1), (F.lit(1) + F.floor(qid % 4 / 2)).cast("int"))
    tickers = F.slice(F.array(*map(F.lit, "ABC")), F.lit(1), (F.lit(1) + qid % 3).cast("int"))
    ir = store(_queries(spark, sf_dir).select("qid", F.col("query").alias("retrieval_query"), tickers.alias("tickers"), years.alias("years"), ops.alias("ops")), "asked")
    docs = ir.where("qid % 2 = 0").select("qid", F.concat(F.lit("src"), (qid % 20).cast("string")).alias("doc_id"))
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), F.col("text").alias("passage"), F.col("lang").alias("section"), F.col("n_chars").alias("n_numeric_cells"), F.array((F.col("n_chars") % 7).cast("int")).alias("period_years"))
    hits = retrieve.retrieve(ir, meta, _index(spark, sf_dir), docs, above=300, to=200, digits=6)
    return hits.select("qid", "id", "score")


@query(_BM25_SQL + ", best AS (SELECT qid, id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS r FROM scored) SELECT qid, id, bm25 FROM best WHERE r <= 20")
def block_max_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = blockmax.search(blockmax.build(_index(spark, sf_dir), 32), _queries(spark, sf_dir), 20)
    return found.select("qid", "id", F.round("bm25", 6).alias("bm25"))


_RANKS_SQL = "r AS (SELECT l_suppkey AS qid, l_orderkey * 100 + l_linenumber AS id, sum(l_extendedprice) AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(p, 2) DESC, id) - 1 AS rank FROM r), b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(q, 2) DESC, id) - 1 AS rank FROM r)"


def _ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id")).agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"))
    return tuple(li.select("qid", "id", retrieve.rank_from([F.desc(F.round(c, 2)), F.col("id")], "qid").alias("rank")) for c in ("p", "q"))  # type: ignore[return-value]


@query(f"WITH {_RANKS_SQL}, u AS (SELECT qid, id, 1.0 / (61 + rank) AS s FROM a WHERE rank < 50 UNION ALL SELECT qid, id, 0.5 / (61 + rank) FROM b WHERE rank < 50) SELECT qid, id, round(sum(CAST(s AS DOUBLE)), 9) AS rrf FROM u GROUP BY ALL")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ranks(spark, sf_dir)
    u = a.where("rank < 50").withColumn("weight", F.lit(1.0)).unionByName(b.where("rank < 50").withColumn("weight", F.lit(0.5)))
    return retrieve.fuse(u).select("qid", "id", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {_RANKS_SQL} SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qid = b.qid AND a.id = b.id AND a.rank < 20)) WHERE n <= 3")
def ce_extra_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ranks(spark, sf_dir)
    return retrieve.extra_hits(b, a.where("rank < 20").select("qid", "id"), 3).select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RANKS_SQL}, x AS (SELECT qid, list(id) AS xs FROM a WHERE rank < 10 GROUP BY 1), y AS (SELECT qid, list(id) AS ys FROM b WHERE rank < 10 GROUP BY 1) SELECT round(avg(len(list_intersect(xs, ys)) / len(list_distinct(list_concat(xs, ys)))), 6) AS jaccard, count(*) AS questions FROM x JOIN y USING (qid)")
def jaccard_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.agreement(*_ranks(spark, sf_dir))


@query(f"WITH {_RANKS_SQL}, g AS (SELECT qid, id FROM a WHERE rank < 8), s AS (SELECT qid, id FROM b WHERE rank < 12), c AS (SELECT qid, count(*) AS k FROM s GROUP BY 1), h AS (SELECT g.qid, count(*) AS gold, count(s.id) AS hits FROM g LEFT JOIN s ON g.qid = s.qid AND g.id = s.id GROUP BY 1) SELECT h.qid, round(5.0 * hits / (4.0 * gold + k), 6) AS f2 FROM h JOIN c USING (qid)")
def f2_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ranks(spark, sf_dir)
    gold = a.where("rank < 8").groupBy("qid").agg(F.collect_list("id").alias("g"))
    got = b.where("rank < 12").groupBy("qid").agg(F.collect_list("id").alias("s"))
    return gold.join(got, "qid").select("qid", F.round(numbers.f2(F.size(F.array_intersect("g", "s")), F.size("g"), F.size("s")), 6).alias("f2"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, p FROM (SELECT l_suppkey, l_orderkey, l_linenumber, round(max(l_extendedprice), 2) AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(max(l_extendedprice), 2) DESC, l_orderkey, l_linenumber) AS n FROM lineitem GROUP BY 1, 2, 3) WHERE n <= 20")
def topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.round(F.max("l_extendedprice"), 2).alias("p"))
    return retrieve.top_k(li, 20, [F.desc("p"), F.col("l_orderkey"), F.col("l_linenumber")], "l_suppkey")


@query("SELECT p_partkey, CAST(greatest(2, least(12, round_even(2.5 * (CASE WHEN r = 1 THEN 1.8 ELSE 1.2 END * n), 0))) AS INTEGER) AS k, CAST(greatest(1, least(8, CASE WHEN d > 0 THEN least(n + 1, d) ELSE n + 1 END)) AS INTEGER) AS docs, CAST(round(CASE WHEN r = 1 THEN 1.8 ELSE 1.2 END * n, 6) AS DOUBLE) AS gold FROM (SELECT *, CASE WHEN d > 0 THEN least(greatest(t, 1) * greatest(y, 1), d) ELSE greatest(t, 1) * greatest(y, 1) END AS n FROM (SELECT p_partkey, p_partkey % 6 AS t, p_partkey // 6 % 6 AS y, p_partkey // 36 % 2 AS r, p_partkey // 72 % 5 AS d FROM part))")
def adaptive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda by, n: (F.floor(F.col("p_partkey") / by) % n).cast("long")
    g = table(spark, sf_dir, "part").select("p_partkey", at(1, 6).alias("t"), at(6, 6).alias("y"), at(36, 2).alias("r"), at(72, 5).alias("d"))
    some = lambda n, kind: F.slice(F.array_repeat(F.lit(0).cast(kind), 6), F.lit(1), n.cast("int"))
    ops = F.when(F.col("r") == 1, F.array(F.lit("RATIO"))).otherwise(F.array().cast("array<string>"))
    args = (some(F.col("t"), "string"), some(F.col("y"), "int"))
    d = F.col("d").cast("int")
    return g.select("p_partkey", numbers.adaptive_k(*args, ops, 12, d).alias("k"), numbers.adaptive_docs(*args, 8, d).alias("docs"), F.round(numbers.gold_tables(*args, ops, d), 6).alias("gold"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey").distinct()


@query("SELECT l_orderkey * 1 AS id, CASE WHEN o_orderkey IS NULL THEN 'bad_doc' WHEN NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = l_orderkey AND x.o_custkey = l_partkey) THEN 'bad_line' ELSE 'ok' END AS status, count(*) AS n FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = l_orderkey GROUP BY ALL")
def anti_join_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("ref"))
    real = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_custkey").cast("int").alias("line_no"))
    return verify.trace_refs(refs, real).groupBy("id", "status").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) SELECT c_custkey, CAST(1999 AS INTEGER) AS year, y AS near_year FROM (SELECT c_custkey, y, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(y - 1999), y DESC) AS n FROM customer JOIN h ON o_custkey = c_custkey) WHERE n <= 2")
def nearest_year_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.lit(1999).alias("year"))
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"))
    return documents.nearest_years(want, have).withColumnRenamed("ticker", "c_custkey")


_KINDS = "CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'other' ELSE 'separate' END"


@query(f"""WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_custkey AS VARCHAR) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS y, {_KINDS} AS k FROM orders),
t AS (SELECT ticker, bool_and(k = 'other') AS typeless FROM d GROUP BY 1), h AS (SELECT DISTINCT ticker, y FROM d),
q AS (SELECT DISTINCT CAST(c_custkey AS BIGINT) AS qid, CAST(c_custkey AS VARCHAR) AS ticker FROM customer),
use AS (SELECT qid, q.ticker, h.y FROM q JOIN h USING (ticker) QUALIFY CASE WHEN max(CAST(h.y = 1998 AS INTEGER)) OVER (PARTITION BY qid) = 1 THEN h.y = 1998 ELSE row_number() OVER (PARTITION BY qid ORDER BY abs(h.y - 1998), h.y DESC) <= 2 END),
j AS (SELECT qid, doc_id, k, typeless, CASE k WHEN 'consolidated' THEN 0 WHEN 'other' THEN 1 WHEN 'separate' THEN 3 END AS p, min(CASE k WHEN 'consolidated' THEN 0 WHEN 'other' THEN 1 WHEN 'separate' THEN 3 END) OVER (PARTITION BY qid, use.y) AS b FROM use JOIN d USING (ticker, y) JOIN t USING (ticker))
SELECT qid, doc_id FROM j WHERE typeless OR p = b OR k = 'other'""")
def priority_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_custkey").cast("string").alias("ticker"), F.year("o_orderdate").alias("year"), F.expr(_KINDS).alias("stmt_type"))
    ir = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.lit(None).cast("string").alias("stmt_type"), F.array(F.lit(1998)).alias("years"), F.array(F.col("c_custkey").cast("string")).alias("tickers"), F.array().cast("array<string>").alias("ops"))
    return documents.filter_documents(ir, docs, most=None).select("qid", "doc_id")


_DENSE_SQL = "s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a, embeddings b), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS n FROM s)"


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))  # the stated set of queries
    return vector_search.search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, k)


@query(f"WITH {_DENSE_SQL} SELECT qid, id, score FROM t WHERE n <= 50")
def dense_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 50).select("qid", "id", "score")


@query(f"WITH {_DENSE_SQL}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY abs(hash_.h - qid % 10), t.score DESC, id) AS n FROM t JOIN (SELECT vec_id, CAST(label AS BIGINT) AS h FROM embeddings) hash_ ON hash_.vec_id = id WHERE t.n <= 50) SELECT qid, id, n - 1 AS rank FROM r WHERE n <= 10")
def rerank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    s = _search(spark, sf_dir, 50).join(e, "id").withColumn("near", F.abs(F.col("label") - F.col("qid") % 10))
    order = [F.col("near"), F.desc("score"), F.col("id")]
    return retrieve.top_k(s, 10, order, "qid").select("qid", "id", retrieve.rank_from(order, "qid").cast("long").alias("rank"))


_KEYED_SQL = _DENSE_SQL.replace("FROM embeddings WHERE vec_id % 100 = 0) a, embeddings b)", "FROM embeddings WHERE vec_id % 100 = 0) a JOIN embeddings b ON a.vec_id % 300 = 0 OR b.label IN (a.label, (a.label + 3) % 10))")


@query(f"WITH {_KEYED_SQL}, r AS (SELECT qid, id, n, score, row_number() OVER (PARTITION BY qid ORDER BY length(md5(CAST(id AS VARCHAR) || '/' || CAST(qid AS VARCHAR)).replace('0', '')), n) AS m FROM t WHERE n <= 50) SELECT qid, id, m - 1 AS rank, n - 1 AS dense_rank, score AS dense_score FROM r WHERE m <= 10")
def dense_filtered_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata filter, dense top 50, rerank to 10: vectors lie by their label, a query asks for two labels (every third for all); a digest stands in for the model."""
    import hashlib

    e, path = table(spark, sf_dir, "embeddings"), shared_path(spark, "clustered")
    vector_search.save_clustered(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("key"), F.col("vec_id").cast("string").alias("passage")), path)
    keys = F.when(F.col("vec_id") % 300 != 0, F.array(F.col("label"), ((F.col("label") + 3) % 10).cast("int")))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), keys.alias("keys"), F.col("vec_id").cast("string").alias("query"))  # the stated set of queries

    def model():
        return lambda query, passage: [-len(hashlib.md5(f"{p}/{x}".encode()).hexdigest().replace("0", "")) for x, p in zip(query, passage)]

    hits = vector_search.dense_stage(spark.read.parquet(path), q, model)
    return hits.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"), "dense_score")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS cut, CAST(1.0 AS DOUBLE) AS again FROM embeddings")
def matryoshka_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.slice("embedding", 1, 16)
    short = vectors.truncate(F.col("embedding"), 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(v, v)), 5).alias("cut"), F.round(F.sqrt(vectors.dot(short, short)), 5).alias("again"))


@query(f"WITH {_DENSE_SQL} SELECT count(*) AS questions, round(quantile_cont(score, 0.1), 5) AS p10, round(quantile_cont(score, 0.5), 5) AS median FROM (SELECT qid, max(score) AS score FROM s WHERE id <> qid GROUP BY 1)")
def top_score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))  # the stated set of queries
    found = vector_search.search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, 1, same=False)
    top = retrieve.top_scores(found.withColumnRenamed("score", "rerank_score"))
    return top.select("questions", F.round("p10", 5).alias("p10"), F.round("median", 5).alias("median"))


@query("SELECT CAST(c AS INTEGER) AS case_no, u AS usable, n FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, false)) v(c, u), (SELECT count(*) AS n FROM embeddings)")
def matrix_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors asked for as they are, by another model, in another size, for another number of rows, and where there are none."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n, dims = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    path = shared_path(spark, "vectors")
    held = matrices.load(spark, path, "model-a", n, dims, lambda: rows)
    asked = [(path, "model-a", n, dims), (path, "model-b", n, dims), (path, "model-a", n, dims + 1), (path, "model-a", n + 1, dims), (path + "-none", "model-a", n, dims)]
    cases = spark.createDataFrame([(i, matrices.usable(spark, *a)) for i, a in enumerate(asked)], "case_no int, usable boolean")
    return cases.crossJoin(held.agg(F.count("*").alias("n")))  # one row


#: Names and aliases from the benchmark's passages: the first words as a name, two words of the middle as an alias.
_NAMES_SQL = f"""bt AS (SELECT item_id, {TOKENS.format('text')} AS ts FROM benchmark WHERE text IS NOT NULL)"""


def _passage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", text.tokens(F.col("text")).alias("ts"))
    pair = lambda k: F.array_join(F.slice("ts", k, 2), " ")
    return b.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("ticker"), F.array_join(F.slice("ts", 1, 4), " ").alias("name"), F.array(pair(5), pair(9)).alias("phrases"))


@query(f"WITH {_NAMES_SQL}, ph AS (SELECT 'B' || CAST(item_id AS VARCHAR) AS ticker, unnest([array_to_string(ts[5:6], ' '), array_to_string(ts[9:10], ' ')]) AS phrase FROM bt) SELECT DISTINCT doc_id AS qid, ticker FROM documents JOIN ph ON phrase <> '' AND contains({FOLD.format('text')}, phrase)")
def alias_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against aliases by one automaton."""
    alias = _passage_names(spark, sf_dir).select("ticker", F.explode("phrases").alias("phrase"))
    return companies.by_alias(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question")), alias)


_FORM_SQL = ", ".join(f"'{w}'" for w in packs.FORM_WORDS)


@query(f"""WITH {_NAMES_SQL}, own AS (SELECT 'B' || CAST(item_id AS VARCHAR) AS ticker, list_filter(ts[1:4], lambda x: x NOT IN ({_FORM_SQL})) AS a, ts[1:4] AS every FROM bt),
u AS (SELECT ticker, CASE WHEN len(a) > 0 THEN a ELSE every END AS ws FROM own), f AS (SELECT ticker, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ws FROM u), e AS (SELECT ticker, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM f),
idf AS (SELECT w, ln(1 + (SELECT count(*) FROM f) / count(*)) AS idf FROM e GROUP BY w), n AS (SELECT e.*, idf, sum(idf) OVER (PARTITION BY ticker) AS total, first_value(k) OVER (PARTITION BY ticker ORDER BY idf DESC, k) AS rare FROM e JOIN idf USING (w)),
pos AS (SELECT doc_id AS qid, unnest(ts) AS w, unnest(range(1, len(ts) + 1)) AS p FROM (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents)),
x AS (SELECT qid, ticker, p, k, idf, total, rare FROM pos JOIN n USING (w)), x1 AS (SELECT *, idf AS got, k = rare AS hit FROM x),
{", ".join(f"y{i} AS (SELECT s.qid, s.ticker, s.p, s.k, s.total, s.rare, s.got, s.hit, min({{'p': x.p, 'k': x.k, 'idf': x.idf}}) AS nx FROM x{i} s LEFT JOIN x ON x.qid = s.qid AND x.ticker = s.ticker AND x.p > s.p AND x.p <= s.p + 3 AND x.k > s.k GROUP BY ALL), x{i + 1} AS (SELECT qid, ticker, coalesce(nx.p, p) AS p, coalesce(nx.k, k) AS k, total, rare, got + coalesce(nx.idf, 0) AS got, hit OR coalesce(nx.k = rare, false) AS hit FROM y{i})" for i in (1, 2, 3))}
SELECT qid, ticker, round(max(got) / any_value(total), 3) AS coverage FROM x4 GROUP BY qid, ticker HAVING max(got) / any_value(total) >= 0.75 AND max(CASE WHEN hit THEN got END) >= max(got) - 1e-9""")
def names_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against names as phrases with gaps."""
    index = companies.name_index(_passage_names(spark, sf_dir).select("ticker", "name"))
    return companies.by_name(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question")), index)


# --- questions ---------------------------------------------------------------------------------------------------------

_LIST = [("AAA", "CTCP Nhựa An Phát Xanh"), ("FPT", "CTCP FPT"), ("FTS", "CTCP Chứng khoán FPT"), ("VCB", "Ngân hàng TMCP Ngoại thương Việt Nam"), ("HPG", "CTCP Tập đoàn Hòa Phát"), ("GAS", "Tổng công ty Khí Việt Nam"), ("VNM", "CTCP Sữa Việt Nam"), ("DXG", "CTCP Tập đoàn Đất Xanh"), ("PDR", "CTCP Phát triển Bất động sản Phát Đạt")]
_ASKED = [
    ("Tổng tài sản của HPG năm {y} là bao nhiêu tỷ đồng?", "HPG", "{y}", "vnd", 1e9, None, "AGGREGATE", 1, "TONG TAI SAN CUA NAM"),
    ("Chứng khoán FPT năm {y} lãi bao nhiêu?", "FTS", "{y}", "vnd", 1.0, None, "", 1, "NAM LAI"),
    ("ROE của Vietcombank từ {p} đến {y} là bao nhiêu phần trăm?", "VCB", "{p},{y}", "percent", 1.0, None, "RATIO", 2, "ROE CUA TU DEN"),
    ("Năm {y}, khi rà soát doanh thu hpg, vnm cuối năm, riêng lẻ", "HPG,VNM", "{y}", "vnd", 1.0, "end", "", 2, "KHI RA SOAT DOANH THU CUOI RIENG LE"),
    ("Có bao nhiêu công ty có lợi nhuận?", "", "", "count", 1.0, None, "COUNT", 2, "CO CONG TY CO LOI NHUAN"),
    ("Năm nào FPT đạt doanh thu cao nhất giai đoạn {p}-{y}?", "FPT", "{p},{y}", "year", 1.0, None, "SUPERLATIVE", 3, "NAM NAO DAT DOANH THU CAO NHAT GIAI DOAN -"),
]


def _ask(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    q = _deal(spark, sf_dir, "question string", [c[:1] for c in cases]).select(F.col("p_partkey").alias("id"), "question")
    return questions.parse(q, spark.createDataFrame(_LIST, "ticker string, name string")).withColumnRenamed("qid", "p_partkey")


@query(_dealt_sql([c[1:] for c in _ASKED], {"tickers": "string", "years": "string", "unit_kind": "string", "unit_scale": "double", "time_point": "string", "ops": "string", "tier": "int", "retrieval_query": "string"}))
def question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _ask(spark, sf_dir, _ASKED)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return q.select("p_partkey", joined("tickers"), joined("years"), "unit_kind", "unit_scale", "time_point", joined("ops"), "tier", "retrieval_query")


_NAMED = [("CTCP Chứng khoán FPT năm {y}", "FTS"), ("FPT và FTS: {w}", "FPT,FTS"), ("gas trong nhà {n}", ""), ("Tập đoàn Hòa Phát, {w}", "HPG"), ("Bất động sản Đất Xanh {y}", ""), ("vnm, gas, hpg", "VNM,GAS,HPG"), ("không có ai {n}", ""), ("{y}: Sữa Việt Nam", "VNM")]


@query(_dealt_sql([c[1:] for c in _NAMED], {"tickers": "string"}))
def company_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, _NAMED).select("p_partkey", F.array_join("tickers", ",").alias("tickers"))


golden(
    "complexity_gate", "question string, ops string",
    [("Doanh thu của {w} năm {y}", "", False), ("Trong nhóm công ty có doanh thu {y}", "", True), ("Doanh thu và chi phí {w}", "", True), ("Doanh thu {w}", "MEDIAN", True), ("Tại năm mà Hòa Phát đạt doanh thu cao nhất từ {y}", "", True), ("Doanh thu của công ty cổ phần {w}", "", False)],
    {"hard": "boolean"}, lambda d: {"hard": questions.too_complex(d["question"], F.split(d["ops"], ","))},
)
golden(
    "named_ratio", "question string",
    [("ROE của {w} năm {y}", "LOI_NHUAN_SAU_THUE/VON_CHU_SO_HUU"), ("ROE và ROA năm {y}", None), ("Vòng quay hàng tồn kho {y}", "GIA_VON_HANG_BAN/HANG_TON_KHO"), ("doanh thu {w}", None)],
    {"ratio": "string"}, lambda d: {"ratio": text.let(questions.named_ratio(F.lit(""), d["question"]), lambda r: F.when(r.isNotNull(), F.concat(r["numerator"], F.lit("/"), r["denominator"])))},
)
golden(
    "ratio_sides", "query string",
    [("TY TRONG {W} TREN TONG TAI SAN CUOI NAM", "{W}", "TONG TAI SAN"), ("{W} GAP LAN VON CHU SO HUU", "{W}", "VON CHU SO HUU"), ("A TREN B", None, None), ("{W}", None, None)],
    {"a": "string", "b": "string"}, lambda d: {"a": questions.ratio_sides(d["query"])["numerator"], "b": questions.ratio_sides(d["query"])["denominator"]},
)


# --- answers -----------------------------------------------------------------------------------------------------------


def _irs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _once(spark, sf_dir, f"questions-{kind}", lambda: questions.parse(statements.questions(spark, sf_dir, kind), statements.companies(spark, sf_dir)))


def _solved(kind: str, sql: str) -> None:
    """Registers solve_<kind>: questions of the kind answered from statements; sql gives qid and value from truth."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return solve.solve(_irs(spark, sf_dir, kind), _facts(spark, sf_dir)).select("qid", "kind", F.round("value", 6).alias("value"))

    QUERIES[f"solve_{kind}"] = run
    SQL[f"solve_{kind}"] = f"WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL} {sql}"


_solved("growth", "SELECT qid, 'GROWTH' AS kind, round((y.revenue - x.revenue) / abs(x.revenue) * 100.0, 6) AS value FROM q JOIN truth x ON x.ticker = a AND x.year = q.y JOIN truth y ON y.ticker = a AND y.year = q.y + 1")
_solved("diff", "SELECT qid, 'DIFF' AS kind, CAST(abs(x.revenue - y.revenue) AS DOUBLE) AS value FROM q JOIN truth x ON x.ticker = a AND x.year = q.y JOIN truth y ON y.ticker = b AND y.year = q.y")
_solved("sum", "SELECT qid, 'SUM' AS kind, round(sum(CAST(revenue AS DOUBLE)) / 1000000.0, 6) AS value FROM q JOIN truth ON ticker IN (a, b, c) AND year = q.y GROUP BY qid HAVING count(*) >= 2")
_solved("avg", "SELECT qid, 'AVG' AS kind, round(avg(CAST(revenue AS DOUBLE)), 6) AS value FROM q JOIN truth ON ticker = a AND year BETWEEN q.y AND q.y + 2 GROUP BY qid HAVING count(*) >= 2")
_solved("max", "SELECT qid, 'MAX' AS kind, CAST(max(revenue) AS DOUBLE) AS value FROM q JOIN truth ON ticker = a AND year BETWEEN q.y AND q.y + 2 GROUP BY qid HAVING count(*) >= 2")
_solved("min", "SELECT qid, 'MIN' AS kind, CAST(min(revenue) AS DOUBLE) AS value FROM q JOIN truth ON ticker = a AND year BETWEEN q.y AND q.y + 2 GROUP BY qid HAVING count(*) >= 2")
_solved("argmax", "SELECT qid, 'ARGMAX_YEAR' AS kind, CAST(max_by(year, revenue) AS DOUBLE) AS value FROM q JOIN truth ON ticker = a AND year BETWEEN q.y AND q.y + 2 GROUP BY qid HAVING count(*) >= 2")
_solved("ratio", "SELECT qid, 'RATIO' AS kind, round(CAST(gross AS DOUBLE) / abs(revenue) * 100.0, 6) AS value FROM q JOIN truth ON ticker = a AND year = q.y")
_solved("ratio_ab", "SELECT qid, 'RATIO_AB' AS kind, round(abs(CAST(cost AS DOUBLE)) / abs(revenue) * 100.0, 6) AS value FROM q JOIN truth ON ticker = a AND year = q.y")


@query(f"WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL} SELECT qid, ticker, CAST(q.y AS INTEGER) AS period_year, 'Doanh thu thuần' AS label, CAST(revenue AS DOUBLE) AS value FROM q JOIN truth ON ticker IN (a, b, c) AND year = q.y")
def lookup_aligned_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lookup.lookup_aligned(_irs(spark, sf_dir, "sum"), _facts(spark, sf_dir))
    return a.select("qid", "ticker", "period_year", F.regexp_replace("label", r"^\d+\. ", "").alias("label"), "value")


@query(f"WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL} SELECT qid, CAST(revenue AS DOUBLE) AS value FROM q JOIN truth ON ticker = a AND year = q.y")
def lookup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _irs(spark, sf_dir, "ratio_ab").withColumn("retrieval_query", F.lit("DOANH THU THUAN"))
    return lookup.lookup(one, _facts(spark, sf_dir), 1).select("qid", "value")


@query(f"WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL} SELECT qid, CAST(equity AS DOUBLE) AS value FROM q JOIN truth ON ticker = a AND year = q.y")
def lookup_concept_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    ir = _irs(spark, sf_dir, "ratio")
    want = ir.select("qid", F.get("tickers", F.lit(0)).alias("ticker"), F.get("years", F.lit(0)).alias("year"), F.lit("VON_CHU_SO_HUU").alias("concept"))
    return lookup.lookup_concept(ir, _facts(spark, sf_dir), want).select("qid", "value")


@query(f"WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL} SELECT qid, CAST(2 AS INTEGER) AS table_idx, CAST(revenue AS DOUBLE) AS value FROM q JOIN truth ON ticker = a AND year = q.y")
def locate_best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    ir = _irs(spark, sf_dir, "ratio_ab").withColumn("retrieval_query", F.lit("DOANH THU THUAN"))
    t = _tables(spark, sf_dir)
    mine = ir.select("qid", F.get("tickers", F.lit(0)).alias("ticker"), F.get("years", F.lit(0)).alias("year")).join(t, ["ticker", "year"])
    return locate.locate_best(ir, mine.withColumn("place", F.col("table_idx"))).select("qid", "table_idx", "value")


@query(f"""WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL}, r AS (SELECT qid, y % 2 = 1 AS one, qid // 10000 % 3 AS k, count(*) AS n, max(revenue) AS best, max(revenue) FILTER (year = y) AS own FROM q JOIN truth ON ticker = a AND year BETWEEN y AND y + 2 GROUP BY ALL)
SELECT qid, CASE WHEN one THEN ['fact', 'cell', 'none'][k + 1] WHEN n >= 2 THEN 'solver:MAX' ELSE 'none' END AS route, CAST(CASE WHEN one THEN CASE WHEN k < 2 THEN own ELSE 0 END WHEN n >= 2 THEN best ELSE 0 END AS DOUBLE) AS answer FROM r""")
def route_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four routes: questions of even years go to the solver, those of odd ones ask for one value, which a fact, a cell or nothing gives."""
    f, y, k = _facts(spark, sf_dir), F.col("qid") % 10_000, F.floor(F.col("qid") / 10_000) % 3
    one = y % 2 == 1
    ir = _irs(spark, sf_dir, "max").withColumns({"years": F.when(one, F.array(y.cast("int"))).otherwise(F.col("years")), "ops": F.when(one, F.array().cast("array<string>")).otherwise(F.col("ops")), "retrieval_query": F.when(one, "DOANH THU THUAN").otherwise(F.col("retrieval_query"))})
    cells = ir.where(one & (k == 1))
    mine = cells.select("qid", F.get("tickers", F.lit(0)).alias("ticker"), F.get("years", F.lit(0)).alias("year")).join(_tables(spark, sf_dir), ["ticker", "year"])
    located = locate.locate_best(cells, mine.withColumn("place", F.col("table_idx")))
    return solve.route(ir, solve.solve(ir, f), lookup.lookup(ir.where(one & (k == 0)), f, 1), located).select("qid", "route", "answer")


golden(
    "unit_rescale", "value double, kind string, scale double",
    [("{m}e9", "vnd", 1e9, "{m}"), ("{n}", "percent", 1e9, "{n}"), ("{n}", "vnd", 1.0, "{n}"), ("{y}", "year", 1.0, "{y}")],
    {"answer": "double"}, lambda d: {"answer": solve.in_unit(d["value"], d["kind"], d["scale"])},
)
golden(
    "expense_magnitude", "value double, query string, ops string",
    [("-{n}", "CHI PHI {W}", "", "{n}"), ("-{n}", "CHI PHI {W}", "DIFF", "-{n}"), ("-{n}", "LOI NHUAN {W}", "", "-{n}"), ("{n}", "CHI PHI {W}", "", "{n}")],
    {"answer": "double"}, lambda d: {"answer": solve.expense_magnitude(d["value"], d["query"], F.split(d["ops"], ","))},
)
golden(
    "isclose_verify", "a double, b double",
    [("{n}", "{n}", True), ("{n}", "{n}.00001", True), ("{n}", "{n}.1", False), (0.0, "{n}e-12", True), (None, "{n}", False), ("{n}e300", "{n}e300", True)],
    {"close": "boolean"}, lambda d: {"close": numbers.is_close(d["a"], d["b"])},
)


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread FROM lineitem GROUP BY 1")
def plan_ir_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(F.sum("l_extendedprice"), F.max("l_extendedprice"), F.min("l_extendedprice")).alias("cells"))
    at = lambda i: {"node": "cell", "index": i}
    spread = {"node": "abs", "of": {"node": "arith", "op": "-", "of": [at(1), at(2)]}}
    return li.select("l_orderkey", F.round(plan_ir.value(at(0), F.col("cells")), 2).alias("total"), F.round(F.expr(plan_ir.to_sql(spread)), 2).alias("spread"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey GROUP BY 1")
def plan_ir_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"df1": table(spark, sf_dir, "orders"), "df2": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")}
    segment = {"node": "filter", "of": {"node": "evidence", "name": "df2"}, "column": "c_mktsegment", "op": "=", "value": "BUILDING"}
    plan = {"node": "aggregate", "by": ["o_orderstatus"], "of_columns": [["n", "count", "o_custkey"], ["total", "sum", "o_totalprice"]], "of": {"node": "join", "on": "o_custkey", "of": [{"node": "evidence", "name": "df1"}, segment]}}
    return plan_ir.table(plan, frames).withColumn("total", F.round("total", 2))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_extendedprice, l_quantity) - 1 AS nth FROM lineitem),
v AS (SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'R' AND nth = 0) AS first_, max(l_quantity) FILTER (l_returnflag = 'R' AND nth = 1) AS second_, max(l_extendedprice) FILTER (l_returnflag = 'R' AND nth = 2) AS third_, max(l_quantity) FILTER (l_returnflag = 'A' AND nth = 0) AS other FROM r GROUP BY 1)
SELECT l_orderkey, first_, second_, round(third_ * 0.5, 4) AS third_half, CAST(NULL AS DOUBLE) AS none, round(first_ - abs(other), 4) AS difference FROM v""")
def label_lookup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by label, column and occurrence: an order's items are a table whose labels repeat. The compiled columns and the SQL text must agree."""
    li = table(spark, sf_dir, "lineitem")
    cells = F.create_map(F.lit("so_luong"), F.col("l_quantity"), F.lit("gia"), F.col("l_extendedprice"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_quantity", F.concat(F.lit(" "), "l_returnflag").alias("label"), F.map_entries(cells).alias("c")))).alias("x"))
    rows = rows.select("l_orderkey", F.array(F.transform("x", lambda r: F.struct(r["label"].alias("label"), F.map_from_entries(r["c"]).alias("cells")))).alias("rows"))
    at = lambda label, column, nth, *more: plan_ir.from_cell(0, label, column, nth, *more)
    plans = {
        "first_": at("R", "so_luong", 0), "second_": at("R", "so_luong", 1), "third_half": at("R", "gia", 2, 0.5), "none": {"node": "arith", "op": "+", "of": [at("R", "khong", 0), at("X", "gia", 0)]},
        "difference": {"node": "arith", "op": "-", "of": [at("R", "so_luong", 0), at("A", "so_luong", 0, 1.0, True)]},
    }
    none = F.array().cast("array<double>")
    made = {k: plan_ir.value(p, none, F.col("rows")) for k, p in plans.items()}
    said = {k: F.expr(plan_ir.to_sql(p)) for k, p in plans.items()}
    return rows.select("l_orderkey", *(F.round(F.when(made[k].eqNullSafe(said[k]), made[k]).otherwise(F.raise_error(F.lit("compiled and said differ"))), 4).alias(k) for k in plans))


@query("SELECT 'price' AS of_, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem UNION ALL SELECT 'quantity', count(*), round(quantile_cont(l_quantity, 0.1), 6), round(quantile_cont(l_quantity, 0.5), 6), round(quantile_cont(l_quantity, 0.999), 6) FROM lineitem")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by histograms, no values sorted or gathered."""
    li, out = table(spark, sf_dir, "lineitem"), None
    for name, column in (("price", "l_extendedprice"), ("quantity", "l_quantity")):
        own = quality.quantiles(li, column, [0.1, 0.5, 0.999])
        row = li.agg(F.lit(name).alias("of_"), F.count("*").alias("n")).select("of_", "n", *(F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in zip(("p10", "median", "p999"), own)))
        out = row if out is None else out.unionAll(row)
    return out


# --- lifecycle ---------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return patch.last_write(c, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")]).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("WITH p AS (SELECT o_orderkey AS id, max(o_totalprice) AS a FROM orders GROUP BY 1), n AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS v, count(*) AS c FROM lineitem GROUP BY 1) SELECT p.id, round(CASE WHEN n.c % 2 = 0 THEN n.v ELSE p.a END, 2) AS answer, CASE WHEN n.id IS NULL THEN 'none' WHEN n.c % 2 = 1 THEN 'mismatch' ELSE 'applied' END AS status, coalesce(n.c % 2 = 0 AND abs(n.v - p.a) > 0.02 * abs(p.a), false) AS conflict FROM p LEFT JOIN n USING (id)")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.max("o_totalprice").alias("answer")).withColumn("evidence", F.array(F.lit("a"), F.lit("b")))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("new_answer"), F.count("*").alias("c"))
    new = new.withColumn("seen", F.when(F.col("c") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))).join(base.select("id", F.col("answer").alias("rule_answer")), "id", "left")
    # each id's line item of least number is an earlier line of the log, which the sums take back
    early = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.max("l_extendedprice") * 1000).alias("new_answer")).select("id", "new_answer", F.lit(None).cast("array<string>").alias("seen"), F.lit(None).cast("double").alias("rule_answer"), F.lit(1).alias("line"))
    log = early.unionByName(new.drop("c").withColumn("line", F.lit(2)))
    return patch.merge(base, log, [F.desc("line")]).select("id", F.round("answer", 2).alias("answer"), "status", "conflict")


golden(
    "evidence_prefix_guard", "local string, seen string",
    [("{s},b", "{s}", True), ("{s},b", "b", False), ("{s}", "{s},b", False), ("{s},{n}", "{s},{n}", True), ("{s}", None, True)],
    {"fits": "boolean"}, lambda d: {"fits": patch.prefix_fits(F.split(d["local"], ","), F.split(d["seen"], ","))},
)


@query("""WITH o AS (SELECT o_orderkey AS id, * FROM orders UNION ALL SELECT o_orderkey, * FROM orders WHERE o_orderkey % 10 = 0),
e AS (SELECT id, 'repeated id' AS error FROM (SELECT id FROM o GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT id, 'answer is not a number' FROM o WHERE o_totalprice < 1000 OR id % 17 = 0 UNION ALL SELECT id, 'no tables' FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT id, 'malformed reference' FROM o WHERE o_orderstatus <> 'P' AND id % 7 = 1 UNION ALL SELECT id, 'path outside data/' FROM o WHERE id % 11 = 2 UNION ALL SELECT id, 'missing file' FROM o WHERE id % 11 = 2 OR id % 13 = 3 UNION ALL SELECT id, 'blank query' FROM o WHERE o_orderpriority LIKE '1%')
SELECT id, error, count(*) AS n FROM e GROUP BY ALL""")
def submission_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over orders as answers, some of them twice."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    o = o.unionAll(o.where(key % 10 == 0))
    path = F.when(key % 11 == 2, "tmp/a.csv").when(key % 13 == 3, "data/gone.csv").otherwise("data/a.csv")
    answers = o.select(
        key.alias("id"), F.when(F.col("o_totalprice") < 1000, F.lit(None)).when(key % 17 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("answer"),
        F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).when(key % 7 == 1, F.array(F.lit("d1"))).otherwise(F.array(F.lit("d|1"))).alias("relevant_tables"),
        F.array(F.struct(F.lit("df1").alias("variable"), path.alias("csv_path"))).alias("evidence"), F.when(F.col("o_orderpriority").startswith("1"), " ").otherwise("x").alias("query"),
    )
    files = spark.createDataFrame([("a.csv",)], "file string")
    return emit.validate(answers, files).groupBy("id", "error").agg(F.count("*").alias("n"))


@query("SELECT conv_id, array_to_string(list_transform(list_sort(list(p)), lambda x: x.r), ',') AS roles FROM (SELECT conv_id, {'m': min(turn), 'r': role} AS p FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("roles"))
    r = emit.records(c.select(F.col("conv_id").alias("id"), F.col("roles").alias("relevant_docs"), F.col("roles").alias("relevant_tables")))
    return r.select(F.col("id").alias("conv_id"), F.array_join("relevant_docs", ",").alias("roles"))


@query("SELECT event_type AS route, count(*) AS n, round(avg(abs(value)), 4) AS mean_abs FROM events GROUP BY 1")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.trace_stats(table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("value").alias("answer")), "route")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_struct_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_partkey, p_name || '|' || CAST(p_size AS VARCHAR) AS ref, array_to_string(list_transform(list_sort(list_distinct(list_filter([p_partkey, p_size, p_partkey % 7, CASE WHEN p_size % 5 <> 0 THEN p_partkey * 3 END], lambda x: x IS NOT NULL))), lambda x: p_name || '_extracted|' || CAST(x AS VARCHAR)), ';') AS refs FROM part")
def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four encodings of a position, some the same, one missing for every fifth size."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("doc_id"), key.alias("table_idx"), size.alias("line_no"), (key % 7).alias("page_no"), F.when(size % 5 != 0, key * 3).alias("char_start"))
    by_number = F.array_sort(emit.table_refs("file_stem"), lambda a, b: (F.substring_index(a, "|", -1).cast("long") - F.substring_index(b, "|", -1).cast("long")).cast("int"))
    return p.select("p_partkey", emit.table_ref("line_no").alias("ref"), F.array_join(by_number, ";").alias("refs"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.array(F.struct(F.concat(F.lit("data/f"), F.col("l_partkey").cast("string")).alias("csv_path"))).alias("evidence"))
    return emit.unused_files(files, used).select("p_partkey")


golden(
    "preview_columns", "columns string, budget int",
    [("{s},b,c,nam_2020,{n}", 4, "{s},b,nam_2020,c"), ("{s},b", 4, "{s},b"), ("{s},b,c,d,{n}", 3, "{s},b,c")],
    {"kept": "string"}, lambda d: {"kept": F.array_join(prompts.pick_columns(F.split(d["columns"], ","), F.array(F.lit(2020)), d["budget"]), ",")},
)
@query(f"""WITH {statements.TRUTH_SQL}, {statements.QUESTIONS_SQL}, e AS (SELECT qid, count(*) AS n FROM q JOIN truth ON ticker = a AND year = y GROUP BY 1)
SELECT qid, CAST(2 * n AS INTEGER) AS n_tables, CAST(30 AS INTEGER) AS n_rows, 'CÂU HỎI: Doanh thu thuần cao nhất của ' || a || ' trong giai đoạn ' || y || '-' || (y + 2) || ' là bao nhiêu đồng?' AS first_line, CAST(4 * n AS BIGINT) AS quotes, 'chi_tieu,ma_so,nam_' || y || ',nam_' || (y - 1) AS flow_header, true AS whole FROM q JOIN e USING (qid)""")
def prompts_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's prompt with the tables of its first year's report, in one job; characters stand in for tokens."""
    ir = _irs(spark, sf_dir, "max")
    t = emit.evidence(_tables(spark, sf_dir)).join(_tables(spark, sf_dir).select("doc_id", "table_idx", "ticker", "year"), ["doc_id", "table_idx"])
    mine = ir.select("qid", F.get("tickers", F.lit(0)).alias("ticker"), F.get("years", F.lit(0)).alias("year")).join(t, ["ticker", "year"])
    made = prompts.assemble(prompts.inputs(ir, mine.withColumn("place", F.col("table_idx"))), lambda: lambda lines: [len(x) + 1 for x in lines], 20_000)
    header = F.regexp_extract("prompt", r"(?s)df2 .*?```csv\n(.*?)\n", 1)
    return made.select(
        F.col("qid").cast("int").alias("qid"), "n_tables", "n_rows", F.split("prompt", "\n")[0].alias("first_line"), F.regexp_count("prompt", F.lit("```")).cast("long").alias("fences"), header.alias("flow_header"),
        (F.length("prompt") + 1 == F.col("size")).alias("whole"),
    ).withColumnRenamed("fences", "quotes")


golden(
    "fenced_code", "answer string",
    [("{w} ```python\ndf{n}\n``` y", "df{n}"), ("df1 + {n}", "df1 + {n}"), ("```\n{w}\n```\n```\nb\n```", "{w}")],
    {"code": "string"}, lambda d: {"code": prompts.fenced(d["answer"])},
)


golden(
    "planner_scope", "ops string, unit string, tier int",
    [("RATIO,AGGREGATE", "vnd", 1, True), ("AGGREGATE", "vnd", 2, False), ("AGGREGATE", "pp", 1, True), ("", "vnd", 3, True), ("", "vnd", 1, False), (None, None, None, False), (None, "year", None, True)],
    {"hard": "boolean"}, lambda d: {"hard": planner.in_scope(F.split(d["ops"], ","), d["unit"], d["tier"], "hard")},
)


def _rule_planner():
    """A planner by rule: states a number for every third prompt, but with some temperature only for the odd ones of these."""

    def answer(prompts: list[str], temperature: float) -> list[str]:
        bad = [int(p) % 3 == 0 and (not temperature or int(p) % 2 == 1) for p in prompts]
        return [f"So:\n```python\ndf1.iloc[0, 1]{' + 123456' if b else ''}\n```" for b in bad]

    return answer


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 <> 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS attempt, p_partkey % 3 <> 0 OR p_partkey % 2 = 0 AS ok FROM part GROUP BY p_partkey")
def planner_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("prompt")).distinct()
    return planner.plan(asked, _rule_planner, shared_path(spark, "planner")).select("id", "attempt", "ok")


_PROBED_SQL = "h AS (SELECT p_size AS qid, p_partkey AS t, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM (SELECT DISTINCT p_size, p_partkey FROM part))"


@query(f"""WITH {_PROBED_SQL}, r AS (
  SELECT tag, qid, 'D' || CAST(qid AS VARCHAR) || suffix || '|' || CAST(unnest([t, 3 * t, qid]) AS VARCHAR) AS ref FROM h, (VALUES ('probe1_all_folder', ''), ('probe2_all_stem', '_extracted')) v(tag, suffix) WHERE n = 1
  UNION ALL SELECT tag, qid, 'D' || CAST(qid AS VARCHAR) || '_extracted|' || CAST(CASE tag WHEN 'probe_table_idx' THEN t WHEN 'probe_line_no' THEN 3 * t ELSE qid END AS VARCHAR) FROM h, (VALUES ('probe_table_idx'), ('probe_line_no'), ('probe_page_no')) v(tag) WHERE n <= 2
) SELECT tag, qid, array_to_string(list_sort(list(DISTINCT ref)), ',') AS refs FROM r GROUP BY 1, 2""")
def probe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_size", "p_partkey").distinct()
    hits = p.select(
        F.col("p_size").alias("qid"), retrieve.rank_from([F.col("p_partkey")], "p_size").alias("rank"), F.concat(F.lit("D"), F.col("p_size").cast("string")).alias("doc_id"),
        F.col("p_partkey").alias("table_idx"), (F.col("p_partkey") * 3).alias("line_no"), F.col("p_size").alias("page_no"), F.lit(None).cast("long").alias("char_start"),
    )
    both = probes.probe(hits, 1).unionByName(probes.probe(hits, 2, "file_stem"))
    return both.select("tag", "qid", F.array_join(F.array_sort("refs"), ",").alias("refs"))


@query(_DOCS_SQL + " SELECT doc_id || '_table_' || CAST(x.i AS VARCHAR) || '.csv' AS file, CAST(x.n + 1 AS INTEGER) AS n_rows, 'chi_tieu' AS first_column, x.l AS first_label, (SELECT count(*) FROM docs) AS records FROM docs, (VALUES (1, 6, 'A. TÀI SẢN NGẮN HẠN'), (2, 4, '3. Doanh thu thuần')) AS x(i, n, l)")
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission with its evidence as ZIP archives, written and read back by the tasks."""
    path, t = shared_path(spark, "package"), _tables(spark, sf_dir)
    answers = t.where("table_idx = 1").select(F.xxhash64("doc_id").alias("id"), F.array("doc_id").alias("relevant_docs"), F.array(emit.table_ref()).alias("relevant_tables"), F.lit("plan").alias("query"))
    emit.package(answers, emit.evidence(t), path)
    records, files = reports.read_package(spark, path)
    n = records.select(F.get_json_object("record", "$.id").alias("id")).distinct().agg(F.count("*").alias("records"))
    rows = files.select(F.regexp_replace("file", "^data/", "").alias("file"), F.size("rows").alias("n_rows"), F.col("rows")[0][0].alias("first_column"), F.col("rows")[1][0].alias("first_label"))
    return rows.crossJoin(F.broadcast(n))  # one row


@query(_DOCS_SQL + " SELECT doc_id, CAST(x.i AS INTEGER) AS table_idx, CAST(x.n + 1 AS INTEGER) AS n_rows FROM docs, (VALUES (1, 6), (2, 4)) AS x(i, n) WHERE year % 2 = x.i % 2")
def grid_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids by key: of each report one table, some keys that no table has."""
    path, t = shared_path(spark, "grids"), _tables(spark, sf_dir)
    grid_store.save(t, path)
    keys = t.select("doc_id", (F.lit(2) - F.col("year") % 2).cast("int").alias("table_idx")).unionAll(t.select(F.concat("doc_id", F.lit("x")), "table_idx"))
    return grid_store.fetch(spark, path, keys, ["grid"]).select("doc_id", "table_idx", F.size("grid").alias("n_rows"))


@query(_DOCS_SQL + """ SELECT doc_id, year, CAST(x.i AS INTEGER) AS table_idx, CAST(CASE WHEN year % 3 = 0 THEN 1 ELSE x.n + 1 END AS INTEGER) AS n_rows, CAST(CASE WHEN year % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_tables
FROM docs, (VALUES (1, 6), (2, 4)) AS x(i, n) WHERE NOT (year % 3 = 0 AND x.i = 2)""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files in three arrivals, the stream started anew each time: some companies, all of them (the first ones again, unchanged), and later versions of some years."""
    from tablemill.streaming import ingest

    files, base = store(statements.render(spark, sf_dir), "reports"), shared_path(spark, "ingest")
    year = F.regexp_extract("path", r"/(\d{4})/", 1).cast("int")
    later = files.where(year % 3 == 0).select(F.concat(F.lit("late/"), "path").alias("path"), F.lit("BẢNG CÂN ĐỐI KẾ TOÁN\n<table><tr><td>x</td></tr></table>").alias("text"))
    for k, part in enumerate((files.where(F.crc32("path") % 2 == 0), files.select(F.concat(F.lit("again/"), "path").alias("path"), "text"), later)):
        if k == 2:
            time.sleep(1.1)  # a later version has a later file time, to the second
        reports.write_files(part, f"{base}/in")
        ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    docs, tables_ = ingest.current(spark, f"{base}/out")
    return tables_.join(docs.select("doc_id", "n_tables"), "doc_id").select("doc_id", "year", "table_idx", "n_rows", "n_tables")


@query("SELECT c_nationkey AS ticker, count(*) AS n FROM customer GROUP BY 1")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of the table's rows adds up to, one micro-batch at a time, equals the table's own counts."""
    from tablemill.streaming import replay

    return replay.counts(spark, f"{sf_dir}/customer.parquet", "c_nationkey").withColumnRenamed("c_nationkey", "ticker")
