"""Synthetic annual reports from the star-schema tables, so that the whole engine can be tested against plain SQL.

A nation is a company (N00, N01, …), an order's year plus 20 its fiscal year. Sums over orders and lineitems, in whole units, are
written as Vietnamese statements with page marks, form headings and HTML tables; reading these back must give the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years that are added to an order's year.
YEAR_SHIFT = 20

#: Line items: statement, code, label, column of `truth`, concept.
LINES = [
    ("CDKT", "100", "A. TÀI SẢN NGẮN HẠN", "current_assets", "TAI_SAN_NGAN_HAN"),
    ("CDKT", "200", "B. TÀI SẢN DÀI HẠN", "fixed_assets", "TAI_SAN_DAI_HAN"),
    ("CDKT", "270", "TỔNG CỘNG TÀI SẢN", "total_assets", "TONG_TAI_SAN"),
    ("CDKT", "300", "C. NỢ PHẢI TRẢ", "liabilities", "NO_PHAI_TRA"),
    ("CDKT", "400", "D. VỐN CHỦ SỞ HỮU", "equity", "VON_CHU_SO_HUU"),
    ("CDKT", "440", "TỔNG CỘNG NGUỒN VỐN", "total_sources", "TONG_NGUON_VON"),
    ("KQKD", "10", "3. Doanh thu thuần", "revenue", "DOANH_THU_THUAN"),
    ("KQKD", "11", "4. Giá vốn hàng bán", "cost", "GIA_VON_HANG_BAN"),
    ("KQKD", "20", "5. Lợi nhuận gộp", "gross", "LOI_NHUAN_GOP"),
    ("KQKD", "60", "18. Lợi nhuận sau thuế", "net", "LOI_NHUAN_SAU_THUE"),
]


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, year, revenue, cost, …): whole units, exact in integers; costs are negative."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cents = lambda c: F.sum(F.round(c * 100, 0).cast("long"))
    whole = lambda c: F.expr(f"{c} div 100")
    who = read("customer").join(F.broadcast(read("nation").select("n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few
    who = who.select("c_custkey", F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ticker"))
    orders = read("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate") + YEAR_SHIFT)
    sheet = orders.groupBy("ticker", "year").agg(cents(F.col("o_totalprice")).alias("a"), cents(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("c"), cents(F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice")).otherwise(0.0)).alias("l"))
    items = read("lineitem").join(orders.select("o_orderkey", "ticker", "year"), F.col("l_orderkey") == F.col("o_orderkey"))
    flow = items.groupBy("ticker", "year").agg(cents(F.col("l_extendedprice")).alias("r"), cents(F.col("l_extendedprice") * F.col("l_discount")).alias("d"), cents(F.col("l_extendedprice") * F.col("l_tax")).alias("t"))
    t = sheet.join(flow, ["ticker", "year"])
    t = t.select("ticker", "year", whole("c").alias("current_assets"), whole("a").alias("total_assets"), whole("l").alias("liabilities"), whole("r").alias("revenue"), (-whole("d")).alias("cost"), whole("t").alias("_t"))
    return t.withColumns({"fixed_assets": F.col("total_assets") - F.col("current_assets"), "equity": F.col("total_assets") - F.col("liabilities"), "total_sources": F.col("total_assets"), "gross": F.col("revenue") + F.col("cost")}).withColumn("net", F.col("gross") - F.col("_t")).drop("_t")


#: The same in DuckDB SQL, as a common table expression `truth`.
TRUTH_SQL = """
who AS (SELECT c_custkey, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker FROM customer JOIN nation ON c_nationkey = n_nationkey),
own AS (SELECT o_orderkey, ticker, CAST(year(o_orderdate) + 20 AS INTEGER) AS year, o_totalprice AS p, o_orderstatus AS s, o_orderpriority AS q FROM orders JOIN who ON o_custkey = c_custkey),
sheet AS (SELECT ticker, year, sum(CAST(round(p * 100, 0) AS BIGINT)) AS a, sum(CASE WHEN s = 'F' THEN CAST(round(p * 100, 0) AS BIGINT) ELSE 0 END) AS c, sum(CASE WHEN q < '3' THEN CAST(round(p * 100, 0) AS BIGINT) ELSE 0 END) AS l FROM own GROUP BY ALL),
flow AS (SELECT ticker, year, sum(CAST(round(l_extendedprice * 100, 0) AS BIGINT)) AS r, sum(CAST(round(l_extendedprice * l_discount * 100, 0) AS BIGINT)) AS d, sum(CAST(round(l_extendedprice * l_tax * 100, 0) AS BIGINT)) AS t FROM lineitem JOIN own ON l_orderkey = o_orderkey GROUP BY ALL),
whole AS (SELECT ticker, year, CAST(a // 100 AS BIGINT) AS total_assets, CAST(c // 100 AS BIGINT) AS current_assets, CAST(l // 100 AS BIGINT) AS liabilities, CAST(r // 100 AS BIGINT) AS revenue, CAST(-(d // 100) AS BIGINT) AS cost, CAST(t // 100 AS BIGINT) AS tax FROM sheet JOIN flow USING (ticker, year)),
truth AS (SELECT *, total_assets - current_assets AS fixed_assets, total_assets - liabilities AS equity, total_assets AS total_sources, revenue + cost AS gross, revenue + cost - tax AS net FROM whole)
"""


def money(x: Column) -> Column:
    """1.234.567, negatives in parentheses, null as a dash."""
    shown = F.translate(F.format_number(F.abs(x), 0), ",", ".")
    return F.when(x.isNull(), "-").when(x < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def _table(statement: str, heads: list[Column]) -> Column:
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    rows = [F.concat(F.lit("<tr>"), cell(F.lit("Chỉ tiêu")), cell(F.lit("Mã số")), *map(cell, heads), F.lit("</tr>"))]
    for own, code, label, column, _ in LINES:
        if own == statement:
            rows.append(F.concat(F.lit("<tr>"), cell(F.lit(label)), cell(F.lit(code)), cell(money(F.col(column))), cell(money(F.col(f"last_{column}"))), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), *rows, F.lit("</table>"))


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): one report a company and year, each with the year before in its second column."""
    t = truth(spark, sf_dir)
    columns = [c for c in t.columns if c not in ("ticker", "year")]
    last = t.select("ticker", (F.col("year") + 1).alias("year"), *(F.col(c).alias(f"last_{c}") for c in columns))
    t = t.join(last, ["ticker", "year"], "left")
    y = F.col("year").cast("string")
    text = F.concat_ws(
        "\n",
        F.lit("===== PAGE 1 ====="), F.concat(F.lit("Báo cáo tài chính của "), "ticker"), F.lit("BẢNG CÂN ĐỐI KẾ TOÁN"), F.lit("Mẫu số B 01 – DN"), F.lit("Đơn vị tính: VND"),
        _table("CDKT", [F.concat(F.lit("31/12/"), y), F.concat(F.lit("01/01/"), y)]),
        F.lit("===== PAGE 2 ====="), F.lit("BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH"), F.lit("Đơn vị tính: VND"),
        _table("KQKD", [F.concat(F.lit("Năm "), y), F.concat(F.lit("Năm "), (F.col("year") - 1).cast("string"))]),
        F.lit(""),
    )
    doc = F.concat("ticker", F.lit("_"), y, F.lit("_consolidated"))
    return t.select(F.concat_ws("/", F.lit("reports"), "ticker", y, doc, F.concat(doc, F.lit("_extracted.txt"))).alias("path"), text.alias("text"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ticker"), F.concat(F.lit("Tổng công ty "), F.translate("n_name", "_", " ")).alias("name"))


#: Questions by kind: the text with {a}, {b}, {c} for companies and {y}, {z} for years.
QUESTIONS = {
    "growth": "Tốc độ tăng trưởng doanh thu thuần của {a} năm {z} so với năm {y} là bao nhiêu phần trăm?",
    "diff": "Chênh lệch doanh thu thuần giữa {a} và {b} năm {y} là bao nhiêu đồng?",
    "sum": "Tổng doanh thu thuần của {a}, {b} và {c} năm {y} là bao nhiêu triệu đồng?",
    "avg": "Doanh thu thuần trung bình của {a} trong giai đoạn {y}-{z} là bao nhiêu đồng?",
    "max": "Doanh thu thuần cao nhất của {a} trong giai đoạn {y}-{z} là bao nhiêu đồng?",
    "min": "Doanh thu thuần thấp nhất của {a} trong giai đoạn {y}-{z} là bao nhiêu đồng?",
    "argmax": "Năm nào {a} đạt doanh thu thuần lớn nhất trong giai đoạn {y}-{z}?",
    "ratio": "Biên lợi nhuận gộp của {a} năm {y} là bao nhiêu phần trăm?",
    "ratio_ab": "Tỷ lệ giá vốn hàng bán trên doanh thu thuần của {a} năm {y} là bao nhiêu phần trăm?",
}


#: Companies whose next two are companies too, so that a question can name three.
LAST_FIRST = 22


def questions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(id, question): one for each company up to LAST_FIRST, with the next two, and each of its years {y}; {z} is two years on, for growth one. id: company * 10000 + year."""
    k = F.substring("ticker", 2, 9).cast("int")
    t = truth(spark, sf_dir).select("ticker", "year").where(k <= LAST_FIRST)
    name = lambda i: F.concat(F.lit("N"), F.lpad((k + i).cast("string"), 2, "0"))
    out = F.lit(QUESTIONS[kind])
    for mark, by in (("{a}", name(0)), ("{b}", name(1)), ("{c}", name(2)), ("{y}", F.col("year").cast("string")), ("{z}", (F.col("year") + (1 if kind == "growth" else 2)).cast("string"))):
        out = F.replace(out, F.lit(mark), by)
    return t.select((k * 10_000 + F.col("year")).cast("int").alias("id"), out.alias("question"))


#: The same ids and names in DuckDB SQL, after TRUTH_SQL: q (qid, a, b, c, y).
QUESTIONS_SQL = f"q AS (SELECT CAST(k * 10000 + year AS INTEGER) AS qid, ticker AS a, 'N' || lpad(CAST(k + 1 AS VARCHAR), 2, '0') AS b, 'N' || lpad(CAST(k + 2 AS VARCHAR), 2, '0') AS c, year AS y FROM (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS k FROM truth) WHERE k <= {LAST_FIRST})"
