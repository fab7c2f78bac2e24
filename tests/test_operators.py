"""Units of the report engine: traps, ties, nulls and empty inputs."""

from __future__ import annotations

import json
import os
import random
import time
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablemill.functions import numbers, text, vectors
from tablemill.operators import bm25, documents, emit, facts, locate, lookup, patch, prompts, quality, questions, retrieve, solve, verify
from tablemill.operators import vectors as search
from tablemill.plans import ir
from tablemill.sources import archives, grid_store, html, reports, scan, statements
from tablemill.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def report_docs(spark, sf):
    return reports.documents(statements.render(spark, sf)).cache()


@pytest.fixture(scope="module")
def report_facts(spark, report_docs):
    return facts.extract(reports.tables(report_docs)).cache()


def test_fold_vietnamese(spark):
    assert one(spark, text.fold(F.lit("  KẾT QUẢ  Đơn vị "))) == "KET QUA DON VI"
    assert one(spark, text.fold(F.lit(None).cast("string"))) == ""
    assert one(spark, text.tokens(F.lit("Lợi nhuận sau thuế (60)"))) == ["LOI", "NHUAN", "SAU", "THUE", "60"]


def test_short_phrases_do_not_count_down(spark):
    assert one(spark, text.phrase_score(F.array(F.lit("A")), F.lit("A"))) == 0
    assert one(spark, text.phrase_score(F.array().cast("array<string>"), F.lit("A"))) == 0


def test_antonyms_veto(spark):
    q = F.array(*map(F.lit, "DAU TU TAI CHINH DAI HAN".split()))
    assert one(spark, text.label_score(q, F.lit("Đầu tư tài chính ngắn hạn"))) == 0
    assert one(spark, text.label_score(q, F.lit("Đầu tư tài chính dài hạn"))) > 0.8


def test_half_even(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, numbers.adaptive_k(a("A"), a(2020), a("RATIO"))) == 4


@pytest.mark.parametrize("raw", ["<table><tr><td>a", "<table><tr><td>a<![foo[x]]></td>", "<td>x</td>", "<table><table></table>", "<tr><td rowspan='x'>1", "&lt;"])
def test_html_never_fails(raw):
    assert all(isinstance(r, list) for r in html.html_to_grid(raw))


def test_scan_of_lines():
    long = "x" * 301
    text = "\n".join(["===== PAGE 7 =====", "Mẫu B02/TCTD", "  caption one ", long, " " * 150 + "far" + " " * 150, "", *[f"line {i}" for i in range(12)], "a<table>1", "</table>b<TABLE>2</TABLE>", "===== PAGE 99999999999 =====", "Thuyết minh", "<table>3</table>", "<table>"])
    found = list(scan.find_tables(text))
    assert [(t.table_idx, t.line_no, t.page_no, t.section) for t in found] == [(1, 19, 7, "CDKT"), (2, 20, 7, "CDKT"), (3, 23, None, "TM")]
    assert all(text[t.char_start : t.char_end].lower().startswith("<table>") and text[t.char_start : t.char_end].lower().endswith("</table>") for t in found)
    assert found[0].caption == "line 9 | line 10 | line 11" and found[2].caption.endswith("</table>b<TABLE>2</TABLE> | Thuyết minh")
    (first,) = scan.find_tables("caption one\n" + long + "\n" + " " * 150 + "far" + " " * 150 + "\n<table></table>")
    assert first.caption == "caption one | far" and first.section == "OTHER" and first.page_no is None
    assert list(scan.find_tables("")) == list(scan.find_tables("<table>" * 50_000)) == []


def test_scan_is_linear():
    import time

    def took(n):
        text = "caption\n<table><tr><td>1</table>\n" * n
        began = time.perf_counter()
        assert sum(1 for _ in scan.find_tables(text)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(20_000) < 60 * max(took(1000), 1e-3)


def test_scan_of_rows(spark):
    """Rows with one id, with none and without text; no exchange in the plan."""
    two = "<table><tr><td>a</table>\n<table><tr><td>b<![x[</table>"
    docs = spark.createDataFrame([("d", "T", 2020, "x", two), ("d", "T", 2020, "x", "<table>c</table>"), (None, "T", None, None, two), (None, None, None, None, two), ("e", "T", 2020, "x", None), ("f", "T", 2020, "x", "")], "doc_id string, ticker string, year int, stmt_type string, text string")
    t = reports.tables(docs)
    assert sorted((r["doc_id"] or "", r["table_idx"]) for r in t.collect()) == [("", 1), ("", 1), ("", 2), ("", 2), ("d", 1), ("d", 1), ("d", 2)]
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    assert t.where("table_idx = 2").select("grid").distinct().first()[0] == [["b"]]
    faults = scan.scan(docs).where("fault is not null")
    assert sorted((r["doc_id"] or "", r["stage"]) for r in faults.collect()) == [("", "html"), ("", "html"), ("d", "html"), ("e", "text")]
    assert reports.tables(docs.limit(0)).count() == 0


def test_read_corpus_and_stream(spark, sf, tmp_path):
    for path, content in statements.render(spark, sf).limit(5).collect():
        f = tmp_path / "in" / path
        f.parent.mkdir(parents=True)
        f.write_bytes(content.encode() + b"\xff")
    files = reports.read_corpus(spark, str(tmp_path / "in"))
    docs = reports.documents(files)
    assert docs.count() == 5 and docs.where("n_tables = 2 and n_pages = 2 and text like '%�'").count() == 5
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/docs")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out/tables")).count() == reports.tables(docs).count() == 10
    assert reports.tables(docs.unionAll(docs)).count() == 20  # every row counts, rows with one id too
    again = next((tmp_path / "in").rglob("*_extracted.txt"))
    again.with_name("again_extracted.txt").write_bytes(again.read_bytes())
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/docs")).count() == 5


def test_question_files(spark, tmp_path):
    rows = [{"id": 1, "question": "a"}, {"id": 2, "question": "b"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n{bad")
    for f in ("a.json", "b.jsonl"):
        assert sorted(map(tuple, reports.read_questions(spark, str(tmp_path / f)).where("id is not null").collect())) == [(1, "a"), (2, "b")]


def test_companies_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿ticker,company name\nAAA,An Phát\n,x\n", encoding="utf-8")
    assert [tuple(r) for r in reports.read_companies(spark, str(tmp_path / "c.csv")).collect()] == [("AAA", "An Phát")]


def test_evidence_is_not_inferred(spark, tmp_path):
    t = spark.createDataFrame([("d", 1, 1, [["Nhãn", "2020"], ["Doanh thu, \"thuần\"", "713.942"], ["y", "-"]])], "doc_id string, table_idx int, n_header_rows int, grid array<array<string>>")
    e = emit.evidence(t).first()
    assert (e["file"], e["columns"], e["numeric"]) == ("d_table_1.csv", ["nhan", "2020" if "2020" in e["columns"] else e["columns"][1]], [])
    csv = emit.evidence(t).select(emit.csv_text(F.col("columns"), F.col("rows"))).first()[0]
    (tmp_path / "e.csv").write_text(csv)
    back = reports.read_evidence(spark, str(tmp_path / "e.csv"), e["columns"], [e["columns"][1]]).collect()
    assert [tuple(r) for r in back] == [('Doanh thu, "thuần"', 713942.0), ("y", None)]


def test_package_and_read_back(spark, tmp_path):
    answers = spark.createDataFrame([(2, "q é", 1.0, ["d", "d"], ["d|1", "d|1"], "x"), (1, "q", 2.0, ["d"], ["d|1"], "x")], "id int, question string, answer double, relevant_docs array<string>, relevant_tables array<string>, query string")
    files = spark.createDataFrame([("a.csv", ["h", "é"], [["1", 'x,"y']]), ("b.csv", ["h"], [])], "file string, columns array<string>, rows array<array<string>>").repartition(3)
    emit.package(answers, files, str(tmp_path / "p"), single=True)
    (single,) = (f for f in (tmp_path / "p").iterdir() if f.suffix == ".zip")
    with zipfile.ZipFile(single) as z:
        assert sorted(z.namelist()) == ["data/a.csv", "data/b.csv", "submission.json"] and z.testzip() is None
        assert [r["id"] for r in json.loads(z.read("submission.json"))] == [1, 2]
    for path in (str(single), str(tmp_path / "p")):
        records, csvs = reports.read_package(spark, path)
        assert [json.loads(r[0])["relevant_docs"] for r in records.collect()] == [["d"], ["d"]]
        assert {r["file"]: r["rows"] for r in csvs.collect()} == {"data/a.csv": [["h", "é"], ["1", 'x,"y']], "data/b.csv": [["h"]]}
    emit.package(answers, files, str(tmp_path / "p"))
    assert reports.read_package(spark, str(tmp_path / "p"))[1].count() == 2 and not single.exists()


def test_archives(spark, tmp_path):
    """Ranges, appending, empty writes, damaged members, and writes that fail, of which nothing stays."""
    path = str(tmp_path / "z")
    rows = [(f"d/{i}.bin", bytes([i % 256]) * (i * 500)) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    archives.write(df, path)
    spark.dataSource.register(archives.ZipSource)
    got = spark.read.format("zip_archive").option("range_bytes", 100).load(path)
    assert sorted((r["name"], bytes(r["content"])) for r in got.collect()) == sorted(rows) and got.rdd.getNumPartitions() > 10
    archives.write(df.limit(1).withColumn("name", F.lit("more")), path, overwrite=False)
    assert archives.read(spark, path).count() == 61
    fails = df.withColumn("name", F.when(F.col("name") == "d/59.bin", F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        archives.write(fails, path)
    assert archives.read(spark, path).count() == 61 and not [f for f in (tmp_path / "z").iterdir() if f.name.startswith("_write")]
    archives.write(df.limit(0), path)
    assert archives.read(spark, path).count() == 0
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("plain", b"stored" * 9)
        z.mkdir("folder")
    assert [tuple(r) for r in archives.read(spark, str(tmp_path / "s.zip")).collect()] == [("s.zip", "plain", b"stored" * 9)]
    raw = (tmp_path / "s.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(raw.replace(b"storedstored", b"sturedstored", 1))
    with pytest.raises(Exception, match="damaged"):
        archives.read(spark, str(tmp_path / "bad.zip")).collect()


def test_grid_store(spark, tmp_path):
    rows = [(f"d{i:03}", k, f"grid {i} {k}") for i in range(200) for k in (1, 2)] + [("d000", 1, "grid 0 0"), (None, 1, "none")]
    grid_store.save(spark.createDataFrame(rows, "doc_id string, table_idx int, grid string"), str(tmp_path / "g"), file_rows=50)
    keys = spark.createDataFrame([("d000", 1), ("d150", 2), ("d150", 2), ("zz", 1), (None, 1)], "doc_id string, table_idx int")
    got = grid_store.fetch(spark, str(tmp_path / "g"), keys, ["grid"])
    assert sorted(tuple(r) for r in got.collect()) == [("d000", 1, "grid 0 0"), ("d150", 2, "grid 150 2")]
    assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().executedPlan().toString()
    for x in pq.ParquetFile(next(str(f) for f in (tmp_path / "g").iterdir() if f.suffix == ".parquet")).metadata.to_dict()["row_groups"]:
        assert x["num_rows"] <= 50
    monkey = grid_store.MOST_KEYS
    grid_store.MOST_KEYS = 1
    try:
        assert grid_store.fetch(spark, str(tmp_path / "g"), keys, ["grid"]).count() == 2
    finally:
        grid_store.MOST_KEYS = monkey


def test_ingest_of_versions(spark, tmp_path):
    """Repeated content is left out, a changed document comes in anew, restarts lose and repeat nothing, as one batch over all files would."""
    table = "<table><tr><td>{}</td></tr></table>"
    write = lambda rows: reports.write_files(spark.createDataFrame(rows, "path string, text string"), str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), max_files=2).awaitTermination()
    state = lambda: {(r["doc_id"], r["grid"][0][0]) for r in ingest.current(spark, str(tmp_path / "out"))[1].collect()}
    assert write([(f"T/2020/d{i}/x_extracted.txt", table.format(i)) for i in range(5)]) == 5
    run()
    assert state() == {(f"d{i}", str(i)) for i in range(5)}
    run()  # nothing new
    os.utime(tmp_path / "in/T/2020/d0/x_extracted.txt", (1, 1))
    time.sleep(1.1)
    write([("T/2020/d0/later_extracted.txt", table.format("new")), ("U/2020/d1/x_extracted.txt", table.format(1)), ("T/2020/d9/x_extracted.txt", table.format(9) * 2)])
    run()
    assert state() == {("d0", "new"), *((f"d{i}", str(i)) for i in (1, 2, 3, 4)), ("d9", "9")}
    docs = ingest.current(spark, str(tmp_path / "out"))[0]
    assert docs.count() == 6 and docs.where("doc_id = 'd9'").first()["n_tables"] == 2
    assert spark.read.parquet(str(tmp_path / "out/docs")).count() == 7


def test_order_statistics(spark):
    rnd = random.Random(2)
    for values in ([5.0], [1.0, 1.0, 1.0, 2.0], [rnd.gauss(0, 1e6) for _ in range(3000)], [1e300, -1e300, 0.0, 1e-300, 1e-300], [float(i // 7) for i in range(500)], [1.0, 1.0 + 2**-52, 1.0 + 2**-51]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
        ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
        assert quality.order_statistics(df, "x", ranks) == {r: sorted(values)[r] for r in ranks}
    assert quality.quantiles(df.limit(0), "x", [0.5]) == [None]
    with pytest.raises(ValueError, match="ranks"):
        quality.order_statistics(df, "x", [99])


def test_label_lookup_plans(spark):
    rows = "array(array(struct(' Doanh thu ' AS label, map('nam', 1.5D) AS cells), struct('Lãi' AS label, map('nam', 2D) AS cells), struct('Doanh thu' AS label, map('nam', 3D) AS cells)))"
    df = spark.sql(f"SELECT {rows} AS rows, array(7D) AS cells")
    for nth, want in ((0, 1.5), (1, 3.0), (2, None)):
        plan = ir.from_cell(0, "Doanh thu", "nam", nth, 1.0)
        assert ir.validate(plan) == []
        assert [x for x in df.select(ir.value(plan, F.col("cells"), F.col("rows")), F.expr(ir.to_sql(plan))).first()] == [want, want]
    for plan in (ir.from_cell(0, "Không", "nam", 0), ir.from_cell(0, "Lãi", "cot", 0), ir.from_cell(3, "Lãi", "nam", 0)):
        assert df.select(ir.value(plan, F.col("cells"), F.col("rows"))).first()[0] is None
    both = {"node": "arith", "op": "+", "of": [{"node": "cell", "index": 0}, ir.from_cell(0, "it's", "nam", 0, 2.0, True)]}
    assert df.select(F.expr(ir.to_sql(both))).first()[0] is None and ir.validate(both) == []
    assert ir.validate({"node": "lookup", "table": 0, "label": "x", "column": "c", "nth": -1}) and ir.validate({"node": "lookup", "label": "x"})


def test_worth_adding(spark):
    df = spark.createDataFrame([(0.3, 2, 2, 3), (0.1, 2, 2, 3)], "p double, h int, g int, k int")
    assert [r[0] for r in df.select(numbers.worth_adding(*map(F.col, "phgk"))).collect()] == [True, False]


def test_missing_position_gives_no_reference(spark):
    df = spark.createDataFrame([("d", 1, None, None, 5)], "doc_id string, table_idx int, line_no int, page_no int, char_start int")
    r = df.select(emit.table_ref("line_no").alias("a"), emit.table_refs().alias("b"), emit.table_ref("table_idx", "file_stem").alias("c")).first()
    assert tuple(r) == (None, ["d|1", "d|5"], "d_extracted|1")
    with pytest.raises(ValueError):
        emit.table_ref("nowhere")


def test_bm25_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a d"), (4, None), (5, "")], "id long, text string")
    index = bm25.build(docs)
    assert {r["term"] for r in index.terms.collect()} == {"A", "B"}
    index.save(str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "B b zzz"), (2, "zzz"), (3, "")], "qid long, query string")
    got = bm25.score(bm25.Index.load(spark, str(tmp_path / "i")), q)
    assert sorted((r["qid"], r["id"]) for r in got.collect()) == [(1, 1), (1, 2)]
    assert bm25.score(bm25.build(docs.limit(0)), q).count() == 0


def test_search_refuses_too_many_queries(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    q = v.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    assert [tuple(r) for r in search.search(v, q, 1).select("qid", "id").orderBy("qid").collect()] == [(1, 1), (2, 2)]
    assert search.search(v.limit(0), q, 1).count() == 0
    monkeypatch.setattr(search, "MAX_QUERIES", 1)
    with pytest.raises(ValueError):
        search.search(v, q, 1)
    embedded = search.embed(spark.createDataFrame([("ab",)], "t string"), "t", lambda: lambda s: [[float(len(x)), 0.0, 9.0] for x in s], dims=2)
    assert embedded.first()["embedding"] == [1.0, 0.0]
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_no_documents_means_all_tables(spark):
    ir_ = spark.createDataFrame([(1,), (2,)], "qid int")
    meta = spark.createDataFrame([(10, "a"), (11, "b")], "id int, doc_id string")
    docs = spark.createDataFrame([(1, "a"), (1, "gone")], "qid int, doc_id string")
    index = bm25.build(spark.createDataFrame([(10, "x"), (11, "y")], "id long, text string"))
    base = retrieve.base_scores(ir_.withColumn("retrieval_query", F.lit("x")), meta, index, docs)
    assert sorted((r["qid"], r["id"]) for r in base.collect()) == [(1, 10), (2, 10), (2, 11)]


def test_fusion_weight_zero_is_off(spark):
    lex = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "qid int, id int, score double")
    ce = spark.createDataFrame([(1, 2, 0), (1, 9, 1)], "qid int, id int, rank int")
    assert {r["fusion"] for r in retrieve.hybrid(lex, ce, 0.0).collect()} == {"lex_only"}
    on = {r["id"]: r["score"] for r in retrieve.hybrid(lex, ce, 1.0).collect()}
    assert on[2] == pytest.approx(1 / 62 + 1 / 61) and on[1] == pytest.approx(1 / 61) and 9 not in on
    scored = retrieve.rerank_scores(spark.createDataFrame([("q", "pp")], "query string, passage string"), lambda: lambda q, p: p.str.len())
    assert scored.first()["rerank_score"] == 2.0


def test_typeless_and_nearest(spark):
    docs = spark.createDataFrame([("x", "T", 2018, "other"), ("y", "T", 2020, "other"), ("c", "S", 2020, "consolidated"), ("s", "S", 2020, "separate"), ("o", "S", 2020, "other")], "doc_id string, ticker string, year int, stmt_type string")
    rows = [(1, None, [2019], ["T"], []), (2, "separate", [2020], ["S"], []), (3, None, [], ["S"], []), (4, None, [2020], ["S"], ["GROWTH"])]
    ir_ = spark.createDataFrame(rows, "qid int, stmt_type string, years array<int>, tickers array<string>, ops array<string>")
    got = {}
    for r in documents.filter_documents(ir_, docs).orderBy("place").collect():
        got.setdefault(r["qid"], []).append(r["doc_id"])
    assert got[1] == ["y", "x"] and got[2] == ["o", "s"] and got[3] == ["c", "o"] and got[4] == ["c", "o"]


def test_alignment_uses_one_label(spark, report_facts, sf):
    irs = questions.parse(statements.questions(spark, sf, "sum"), statements.companies(spark, sf))
    hits = lookup.lookup_per_target(irs, report_facts, 6)
    assert lookup.vote(hits).where("n < 2").count() == 0
    assert lookup.lookup_aligned(irs, report_facts).groupBy("qid").agg(F.countDistinct("label").alias("n")).where("n <> 1").count() == 0
    assert lookup.lookup(irs, report_facts.limit(0)).count() == 0


def test_growth_in_money_is_a_difference(spark, report_facts, sf):
    q = spark.createDataFrame([(1, "Doanh thu thuần của N00 năm 2018 tăng bao nhiêu đồng so với năm 2017?")], "id int, question string")
    got = solve.solve(questions.parse(q, statements.companies(spark, sf)), report_facts).first()
    t = {r["year"]: r["revenue"] for r in statements.truth(spark, sf).where("ticker = 'N00'").collect()}
    assert got["kind"] == "DIFF" and got["value"] == t[2018] - t[2017]


def test_relaxed_location_takes_the_first_table(spark, report_docs, sf):
    irs = questions.parse(statements.questions(spark, sf, "ratio_ab"), statements.companies(spark, sf)).where("qid = 2017").withColumns({"retrieval_query": F.lit("DOANH THU THUAN"), "years": F.array(F.lit(2040))})
    t = reports.tables(report_docs).where("doc_id = 'N00_2018_consolidated'").withColumns({"qid": F.lit(irs.first()["qid"]), "place": F.col("table_idx")})
    got = locate.locate_best(irs, t).first()
    assert got["relaxed"] and got["table_idx"] == 2
    assert locate.occurrence(locate.cells(irs, t, relax=True)).where("nth > 0").count() == 0


def test_identities_without_parts(spark, report_facts):
    got = {r["rule"]: r for r in quality.identities(report_facts.where("concept <> 'TONG_NGUON_VON'")).collect()}
    assert got["270 == 440"]["n"] == 0 and got["270 == 440"]["rate"] is None and got["10-11 == 20"]["rate"] == 1.0
    assert "| rule |" in quality.report({"identities": quality.identities(report_facts)})
    assert quality.suspicious(spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 3, 9)], "doc_id string, table_idx int, n_numeric_cells int, n_rows int")).count() == 1


def test_facts_are_written_by_company(spark, report_facts, tmp_path):
    facts.write(report_facts, str(tmp_path / "f"))
    plan = spark.read.parquet(str(tmp_path / "f")).where("ticker = 'N01'")
    assert plan.count() == report_facts.where("ticker = 'N01'").count()
    assert "PartitionFilters: [isnotnull(ticker" in plan._jdf.queryExecution().toString()


def test_plans(spark):
    cell = lambda i: {"node": "cell", "index": i}
    assert ir.validate({"node": "literal", "value": 9651580686}) and not ir.validate({"node": "scale", "of": cell(0), "by": 1e9})
    assert ir.validate({"node": "import", "name": "os"}) and not ir.validate({"node": "literal", "value": 2018})
    cells = F.array(F.lit(100.0), F.lit(150.0))
    growth = ir.from_solution("GROWTH", 2, percent=True)
    assert one(spark, ir.value(growth, cells)) == 50.0 and spark.sql(f"select {ir.to_sql(growth)} from (select array(100D, 150D) as cells)").first()[0] == 50.0
    for kind, want in (("SUM", 250.0), ("AVG", 125.0), ("MIN", 100.0), ("MAX", 150.0), ("DIFF", -50.0), ("RATIO", 100 / 150)):
        p = ir.from_solution(kind, 2)
        assert not ir.validate(p) and one(spark, ir.value(p, cells)) == pytest.approx(want)
        assert spark.sql(f"select {ir.to_sql(p)} from (select array(100D, 150D) as cells)").first()[0] == pytest.approx(want)
    assert one(spark, ir.value(ir.from_solution("ARGMAX_YEAR", 2, [2019, 2020]), cells)) == 2020.0
    assert one(spark, ir.value({"node": "arith", "op": "/", "of": [cell(0), {"node": "literal", "value": 0}]}, cells)) is None
    df = {"df1": spark.createDataFrame([(" Doanh thu ", "5"), ("x", "nan")], "nhan string, nam string")}
    row = {"node": "filter", "of": {"node": "evidence", "name": "df1"}, "column": "nhan", "op": "=", "value": "Doanh thu", "trim": True}
    assert ir.scalar(row, df, "nam") == 5.0 and ir.scalar({"node": "evidence", "name": "df1"}, df, "nam", 1) is None and ir.scalar(row, df, "nam", 3) is None
    both = {"node": "set", "op": "union", "of": [row, row]}
    top = {"node": "top", "n": 1, "order": [["nhan", True]], "of": {"node": "window", "as": "n", "by": ["nhan"], "order": [["nam", False]], "of": {"node": "project", "columns": ["nhan", "nam"], "of": both}}}
    assert ir.table(top, df).count() == 1


@pytest.mark.parametrize(("code", "ok", "form"), [("df1.iat[0,0] * 1000000.0", True, "expr"), ("result = df1.iat[0,1]", True, "assign"), ("9651580686", False, "expr"), ("df1['tai_ngay_31_12_2022'].iloc[0]", True, "expr"), ("x = 1\nresult = x", False, "multi"), ("", False, "unparsable"), ("df1[", False, "unparsable"), ("df1[df1.nam == 2018]", True, "expr"), ("df1.iat[0,0] / 9651.58", False, "expr")])
def test_generated_code_guard(code, ok, form):
    c = prompts.check_code(code)
    assert (c.ok, c.form) == (ok, form)
    assert prompts.check_code("x = 1\nresult = x", strict=False).ok


def test_prompts(spark):
    rows = spark.createDataFrame([(1, 1, i, "doanh thu" if i == 30 else f"khac {i}", "DOANH THU") for i in range(40)], "qid int, table int, row int, label string, query string")
    kept = sorted(r["row"] for r in prompts.pick_rows(rows, 10).collect())
    assert len(kept) == 10 and set(range(8)) <= set(kept) and 30 in kept and prompts.pick_rows(rows, 99).count() == 40
    p = one(spark, prompts.preview(F.array(F.lit("a")), F.array(F.array(F.lit("v" * 99))), F.lit(5)))
    assert p == "a\n" + "v" * 60 + "\n... 1 of 5 rows"


def render_and_count(head, tables, years, k, n):
    """A prompt of the first k tables with n rows each, from the definition, and its size."""
    lines = list(head)
    for number, t in enumerate(tables[:k], 1):
        own = prompts.chosen_columns(t["columns"], years)
        first = list(range(min(8, len(t["rows"]))))
        rest = sorted(range(8, len(t["rows"])), key=lambda i: (-t["scores"][i], i))
        keep = set((first + rest)[:n])
        lines += [f"### df{number}   ({t['file']})", "```csv", prompts.csv_line([t["columns"][i] for i in own])]
        lines += [prompts.csv_line([r[i] if i < len(r) else "" for i in own]) for j, r in enumerate(t["rows"]) if j in keep]
        lines += [f"… {n} of {len(t['rows'])} rows; df{number} holds all of them"] if n < len(t["rows"]) else []
        hidden = [c for i, c in enumerate(t["columns"]) if i not in own]
        lines += ([f"… {len(hidden)} more columns: {', '.join(hidden)}"] if hidden else []) + ["```"]
    lines += [prompts.more_tables(len(tables) - k)] if k < len(tables) else []
    return "\n".join(lines), sum(len(x) // 3 + 1 for x in lines)


def test_prompts_fit_as_rendered():
    rnd = random.Random(4)
    count = lambda lines: [len(x) // 3 + 1 for x in lines]
    for _ in range(60):
        tables = []
        for t in range(rnd.randint(0, 5)):
            columns = [f"c{i}" if rnd.random() < 0.7 else f"nam_{2018 + i % 4}" for i in range(rnd.choice([2, 5, 12, 13, 20]))]
            rows = [["x" * rnd.randint(0, 90) + rnd.choice(["", ",", '"', "\n"]) for _ in columns[: rnd.randint(1, len(columns))]] for _ in range(rnd.choice([0, 3, 10, 11, 25, 40]))]
            tables.append({"file": f"f{t}.csv", "columns": columns, "rows": rows, "scores": [rnd.random() for _ in rows]})
        head, years, k = ["CÂU HỎI: ?", ""], [2019], len(tables)
        for budget in (0, 100, 400, 1500, 5000, 10**6):
            tried = [(k, n) for n in prompts.ROWS] + [(i, prompts.ROWS[-1]) for i in range(k - 1, 0, -1)]
            want = next(((*render_and_count(head, tables, years, *x), *x) for x in tried if render_and_count(head, tables, years, *x)[1] <= budget), None)
            if want is None:
                last = (min(1, k), prompts.LAST_ROWS)
                want = (*render_and_count(head, tables, years, *last), *last)
            prompt, n_tables, n_rows, size = prompts.fit(head, tables, years, count, budget)
            assert (prompt, size, n_tables, n_rows) == want


def test_prompt_counts_each_line_once():
    seen = []
    table = {"file": "f", "columns": ["a", "b"], "rows": [[f"r{i}", "1"] for i in range(40)], "scores": [0.0] * 40}
    prompts.fit(["head"], [table] * 3, [], lambda lines: [seen.append(x) or 10 for x in lines], 50)
    assert sum(x.startswith("r") for x in seen) == 120


def test_patches(spark, tmp_path):
    base = spark.createDataFrame([(1, 10.0, ["a", "b"]), (2, 5.0, ["a"]), (3, 1.0, ["a"])], "id int, answer double, evidence array<string>")
    new = spark.createDataFrame([(1, 11.0, ["a"], 10.0), (2, float("nan"), None, None)], "id int, new_answer double, seen array<string>, rule_answer double")
    lines = lambda df: df.withColumn("line", F.lit(1))
    state = lambda log: {r["id"]: (r["answer"], r["status"], r["conflict"]) for r in patch.merge(base, log, [F.desc("line")]).collect()}
    assert state(lines(new)) == {1: (11.0, "applied", True), 2: (5.0, "rejected", False), 3: (1.0, "none", False)}
    # the last line of an id counts, whatever the lines before it say
    log = spark.createDataFrame([(1, 50.0, None, None, 1), (1, 11.0, None, None, 2), (2, float("nan"), None, None, 1), (2, 11.0, None, None, 2), (3, 99.0, ["z"], None, 1), (3, 11.0, ["a"], None, 2), (9, 1.0, None, None, 1)], "id int, new_answer double, seen array<string>, rule_answer double, line int")
    assert state(log) == {i: (11.0, "applied", False) for i in (1, 2, 3)}
    back = spark.createDataFrame([(1, 11.0, None, None, 1), (1, float("inf"), None, None, 2)], log.schema)
    assert state(back)[1] == (10.0, "rejected", False)
    assert [r["id"] for r in patch.pending(base, new).collect()] == [3]
    for k in range(2):
        patch.append(spark.createDataFrame([(1, k)], "id int, seq int"), str(tmp_path / "log"))
    log = reports.read_json_lines(spark, str(tmp_path / "log"), "id int, seq int")
    assert [tuple(r) for r in patch.last_write(log, ["id"], [F.desc("seq")]).collect()] == [(1, 1)]


def test_verification(spark):
    refs = spark.createDataFrame([(1, "d|5"), (1, "d|6"), (1, "x|5"), (2, "d5"), (2, "d|y")], "id int, ref string")
    real = spark.createDataFrame([("d", 5)], "doc_id string, line_no int")
    traced = verify.trace_refs(refs, real)
    assert {r["ref"]: r["status"] for r in traced.collect()} == {"d|5": "ok", "d|6": "bad_line", "x|5": "bad_doc", "d5": "bad_format", "d|y": "bad_format"}
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, answer double"), spark.createDataFrame([(1, 1.0000001)], "id int, value double")
    s = verify.summary(spark.createDataFrame([], "id int, error string"), verify.compare(a, b), traced).first()
    assert (s["records"], s["executes"], s["matches"], s["n_ref"], s["passed"]) == (2, 1, 1, 5, False)
    assert "counters" in emit.run_metadata({"k": 1}, spark.createDataFrame([("a", 1)], "name string, n int"))
    assert emit.traces(a.withColumnRenamed("id", "qid")).count() == 2
